import random
import re
from collections import defaultdict

import pytest

pytest.importorskip("swathline.llm")
from swathline.llm import near_dedup
from swathline.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(t, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def brute(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, u in sets[:x] if s and u and a is not None and b is not None and 100 * len(s & u) >= 80 * len(s | u)]
    root = roots({i for i, _ in rows if i is not None}, links)
    return sorted((str(i), len(s), str(root.get(i)), root.get(i) == i) for i, s in sets)


def corpus(rng, n, groups):
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(200))
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([1, 3, 4, 30, 120, 400]))]
        for _ in range(n):
            text = list(base)
            for _ in range(int(len(base) * rng.choice([0, 0, 0.01, 0.02, 0.04, 0.05]))):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text).upper() if rng.random() < 0.1 else rng.choice([" ", "\n"]).join(text))
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(random.Random(seed), 20, 10)
    if seed == 2:
        rows += [(0, None), (901, ""), (902, " \n"), (None, rows[0][1]), (903, "ÄB c"), (904, "äb c"), (905, "Ab c"), (906, "aB c"), (906, "other words here now so"), (rows[0][0], rows[0][1]), (907, "q " * 3000)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, rep string, component int")
    got = near_dedup.near_duplicates(df, shingle=4, group=8).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got if r.doc_id is not None) == [x for x in brute(rows, 4) if x[0] != "None"]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * (seed == 2)


def test_chain_and_no_hub(spark):
    """Each text is linked with its neighbours only."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        rows.append((100 - i, " ".join(words)))
        for p in rng.sample(range(200), 4):
            words[p] = f"x{rng.randrange(10**6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, shingle=4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(rows, 4)


def test_small_blocks(spark, monkeypatch):
    """A core and many texts at its rim, in blocks of a few."""
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in rng.sample(range(1000), 60):
        text = list(base)
        for p in rng.sample(range(150), rng.choice([1, 2, 4, 6, 8, 10])):
            text[p] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(text)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    want = brute(rows, 4)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == want
    assert 3 < len({x[2] for x in want}) < 50


def test_empty(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 300)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = roots({n for e in edges for n in e}, edges)
    alone = {n for n in want if all(a == b for a, b in edges if n in (a, b))}
    assert got == {n: r for n, r in want.items() if n not in alone}
    sizes = defaultdict(int)
    for r in got.values():
        sizes[r] += 1
    assert sizes[200] == 300
