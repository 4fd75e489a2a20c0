import random
import re
from collections import Counter
from hashlib import sha256

import pytest

pytest.importorskip("swathline.llm")
from swathline.llm import substring_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, k):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(doc), len(w), len(gone), sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize("k, block", [(3, 400), (5, 1 << 20), (35, 3000)])
def test_against_brute_force(spark, k, block):
    rng = random.Random(k)
    vocabulary = ["a", "b", "née", "loooooooooooooooooooooooooong", "longlong", "longlong9", "x y", "\x1c"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [(i, rng.choice(["", " ", "\n\t"]).join(["", rng.choice([" ", "\n", "\t \v"]).join(rng.choice(vocabulary) + str(rng.randrange(30)) * (k > 3) for _ in range(rng.randrange(90)))])) for i in range(120)]
    rows = [(i, t + " " + passage if i % 7 == 0 else t) for i, t in rows]
    rows += [(500, None), (501, ""), (502, "  "), (None, passage), (503, "once"), (7, rows[7][1]), (7, rows[7][1]), (504, "w " * 500)]
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, block int, bucket string")
    got = substring_dedup.remove_repeats(df, window=k, block_bytes=block, with_text=True).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == brute(rows, k)
    for r in got:
        assert sum(s["to"] - s["from"] for s in r.removed) == r.n_removed
        assert all(a["to"] < b["from"] for a, b in zip(r.removed, r.removed[1:]))


def test_empty(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
