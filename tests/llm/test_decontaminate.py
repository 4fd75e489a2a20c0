import random
from collections import defaultdict

import pytest
import regex

pytest.importorskip("swathline.llm")
from swathline.llm import decontaminate

ITEMS = [
    (1, "The train leaves at 10:30 with Alice, who pays 12 dollars for each ticket to the coast. How much does Alice pay for 3 tickets?"),
    (2, "A farmer has 7 cows and 7 hens, and sells 7 hens on the market before the rain falls on the old wooden barn."),
    (3, "short one here"), (4, ""), (5, None), (6, "12 34"), (7, "Where was the very old bridge over the wide river built by those masons?"),
]
PLAIN = "many other words stand before it "
DOCS = [
    (1, PLAIN + ITEMS[0][1] + " and after"),
    (2, PLAIN + ITEMS[0][1].replace("Alice", "Robert").replace("12", "99").replace("10:30", "8")),
    (3, PLAIN + ITEMS[0][1].replace("who pays", "who gives")),
    (4, PLAIN + ITEMS[1][1].replace("7", "9")),
    (5, PLAIN + ITEMS[1][1].replace("7 cows", "5 cows").replace("7 hens,", "6 hens,").replace("7 hens on", "4 hens on")),
    (6, PLAIN), (7, None), (8, ""), (9, "it is a SHORT one, here."), (10, "12 34"), (11, "where WAS the very old\nbridge - over the wide river"),
    (12, ITEMS[1][1].replace("7", "9") + " then " + ITEMS[1][1].replace("7", "8")),
    (13, "word " * 5000), (None, ITEMS[6][1]), (14, ITEMS[6][1]), (14, ITEMS[6][1]), (15, "the train leaves at ten with the coast"),
]


def frames(spark, docs=DOCS, items=ITEMS):
    return spark.createDataFrame([(i, t, "h", 1) for i, t in docs], "doc_id long, text string, hash string, item_id int"), spark.createDataFrame(items, "item_id long, text string")


def test_templates_and_slots(spark):
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(*frames(spark)).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2), (9, 3), (11, 7), (12, 2), (None, 7), (14, 7)}
    assert got[1, 1].matched == got[1, 1].windows and not got[1, 1].reparameterised
    assert got[2, 1].matched == got[2, 1].windows and got[2, 1].reparameterised
    assert got[12, 2].matched == got[12, 2].windows


def test_stage_keeps_the_rest(spark):
    docs, items = frames(spark)
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [5, 6, 7, 8, 10, 13, 15]


def test_empty(spark):
    docs, items = frames(spark)
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


SLOTTED = ["What is 15% of 240?", "Compute 17 * 23 + 4.", "Solve 3x + 5 = 20 for x.", "Convert 5 km to miles.", "Who wrote Pride and Prejudice?", "Who was King of England in 1066?", "Add 1, 2 and 3, then 4, 5 and 6, then 7, 8 and 9."]


def test_items_rich_in_placeholders_are_found_verbatim(spark):
    items = list(enumerate(SLOTTED)) + [(50, "12 34"), (51, ""), (52, "??")]
    docs = [(i, PLAIN + t + " And so on.") for i, t in enumerate(SLOTTED)] + [(60, PLAIN + "What is 16% of 240?"), (61, "1, 2, 3, 4, 5, 6, 7, 8, 9 or 12 34"), (62, None)]
    df, bench = frames(spark, docs, items)
    with pytest.warns(UserWarning, match="2 benchmark items"):
        got = decontaminate.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(len(SLOTTED))}
    assert not any(r.reparameterised for r in got)
    assert sorted(r.item_id for r in decontaminate.unsearched(bench).collect()) == [50, 52]


def test_quotes_of_long_items(spark):
    long = ["".join("abcdefghij"[int(d)] for d in str(1000 + i)) for i in range(400)]
    items = [(1, " ".join(long)), (2, "red 1 " + " ".join(long[:40][::-1]) + " 1 blue"), (3, "short one here")]
    quote = lambda n: PLAIN + " ".join(long[150 : 150 + n]) + " and after"
    odd = "red 1 " + " ".join(long[:40][::-1][:20]) + " x" * 20 + " 2 blue"
    docs = [(1, quote(100)), (2, quote(16)), (3, quote(15)), (4, " ".join(x for i, x in enumerate(long) if i % 12)), (5, PLAIN), (6, odd)]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(*frames(spark, docs, items)).collect()}
    assert {k[0] for k in got if k[1] == 1} == {1, 2, 4} and (6, 2) in got
    assert got[1, 1].matched == 93 and got[2, 1].matched == 9 and got[1, 1].windows == 393 and not got[1, 1].reparameterised
    assert [r.doc_id for r in decontaminate.drop_contaminated(*frames(spark, docs, items)).orderBy("doc_id").collect()] == [3, 5]


SPACE = "[ \\t\\n\\x0b\\f\\r]"
NUMBER = regex.compile(rf"([+-]?[0-9]+(?:[.,:/][0-9]+)*)(?:{SPACE}*({decontaminate.UNITS})(?![\p{{L}}\p{{M}}]))?")
NAMED = regex.compile(r"(?<=[\p{L}\p{M},;] )\p{Lu}[\p{Ll}\p{M}]+")
TOKEN = regex.compile("[\x01-\x03][^ \t\n\x0b\f\r]+|[\\p{L}\\p{M}]+")


def plain_tokens(text):
    x = regex.sub("[\x01-\x03]", " ", text or "")
    x = NUMBER.sub(lambda m: f" \x01{m[1]} \x02{m[2] or ''} ", x)
    return TOKEN.findall(NAMED.sub(lambda m: f" \x03{m[0]} ", x).lower())


def plain_windows(tokens, size):
    """(start, key, values) of each window: its template, or its values where it has under five words."""
    for i in range(len(tokens) - size + 1):
        values = tuple(tokens[i : i + size])
        words = sum(t[0] > "\x03" for t in values)
        few = words < min(5, size)
        yield i, (size, few, values if few else tuple(t if t[0] > "\x03" else t[0] for t in values)), values


def plain_held(docs, items):
    found = set()
    keys, windows = defaultdict(list), {}
    for item, text in items:
        forms = [plain_tokens(text), plain_tokens(", " + (text or ""))]
        size = min(8, len(forms[0]))
        own = {(i, k, v) for n, f in enumerate(forms) for i, k, v in plain_windows(f, size) if not n or i == 0} if size else set()
        own = {(i, k, v) for i, k, v in own if any(regex.search(r"\p{L}", t) for t in v)}
        templates = {i for i, k, _ in own if not k[1]}
        windows[item] = len(templates or {i for i, _, _ in own})
        for i, k, v in own:
            keys[k].append((item, i, v, not k[1] or not templates))
    for doc, text in docs:
        placed = defaultdict(list)
        tokens = plain_tokens(text)
        for size in range(1, 9):
            for at, k, values in plain_windows(tokens, size):
                for item, i, was, counts in keys.get(k, ()):
                    placed[item, at - i].append((i, counts, {(a, b) for a, b in zip(was, values, strict=True) if a[0] <= "\x03"}))
        matched, other, quoted = defaultdict(set), defaultdict(bool), defaultdict(bool)
        for (item, shift), hits in placed.items():
            slots = set().union(*(s for _, _, s in hits))
            fits = len(slots) == len({a for a, _ in slots})
            exact = sorted({i for i, _, s in hits if all(a == b for a, b in s)})
            quote = any(i + 8 in exact and set(range(i, i + 9)) <= set(exact) for i in exact)
            if fits or quote:
                matched[item] |= {i for i, c, s in hits if c and (fits or all(a == b for a, b in s))}
                other[item] |= fits and any(a != b for a, b in slots)
                quoted[item] |= quote
        for item, at in matched.items():
            if quoted[item] or len(at) >= 0.3 * windows[item]:
                found.add((str(doc), item, len(at), windows[item], other[item]))
    return found


@pytest.mark.parametrize("few", [True, False])
def test_against_brute_force(spark, monkeypatch, few):
    """Random items and documents with their pieces, other slot values, null and repeated ids; broadcast and shuffled keys."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 10**6 if few else 0)
    rng = random.Random(4)
    words = ["red", "Blue", "the", "of", "été", "runs", "Anna", "Bob", "goes", "and", "twelve", "Ω", "to", "a", "x" * 40]
    value = lambda: rng.choice(["3", "4 km", "10:30", "-5.5", "7 %", "12kg", "99", "in"])
    sentence = lambda n: rng.choice([" ", ", "]).join(rng.choice(words) if rng.random() < 0.8 else value() for _ in range(n))
    items = [(i, sentence(rng.choice([1, 3, 6, 8, 12, 30])) + rng.choice([".", "?", ""])) for i in range(25)] + [(90, None), (91, ""), (92, "12 34"), (93, "Anna and Bob")]
    docs = []
    for i in range(120):
        text = sentence(rng.randrange(20))
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1] or ""
            part = regex.sub(r"\d+", lambda m: str(rng.randrange(50)) if rng.random() < 0.5 else m[0], part) if rng.random() < 0.5 else part
            cut = part.split(" ")
            text += rng.choice([" ", ". ", ", "]) + " ".join(cut[rng.randrange(3) * (rng.random() < 0.3) :]) + " " + sentence(rng.randrange(9))
        docs.append((None if i % 17 == 0 else i, text))
    docs += [(500, None), (501, ""), (502, "word " * 9000), docs[1], (docs[2][0], docs[3][1])]
    df, bench = frames(spark, docs, items)
    with pytest.warns(UserWarning):
        got = decontaminate.contaminated(df, bench).collect()
    want = plain_held(docs, items)
    assert {(str(r.doc_id), r.item_id, r.matched, r.windows, r.reparameterised) for r in got} == want
    assert len(want) > 40
    gone = {(d, t) for d, t in docs if plain_held([(d, t)], items)}
    with pytest.warns(UserWarning):
        left = decontaminate.drop_contaminated(df, bench).select("doc_id", "text").collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in left))) == sorted(str(d) for d in docs if d not in gone)
