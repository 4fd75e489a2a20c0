import random

import numpy as np
import pytest

pytest.importorskip("swathline.llm")
from pyspark.sql import functions as F

from swathline.llm import language_id

SYLLABLES = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "er", "ung", "ei"], "cc": ["ção", "lh", "eu", "os"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def plain_phrases(train, s):
    """Greedy parse of the whole text against the training string."""
    total = at = 0
    while at < len(s):
        n = 1
        while at + n < len(s) and s[at : at + n + 1] in train:
            n += 1
        total, at = total + 1, at + n
    return total


def hold(model, train, cases):
    as_text = lambda codes: "".join(map(chr, codes))
    got = model.phrases(cases)
    for k, name in enumerate(model.names):
        known = as_text([x for t in train[name] for x in (language_id.SEPARATOR, *model.symbols([t])[0].tolist())])
        for i, case in enumerate(cases):
            assert got[i, k] == plain_phrases(known, as_text(model.symbols([case])[0].tolist())), (name, case[:60])


def test_phrases_against_plain_parse():
    rng = random.Random(1)
    train = {k: [text(rng, k, 60), text(rng, k, 60)] for k in SYLLABLES}
    hold(language_id.Languages(train), train, [text(rng, k, n) for k in SYLLABLES for n in (1, 5, 200, 900)] + ["", "Ω Ωa!! 12", "   ", "KATO, mi\nra!" * 50])


def test_phrases_that_cross_lanes():
    """Copies of the training text, and runs of a letter, whose phrases never begin where lanes do."""
    rng = random.Random(3)
    train = {"aa": ["a" * 300 + text(rng, "aa", 400)], "bb": ["b" * 7 + "x", text(rng, "bb", 500) * 2], "cc": ["a"]}
    hold(language_id.Languages(train), train, ["a" * 5000, "z" + "a" * 2000, train["aa"][0] * 3, "q" + train["bb"][1][5:] + "b" * 3000, "b" * 1000 + train["bb"][1], "ab" * 900, "z" * 700])


def test_many_scripts():
    """Every letter of a language's training text counts, however many others there are."""
    train = {f"l{k}": ["".join(chr(0x4E00 + 300 * k + i % 300) for i in range(0, 1500, 7))] for k in range(30)}
    model = language_id.Languages(train)
    names, _ = model.judge([t[0][20:90] for t in train.values()])
    assert names == list(train)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, rng.randrange(2, 80)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=300))]
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 ... !", None), (903, "katomi", None), (None, "scherung", "bb"), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(i, t, g, "z", 0.5) for i, t, g in rows + odd], "doc_id long, text string, lang string, lang_pred2 string, score double")
    train = language_id.sample(df, F.col("doc_id") % 4 != 2)
    assert set(train) == set(SYLLABLES)
    got = language_id.identify(df, train).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert by[900].lang_pred == by[901].lang_pred == by[902].lang_pred == "und" and by[902].score == 0
    assert by[903].lang_pred == "aa" and by[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got)
    held = [(g, by[i].lang_pred) for i, _, g in rows if i % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.98
    left = language_id.keep_known(df, train)
    assert left.columns == df.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in left.collect()) and left.count() == len(rows) + len(odd) - 3


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.sample(df, F.lit(True)) == {}
    assert language_id.identify(df, {}).count() == 0


def test_nothing_learnt_drops_no_letters(spark):
    df = spark.createDataFrame([(1, "katomi", None), (2, "12 ... !", None), (3, None, None)], "doc_id long, text string, lang string")
    train = language_id.sample(df, F.lit(True))
    assert train == {}
    assert {r.doc_id: r.lang_pred for r in language_id.identify(df, train).collect()} == {1: None, 2: "und", 3: "und"}
    assert [r.doc_id for r in language_id.keep_known(df, train).collect()] == [1]


def test_rows_are_judged_one_by_one(spark):
    """Null and repeated ids, clashing names, and a very long text."""
    rows = [(1, "katomi", "x", 1.0), (1, "12", "x", 1.0), (None, "12 !", None, None), (None, "rato", None, None), (2, "mira " * 40_000, "", 0.0), (2, None, "", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")
    left = language_id.keep_known(df, {"aa": ["katomi rato mira"]})
    assert left.columns == df.columns
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in df.collect() if r.text and "a" in r.text)


def test_sample_is_of_whole_rows(spark):
    rows = [(i, "w" * (10 + i), "en") for i in range(200)] + [(500, "y" * 3000, "fr"), (501, "y" * 2900, "fr"), (502, None, "de"), (503, "5", "de"), (504, "z" * 90_000, "la"), (505, "v" * 95_000, "la")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = {t for _, t, _ in rows}
    got = language_id.sample(df, F.lit(True), per_language=20, total=2000, longest=300)
    assert set(got) == {"en", "fr", "la"} and all(t in texts for part in got.values() for t in part)
    assert got["fr"] == ["y" * 2900] and got["la"] == ["z" * 90_000] and 1 < len(got["en"]) <= 20 and sum(map(len, got["en"])) <= 2000
    with pytest.raises(ValueError, match="labels"):
        language_id.sample(spark.range(500).selectExpr("id AS doc_id", "'a' AS text", "string(id) AS lang"), F.lit(True))
