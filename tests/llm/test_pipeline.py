"""Every stage against a plain version, over the smallest table."""

import os
import re

import pytest

pytest.importorskip("swathline.llm")
import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = os.environ.get("PIPELINE_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile("[^\x20\x09-\x0d]+")


def near_kept(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall(t.lower())
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for x, (a, s) in enumerate(sets):
        for b, u in sets[:x]:
            if s and u and 100 * len(s & u) >= 80 * len(s | u):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i for i in parent if find(i) == i}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "12 345 !", "en", "s", 8), (10**6 + 1, None, "en", "s", 0), (10**6 + 2, docs.first()["text"].replace(" ", "  "), "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd).withColumn("component_id", F.lit("mine"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = set(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k == 0:
            kept = {i for i in kept if any(map(str.isalpha, rows[i] or ""))}
        elif k == 1:
            first = {}
            for i in sorted(kept):
                first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", rows[i]), i)
            kept = set(first.values())
        elif k == 2:
            kept = near_kept([(i, rows[i]) for i in sorted(kept)])
        elif k == 3:
            kept = {i for i in kept if not any(t in rows[i] for t in items)}
        assert {r.doc_id for r in docs.select("doc_id").collect()} == kept, name
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert docs.agg(F.sum("length")).first()[0] == sum(len(full.encode(rows[i], add_special_tokens=False).ids) + 1 for i in kept)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_language_stage_without_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    lettered = {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()} == lettered


def test_language_stage_judges_each_row(spark, tmp_path):
    """Rows that share an id, or have none, stay or go by their own text; also where nothing was learnt."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a good text", None, "s", 11), (1, "12 34", None, "s", 5), (None, "another text", None, "s", 12), (None, "??", None, "s", 2), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    for lang in (None, "en"):
        docs = spark.createDataFrame([(i, t, lang, s, n) for i, t, _, s, n in rows], schema)
        left = corpus_pipeline.language(spark, docs, SF)
        assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == ["a good text", "another text"]


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    item = spark.createDataFrame([(1, "where was the very old bridge over the wide river built by those masons")], "item_id long, text string")
    item.write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = "many words before it " + item.first()["text"]
    rows = [(None, leak), (None, "a clean text without an id"), (7, leak), (7, "a clean text with the same id"), (8, "some other text"), (9, "some  other text"), (9, "a text of its own")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
    clean = {t for _, t in rows if t != leak}
    assert {r.text for r in corpus_pipeline.leaks(spark, docs, str(tmp_path)).collect()} == clean
    left = [(r.doc_id, r.text) for r in corpus_pipeline.exact(spark, docs, str(tmp_path)).collect()]
    assert sorted(map(str, left)) == sorted(str(r) for r in rows if r[1] != "some  other text" and r != (None, leak))
