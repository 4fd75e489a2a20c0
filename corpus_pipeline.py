"""Cleans a corpus and packs it for training: stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swathline.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from swathline.llm._common import table, written
from swathline.llm.queries import tokenizer, training_texts


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told go: those without a letter."""
    return language_id.keep_known(docs, training_texts(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, 0.8 or more), the smallest doc_id stays."""
    return near_dedup.drop_near_duplicates(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with its own or other numbers, names and units, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near), ("benchmark decontamination", leaks), ("packing", pack)]

#: Trained models and tokens are beyond SQL; a test holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns, for documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
