"""Exact dedup by progressive refinement: length, then prefix hash, then the hash of the full text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, SPACE_CLASS, join_counted, without, written

PREFIX_CHARS = 256


def normal_text(text: Column) -> Column:
    """Every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are alike when their normalised texts are. A group that is alone in its length, or in its length and
    prefix hash, needs no further look; only the rest is read again and hashed in full, and only that hash decides.
    With digest_all the digest is asked for on every row, so the one scan that measures also hashes.
    Otherwise text_sha256 is null where refinement ended earlier.

    The smallest id of a group stays. Repeated rows (same id, same text) count each, and one of them stays.
    Null ids come last: such a row stays only if no other of its group has an id. Null texts equal empty ones. An empty
    table gives no rows. Lengths, prefixes and digests that many rows share are never one task's.
    """
    measured = docs.select(F.col(id_col).alias("doc_id"), normal_text(F.col(text_col)).alias("t"))
    short = [F.col("doc_id"), F.length("t").alias("len"), F.xxhash64(F.substring("t", 1, PREFIX_CHARS)).alias("prefix")]
    full = F.sha2(F.col("t"), 256).alias("sha")
    row = F.monotonically_increasing_id().alias("row")  # told apart only once written
    flat = written(measured.select(row, *short, full if digest_all else F.lit(None).cast("string").alias("sha")), "exact")
    rows = flat.count()
    survivors = written(_survivors(flat, rows), "exact-keys")
    if digest_all:
        wanted = written(join_counted(flat, survivors, ["len", "prefix"], "n", rows).select("row", "doc_id", "sha"), "exact-full")
    else:
        few = survivors.count() <= BROADCAST_ROWS
        again = measured.select(*short, "t").join(F.broadcast(survivors) if few else survivors, ["len", "prefix"], "left_semi")
        wanted = written(again.select(row, "doc_id", full), "exact-full")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("row"))).alias("first")
    groups = wanted.groupBy("sha").agg(first, F.count(F.lit(1)).alias("n"))
    joined = join_counted(wanted, groups, ["sha"], "n", rows).select(
        "doc_id", F.col("first.id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    alone = join_counted(flat, survivors, ["len", "prefix"], "n", rows, "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return joined.unionByName(alone)


def _survivors(flat: DataFrame, rows: int) -> DataFrame:
    """(len, prefix, n) of which there are several rows, looked for only in lengths of which there are several."""
    lengths = flat.groupBy("len").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = join_counted(flat.select("len", "prefix"), lengths, ["len"], "n", rows).select("len", "prefix")
    return shared.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that copy an earlier id; every other column as it was, whatever its name.

    Of a group of equal texts the row with the smallest id stays, one of repeated rows, and one row without an id only
    where no other has one. Only texts that share length and prefix with another are read in full. An empty table stays empty.
    """
    found = written(exact_groups(docs, id_col, text_col), "exact-groups")
    gone = written(found.filter(~F.col("kept")).select("doc_id"), "exact-gone")
    ids = gone.distinct()
    same_id = docs.select(F.col(id_col).alias("__own")).join(ids, F.col("__own").eqNullSafe(F.col("doc_id")), "left_semi")
    if same_id.count() == gone.count():
        return without(docs, ids.select(F.col("doc_id").alias("__gone")), F.col(id_col).eqNullSafe(F.col("__gone")))
    # A row that goes shares its id with one that stays: rows are told apart by their digest too, and equal ones brought together.
    found = written(exact_groups(docs, id_col, text_col, digest_all=True), "exact-groups")
    stays = found.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__stays")).distinct()
    columns = docs.columns
    hashed = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(columns)], F.sha2(normal_text(docs[text_col]), 256).alias("__sha"))
    at = f"c{columns.index(id_col)}"
    left = hashed.join(stays, F.col(at).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__stays")), "left_semi").dropDuplicates([at, "__sha"])
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
