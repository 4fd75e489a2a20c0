"""Sharding by jump consistent hashing: no ring table, and one more shard takes rows only into itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import with_rank


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of each key.

    Lamping and Veach's jumps: from bucket b the next bucket is floor((b + 1) / r) with r uniform in (0, 1]
    decided by the key and b; the last bucket below `shards` is the shard. The draws are xxhash64 of (key, b)
    in place of a running generator, so a jump depends on nothing but the key and the bucket left.
    Jumps strictly rise, so `shards` steps always reach the end; a step at the end stays there.
    """
    def jump(b: Column, _: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, b), 33) + 1
        after = F.floor((b + 1) * (F.lit(float(1 << 31)) / draw))
        return F.when(after < shards, after.cast("long")).otherwise(b)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), F.lit(0).cast("long"), jump).cast("int")


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, gapless slot within the shard, and the shard after one more is appended, for each document.

    A null text counts as empty (8 bytes, checksum 0); a null id is a key like any other; repeated rows
    share a shard and have different slots; an empty table gives no rows. Other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id")).count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col("doc_id")
    flat = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    flat = flat.withColumns({"law": F.lit("key"), "shard": jump_shard(key, shards), "grown_shard": jump_shard(key, shards + 1)})
    ranked = with_rank(flat, ["shard"], ["doc_id", "text_crc32", "size"], rows, "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
