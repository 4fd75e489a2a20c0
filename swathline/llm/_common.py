"""What the operators of this package share: written tables, gapless ranks, the names of inner columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space in the word rules of this package: space, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"

#: Rows of some tens of bytes that may be broadcast, once they are counted; more are joined by shuffle.
BROADCAST_ROWS = 400_000
#: Rows up to which one task can hold all that share a key, and a side of as many rows at most is broadcast.
FEW_ROWS = 100_000
#: A key with more than this share of the rows is hot; there are at most as many of them as its inverse.
HOT_SHARE = 1000

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a session of one machine gets a temporary one; on a cluster nothing else would do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="swathline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, partitions: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so lost executors cost no earlier stage.

    The tables go when the interpreter ends, as a lazily built result may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    if not _written:
        atexit.register(_drop_written, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop_written(spark: SparkSession) -> None:
    jvm, hadoop = spark.sparkContext._jvm, None
    if jvm is None or spark.sparkContext._jsc is None:
        return
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
    _written.clear()


def without(docs: DataFrame, gone: DataFrame, on: Column) -> DataFrame:
    """docs without the rows that meet a row of gone; few of those are broadcast, so that no text moves."""
    gone = written(gone, "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, on, "left_anti")


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined (inner, left or left_anti) with right, which has a row for each key that says how many rows `n` of left have it.

    A key with over a HOT_SHARE-th of all `rows` would land in one task: there are at most HOT_SHARE such keys, which are
    broadcast, and only the others are shuffled. left is read twice, so it should be a table or cheap. Null keys meet nothing.
    Of FEW_ROWS or fewer rows right has no more rows, and is broadcast as it is.
    """
    if rows <= FEW_ROWS:
        return left.join(F.broadcast(right.select(*keys) if how == "left_anti" else right), keys, how)
    hot = right.filter(F.col(n) * HOT_SHARE > rows)
    rest = right.filter(F.col(n) * HOT_SHARE <= rows)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    if how == "left_anti":
        return cold.join(rest.select(*keys), keys, "left_anti")
    return cold.join(rest, keys, how).unionByName(left.join(F.broadcast(hot), keys))


def with_rank(df: DataFrame, group: list[str], order: list[str | Column], rows: int, name: str = "rank", target: int = 50_000) -> DataFrame:
    """df with a long `name`: 0, 1, 2, ... without gaps within each group.

    A group may hold any share of the rows, so no task sorts a whole group: rows go to hash buckets of about
    `target` rows within their group, are numbered there, and start from the sum of the earlier buckets' counts.
    `rows` is the number of rows of df. Equal rows get different ranks. `order` must depend on the rows alone.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    buckets = max(1, -(-rows // target))
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    keys = [*group, "__bucket"]
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    numbered = dealt.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    right = starts.select(*[F.col(k).alias(f"__r_{k}") for k in keys], "__start")
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    joined = numbered.join(right, same, "left").withColumn(name, (F.col("__start") + F.col("__row") - 1).cast("long"))
    return joined.select(*df.columns, name)
