"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_counted, written


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) for every node of edges (u, v): the smallest node that it reaches, itself included.

    Large-star hangs each node's larger neighbours on the smallest of its neighbourhood, small-star does so with its
    smaller ones; edges that no longer change are stars around the smallest nodes. Each half round groups by a
    node with a partial minimum and joins that minimum back; a hub's minimum is broadcast to its edges, so that they are
    never in one task. Each half round is a written table. Loops and repeated edges do no harm. No edges, no rows.
    """
    edges = _distinct(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).filter("u <> v"))
    edges = written(edges, "edges")
    state = _state(edges)
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_counted(both.filter("v > u"), least, ["u"], "n", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(_distinct(large.filter("u <> v")), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_counted(large, least, ["u"], "n", state[0]).select(F.explode(F.array(F.struct(F.col("u").alias("u")), F.struct(F.col("v").alias("u")))).alias("e"), "m")
        edges = written(_distinct(small.select("e.u", F.col("m").alias("v")).filter("u <> v")), "small-star")
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").distinct()


def _state(edges: DataFrame) -> tuple:
    """The same for the same set of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
