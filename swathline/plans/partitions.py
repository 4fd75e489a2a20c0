"""Queries of patches, segmentations and partitions of areas made of the bound cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import atoms, search, solver
from ..sources.bindings import cells, with_tables


def _cells(spark: SparkSession, sf: str, rows: int = 5) -> DataFrame:
    """Areas of so many rows of cells, with bearings in stripes, and a break between them."""
    c = cells(spark, sf)
    stripe = F.floor(F.col("col") / 7 + F.col("row") / 50)
    return c.select(F.floor(F.col("row") / rows).alias("block"), "cell", "row", "col", (F.col("col") * 100.0).alias("x"), (F.col("row") * 100.0).alias("y"), F.lit(10000.0).alias("area"), F.pmod(stripe * 55.0 + F.col("cell") % 5, F.lit(180.0)).alias("bearing"), F.pmod(stripe * 55.0 + 90, F.lit(360.0)).alias("aspect"), (0.05 + F.col("cell") % 4 * 0.02).alias("slope"), (0.5 + F.col("cell") % 3 * 0.2).alias("conf"), (F.col("cell") % 6).cast("double").alias("strength"))


def bearing_bands(spark: SparkSession, sf: str) -> DataFrame:
    found = atoms.bearing_bands(_cells(spark, sf), ["block"], 30000.0)
    return found.groupBy("part", "band").agg(F.count(F.lit(1)).alias("cells"), F.round(F.max("area"), 2).alias("area"))


def edge_costs(spark: SparkSession, sf: str) -> DataFrame:
    return atoms.edge_costs(_cells(spark, sf), ["block"]).select("a", "b", *[F.round(c, 5).alias(c) for c in ("turn", "barrier", "cost")])


def atom_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    """Patches of three columns and their neighbours."""
    c = _cells(spark, sf).withColumn("patch", F.col("block") * 100 + F.floor(F.col("col") / 3))
    return atoms.adjacency(c, ["block"], "patch", 100.0).select("block", "left", "right", "boundary", F.round("turn", 5).alias("turn"), F.round("barrier", 5).alias("barrier"))


def terrain_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """Patches of like cells: how many an area has, and whether every cell is in one that holds its name."""
    found = atoms.atoms(_cells(spark, sf), ["block"], least=1, most=10**6)
    return found.groupBy("block", "atom").agg(F.count(F.lit(1)).alias("cells"))


def area_halves(spark: SparkSession, sf: str) -> DataFrame:
    return atoms.halves(_cells(spark, sf), ["block"]).groupBy("block", "side").agg(F.count(F.lit(1)).alias("cells"))


def segmentations(spark: SparkSession, sf: str) -> DataFrame:
    """Every area's regions of patches, from the cheapest number down to one."""
    found = atoms.segmentation(_cells(spark, sf), ["block"])
    return atoms.frontier(found, ["block"]).select("block", "level", F.round("cost", 6).alias("cost"), "practical")


def partition_plans(spark: SparkSession, sf: str) -> DataFrame:
    """The frontier of every area's partitions by straight cuts, as many cuts deep as the search goes by default."""
    found = solver.solved(_cells(spark, sf), ["block"], step=100.0, spacing=60.0)
    return found.groupBy("block", "plan", "regions", "practical").agg(F.count(F.lit(1)).alias("cells"), F.round(F.max("quality"), 5).alias("quality"), F.round(F.max("seconds"), 2).alias("seconds"))


def split_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Length and weight of the boundary of every area's split at its middle column."""
    c = _cells(spark, sf).withColumn("side", F.col("col") < 10)
    e = atoms.edge_costs(c, ["block"]).select("block", "a", "b")
    return search.boundary(c, e, "side", 100.0, ["block"]).select("block", "length", F.round("weight", 4).alias("weight"))


QUERIES = {f.__name__: f for f in (bearing_bands, edge_costs, atom_adjacency, terrain_atoms, area_halves, segmentations, partition_plans, split_boundaries)}

_C = "c AS (SELECT row // 5 AS block, cell, row, col, 10000::DOUBLE AS area, fmod(floor(col / 7::DOUBLE + row / 50::DOUBLE) * 55 + cell % 5, 180::DOUBLE) AS bearing, fmod(floor(col / 7::DOUBLE + row / 50::DOUBLE) * 55 + 90, 360::DOUBLE) AS aspect, 0.5::DOUBLE + cell % 3 * 0.2 AS conf, (cell % 6)::DOUBLE AS strength FROM cells)"
_E = f"""{_C}, e AS (SELECT a.block, a.cell AS a, b.cell AS b, a.col AS acol, b.col AS bcol, a.aspect AS aa, b.aspect AS ba, least(abs(a.bearing - b.bearing), 180 - abs(a.bearing - b.bearing)) AS turn, (a.strength + b.strength) / 2 AS barrier, abs(a.conf - b.conf) AS sure, floor(a.bearing / 24) AS ab, floor(b.bearing / 24) AS bb
FROM c a JOIN c b ON a.block = b.block AND ((b.row = a.row AND b.col = a.col + 1) OR (b.col = a.col AND b.row = a.row + 1)))"""


def _parts(test: str) -> str:
    return f"{_E}, l AS (SELECT a, b FROM e WHERE {test}), w2 AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), walk(node, root) AS (SELECT cell, cell FROM c UNION SELECT w2.b, walk.root FROM walk JOIN w2 ON w2.a = walk.node WHERE w2.b > walk.root), p AS (SELECT node AS cell, min(root) AS part FROM walk GROUP BY node)"


ORACLE = {
    "edge_costs": with_tables(f"WITH {_E} SELECT a, b, round(turn, 5) AS turn, round(barrier, 5) AS barrier, round(turn / 18 + barrier / 10 + 0.8 * sure, 5) AS cost FROM e", "cells"),
    "bearing_bands": with_tables(f"WITH RECURSIVE {_parts('ab = bb')} SELECT part, floor(any_value(bearing) / 24)::INTEGER AS band, count(*) AS cells, round(sum(area), 2) AS area FROM p JOIN c USING (cell) GROUP BY part HAVING sum(area) >= 30000", "cells"),
    "terrain_atoms": with_tables(f"WITH RECURSIVE {_parts('turn <= 14 AND barrier <= 11.25 AND turn / 18 + barrier / 10 + 0.8 * sure <= 1.75')} SELECT block, part AS atom, count(*) AS cells FROM p JOIN c USING (cell) GROUP BY block, part", "cells"),
    "atom_adjacency": with_tables(f"WITH {_E} SELECT block, block * 100 + least(acol // 3, bcol // 3) AS \"left\", block * 100 + greatest(acol // 3, bcol // 3) AS \"right\", count(*) * 100::DOUBLE AS boundary, round(avg(turn), 5) AS turn, round(avg(barrier), 5) AS barrier FROM e WHERE acol // 3 <> bcol // 3 GROUP BY ALL", "cells"),
    "split_boundaries": with_tables(f"WITH {_E} SELECT block, count(*) * 100::DOUBLE AS length, round(sum(100 * (0.55 * barrier + 0.3 * least(abs(aa - ba), 360 - abs(aa - ba)) + 0.15 * turn)), 4) AS weight FROM e WHERE (acol < 10) <> (bcol < 10) GROUP BY block", "cells"),
}
