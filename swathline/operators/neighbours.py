"""Cells of a grid and their neighbours: gradients, break strength, confidence and adjacency.

A cell reaches its neighbours as a copy at their place, so each step is an explosion and one aggregation by place; the
grid is never joined with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import axial, axial_delta, circular_delta, clamp
from ..functions.terrain import axis_gradient

#: Itself and the four beside it, as (row, column) steps from a neighbour to the cell.
_SIDES = {"own": (0, 0), "e": (0, 1), "w": (0, -1), "n": (1, 0), "s": (-1, 0)}


def _beside(cells: DataFrame, value: Column) -> DataFrame:
    """(row, col, own, e, w, n, s): the value of each cell and of those beside it; places without a cell of their own are left out."""
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for k, (r, c) in _SIDES.items()]))
    spread = cells.select("row", "col", value.alias("v"), sides.alias("s"))
    spread = spread.select((F.col("row") - F.col("s.dr")).alias("row"), (F.col("col") - F.col("s.dc")).alias("col"), "s.side", "v")
    return spread.groupBy("row", "col").agg(*[F.max(F.when(F.col("side") == k, F.col("v"))).alias(k) for k in _SIDES]).filter("own IS NOT NULL")


def grid_features(cells: DataFrame, step: float) -> DataFrame:
    """cell, row, col, slope, aspect, preferred bearing, break strength and confidence of cells (cell, row, col, z).

    A gradient is central, or one-sided where a neighbour is missing; a cell that has none along an axis drops out.
    """
    z = _beside(cells, F.struct(F.col("z"), F.col("cell")))
    gx, gy = axis_gradient(F.col("own.z"), F.col("e.z"), F.col("w.z"), step), axis_gradient(F.col("own.z"), F.col("n.z"), F.col("s.z"), step)
    f = z.select("row", "col", F.col("own.cell").alias("cell"), gx.alias("gx"), gy.alias("gy")).filter("gx IS NOT NULL AND gy IS NOT NULL").withColumn("slope", F.hypot("gx", "gy"))
    steep = F.col("slope") > 1e-6
    f = f.withColumn("aspect", F.when(steep, F.pmod(F.degrees(F.atan2("gx", "gy")), F.lit(360.0))).otherwise(0.0))
    f = f.withColumn("preferred", F.when(steep, axial(F.col("aspect") + 90)).otherwise(0.0))
    near = _beside(f, F.struct("cell", "slope", "aspect", "preferred"))
    others = F.filter(F.array("e", "w", "n", "s"), lambda o: o.isNotNull())
    near = near.select("row", "col", "own", others.alias("others"))
    # All neighbours are one step away and so weigh the same.
    mean = lambda f: F.aggregate("others", F.lit(0.0), lambda s, o: s + f(o)) / F.size("others")
    da, dp = mean(lambda o: circular_delta(F.col("own.aspect"), o["aspect"])), mean(lambda o: axial_delta(F.col("own.preferred"), o["preferred"]))
    ds = mean(lambda o: F.abs(F.col("own.slope") - o["slope"]))
    strength = F.when(F.size("others") > 0, (0.65 * da + 0.35 * dp + 70 * ds) * clamp(F.col("own.slope") / 0.18, 0.3, 1.8)).otherwise(0.0)
    out = near.select("own.cell", "row", "col", "own.slope", "own.aspect", "own.preferred", strength.alias("strength"))
    return out.withColumn("sure", clamp(F.col("slope") / 0.12, 0, 1) * clamp(1 - F.col("strength") / 65, 0.15, 1))


def edges(cells: DataFrame) -> DataFrame:
    """(a, b) of cells side by side, right and up."""
    b = _beside(cells, F.struct("cell"))
    return b.select(F.col("own.cell").alias("a"), F.explode(F.filter(F.array("e", "n"), lambda o: o.isNotNull())).alias("o")).select("a", F.col("o.cell").alias("b"))


def region_adjacency(cells: DataFrame, region: str, step: float) -> DataFrame:
    """(region_a, region_b, boundary, strength) of regions side by side: metres in common and the mean break strength along them."""
    strong = grid_features(cells, step).select("cell", "strength")
    rated = cells.join(strong, "cell", "left").select("row", "col", F.col(region).alias("r"), F.coalesce("strength", F.lit(0.0)).alias("s"))
    b = _beside(rated, F.struct("r", "s")).select("own", F.explode(F.filter(F.array("e", "n"), lambda o: o.isNotNull())).alias("o")).filter("own.r <> o.r")
    pair = F.least("own.r", "o.r").alias("region_a"), F.greatest("own.r", "o.r").alias("region_b")
    return b.groupBy(*pair).agg((F.count(F.lit(1)) * step).alias("boundary"), F.avg((F.col("own.s") + F.col("o.s")) / 2).alias("strength"))
