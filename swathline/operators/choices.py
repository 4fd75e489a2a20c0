"""Choosing among orientations, partitions and cuts: ranks, fallbacks, predicted quality, and how much of an area they cover."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import objectives as obj
from ..functions.angles import axial_delta, axial_mean, clamp
from .weighted import line_lift, weighted_mean, weighted_quantiles


def ranked_orientations(found: DataFrame, keys: list[str], name: str, cost: str) -> DataFrame:
    """found with `place`: 1 for the cheapest of its group; names that repeat count once, ties go by name."""
    once = found.dropDuplicates([*keys, name])
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(cost, name)))


def fallbacks(plans: DataFrame, keys: list[str], name: str, most: int = 6) -> DataFrame:
    """The `most` plans of the lowest score of each group, with their place."""
    w = Window.partitionBy(*keys).orderBy("score", name)
    return plans.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def best_by(plans: DataFrame, keys: list[str], name: str, score: str) -> DataFrame:
    """The plan of the least score of each group, the first by name of equal ones: one aggregation with partial minima."""
    rest = [c for c in plans.columns if c not in keys]
    best = plans.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(score), F.col(name))).alias("b"))
    return best.select(*keys, "b.*")


def guidance_quality(cells: DataFrame, keys: list[str], heading: float, spacing: float, altitude: float, relief: tuple[float, float, float], short: float, fov: float = 90.0, reach: float = 200.0) -> DataFrame:
    """Predicted quality of a region at a heading: mean and 0.9-quantile of the mismatch, costs for camera and lidar, share of holes.

    cells: x, y, z, area, conf, bearing. relief: mean, 0.9-quantile and most of the terrain under lines; short: share of short lines.
    """
    delta, loss = obj.mismatch(F.col("bearing"), F.col("conf"), heading)
    c = cells.withColumns({"__d": delta, "__l": loss, "__w": F.greatest(F.lit(1e-6), F.col("area") * (0.25 + 0.75 * F.col("conf")))})
    mean_relief, p90_relief, most_relief = (r / max(1.0, altitude) for r in relief)
    share = lambda test: F.sum(F.when(test, F.col("area")).otherwise(0.0)) / F.greatest(F.lit(1.0), F.sum("area"))
    figures = c.groupBy(*keys).agg(weighted_mean(F.col("__d"), F.col("__w")).alias("mismatch"), weighted_mean(F.col("__l"), F.col("__w")).alias("loss"), share(F.col("__l") > 0.35).alias("under"), share(1 - 1.9 * F.col("__l") - 0.75 * most_relief < 0.1).alias("bare"))
    for value, name in (("__d", "p90_mismatch"), ("__l", "p90_loss")):
        figures = figures.join(weighted_quantiles(c, keys, value, "__w", {name: 0.9}), keys)
    f = figures.join(line_lift(cells, keys, heading, spacing, altitude), keys)
    high = max(1.0, altitude)
    mean_lift, p90_lift, elevated, severe = F.col("mean_lift") / high, F.col("p90_lift") / high, F.col("elevated"), F.col("severe")
    zero = F.lit(0.0)
    camera_under = clamp(F.col("under") + 0.45 * elevated + 0.85 * severe, 0, 1)
    camera = 0.9 * (1.5 * F.col("loss") + 0.55 * mean_relief + 0.95 * mean_lift) + 1.7 * (2.1 * F.col("p90_loss") + 0.85 * p90_relief + 1.35 * p90_lift) + 1.2 * camera_under + 0.35 * elevated + 0.9 * severe + 0.4 * short
    slant = lambda lift: F.greatest(zero, F.hypot(altitude + lift, F.lit(altitude * math.tan(math.radians(fov) / 2))) / max(1.0, reach) - 1)
    gaps = clamp(elevated * (0.25 + 1.2 * slant(F.col("p90_lift"))) + severe * (0.8 + 2.4 * slant(F.col("max_lift"))), 0, 1)
    holes = clamp(F.col("bare") + gaps, 0, 1)
    lidar_under = clamp(F.greatest(F.col("under"), F.col("under") * 0.75 + elevated * 0.85), 0, 1)
    dense = clamp(1 - 1.15 * F.col("loss") - 0.45 * mean_relief, 0, 1.25) / F.pow(1 + mean_lift, F.lit(1.7))
    thin = clamp(1 - 1.65 * F.col("p90_loss") - 0.65 * most_relief, 0, 1.15) / F.pow(1 + p90_lift, F.lit(2.1))
    lidar = 0.85 * F.greatest(zero, 1 - dense) + 1.95 * F.greatest(zero, 1 - thin) + 1.65 * holes + 1.05 * lidar_under + 0.5 * elevated + 1.15 * severe
    return f.select(*keys, "mismatch", "p90_mismatch", camera.alias("camera"), lidar.alias("lidar"), holes.alias("holes"))


def region_node_cost(cells: DataFrame, keys: list[str], heading: float, altitude: float, reach: float = 200.0, fov: float = 90.0) -> DataFrame:
    """Costs of a region at a heading from its cells (bearing, slope, conf, area), for camera and lidar, with their risks."""
    risk = obj.cell_risk(F.col("bearing"), F.col("slope"), F.col("conf"), heading, altitude, reach, fov)
    c = cells.withColumns({f"__{k}": v for k, v in risk.items()} | {"__w": F.greatest(F.lit(1e-6), F.col("area") * (0.25 + 0.75 * F.col("conf")))})
    w = F.col("__w")
    mean = lambda n: weighted_mean(F.col(f"__{n}"), w)
    share = lambda test: F.sum(F.when(test, w).otherwise(0.0)) / F.greatest(F.lit(1e-6), F.sum(w))
    f = c.groupBy(*keys).agg(mean("loss").alias("loss"), mean("steep").alias("steep"), mean("dense").alias("dense"), mean("holes").alias("lidar_holes"), share((F.col("__loss") > 0.32) | (F.col("__steep") > 1.1)).alias("camera_low"), share((F.col("__dense") < 0.7) | (F.col("__holes") > 0.35)).alias("lidar_low"))
    f = f.join(weighted_quantiles(c, keys, "__loss", "__w", {"p90": 0.9}), keys).join(weighted_quantiles(c, keys, "__dense", "__w", {"thin": 0.1}), keys)
    zero = F.lit(0.0)
    camera = F.greatest(zero, 1.35 * F.col("loss") + 0.35 * F.col("steep")) + 1.35 * F.greatest(zero, 1.85 * F.col("p90") + 0.55 * F.col("steep")) + 1.05 * F.col("camera_low") + 0.3 * F.col("loss")
    lidar = 0.85 * F.greatest(zero, 1 - F.col("dense")) + 1.95 * F.greatest(zero, 1 - F.col("thin")) + 4.1 * F.col("lidar_holes") + 2.15 * F.col("lidar_low") + 0.35 * F.col("loss")
    return f.select(*keys, camera.alias("camera"), "camera_low", lidar.alias("lidar"), "lidar_holes", "lidar_low")


def cut_bonus(points: DataFrame, keys: list[str], cut: float, offset: Column | float, step: float) -> DataFrame:
    """(keys, bonus): how much contours turn across a cut at a bearing, `offset` metres from the points' mean, near it.

    points: x, y, slope, strength, bearing. Points in a band about the cut count by their nearness, slope and break; 0 with
    under three points to a side.
    """
    turn = math.radians(cut + 90)
    band = max(120.0, 2.4 * step)
    whole = Window.partitionBy(*keys)
    d = (F.col("x") - F.avg("x").over(whole)) * math.sin(turn) + (F.col("y") - F.avg("y").over(whole)) * math.cos(turn) - offset
    p = points.withColumn("__d", d).withColumn("__p", F.when(F.abs("__d") <= band, 1 - F.abs("__d") / band))
    w = F.col("__p") * F.greatest(F.lit(0.05), F.col("slope")) * F.greatest(F.lit(0.1), F.col("strength") / 12)
    near, left = F.col("__p").isNotNull(), F.col("__d") >= 0
    mean = lambda side: axial_mean(F.col("bearing"), F.when(near & side, w))
    f = p.groupBy(*keys).agg(F.count(F.when(near & left, 1)).alias("nl"), F.count(F.when(near & ~left, 1)).alias("nr"), mean(left).alias("l"), mean(~left).alias("r"), (F.sum(F.col("strength") * F.col("__p")) / F.sum("__p")).alias("strength"))
    value = clamp(F.least("nl", "nr") / 8, 0, 1) * clamp(axial_delta(F.col("l"), F.col("r")) / 18, 0, 4) * clamp(F.col("strength") / 10, 0, 2.5)
    return f.select(*keys, F.when((F.col("nl") >= 3) & (F.col("nr") >= 3), value).otherwise(0.0).alias("bonus"))


def coverage(parents: DataFrame, claims: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """(keys, covered, overlap, viable): shares of the parents' cells that regions claim, and that they claim beyond once.

    claims: keys, region, cell. One aggregation by cell, one by parent.
    """
    n = claims.select(*keys, "region", cell).distinct().groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("__n"))
    both = parents.select(*keys, cell, F.lit(1).alias("__own")).join(n, [*keys, cell], "full")
    f = both.groupBy(*keys).agg(F.count("__own").alias("whole"), F.count(F.when(F.col("__own").isNotNull() & F.col("__n").isNotNull(), 1)).alias("met"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("more"))
    f = f.filter("whole > 0").select(*keys, (F.col("met") / F.col("whole")).alias("covered"), (F.col("more") / F.col("whole")).alias("overlap"))
    return f.withColumn("viable", obj.viable(F.col("covered"), F.col("overlap")))
