"""Weighted means and quantiles. Values that aren't finite and weights that aren't positive are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import clamp


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def counts_in(value: Column, weight: Column) -> Column:
    return finite(value) & (weight > 0)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate; 0 without any weight."""
    good = counts_in(value, weight)
    total = F.sum(F.when(good, weight))
    return F.coalesce(F.when(total > 0, F.sum(F.when(good, value * weight)) / total), F.lit(0.0))


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, qs: dict[str, float]) -> DataFrame:
    """One row a group: the first value at which the running weight reaches q of the whole; no interpolation.

    Equal values are summed before the window, so its rows are a group's distinct values and the shuffle is one
    by keys. A group without any usable row has 0.
    """
    good = counts_in(F.col(value), F.col(weight))
    usable = df.select(*keys, F.when(good, F.col(value)).alias("__v"), F.when(good, F.col(weight)).otherwise(0.0).alias("__w"))
    each = usable.groupBy(*keys, "__v").agg(F.sum("__w").alias("__w"))
    run = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumns({"__run": F.sum("__w").over(run), "__all": F.sum("__w").over(Window.partitionBy(*keys))})
    # The last value in case rounding keeps the running sum below the whole.
    reached = lambda q: F.col("__v").isNotNull() & (F.col("__run") >= F.lit(min(1.0, max(0.0, q))) * F.col("__all"))
    return each.groupBy(*keys).agg(*[F.coalesce(F.min(F.when(reached(q), F.col("__v"))), F.max("__v"), F.lit(0.0)).alias(name) for name, q in qs.items()])


def principal_axis(x: Column, y: Column, weight: Column) -> Column:
    """Aggregate: the axis, in degrees from north, along which the weighted points spread most."""
    w = F.sum(weight)
    mx, my = F.sum(weight * x) / w, F.sum(weight * y) / w
    xx, yy, xy = F.sum(weight * x * x) / w - mx * mx, F.sum(weight * y * y) / w - my * my, F.sum(weight * x * y) / w - mx * my
    return F.pmod(F.degrees(F.atan2(2 * xy, yy - xx)) / 2, F.lit(180.0))


def line_lift(cells: DataFrame, keys: list[str], bearing: float, spacing: float, altitude: float) -> DataFrame:
    """How far sweep lines, which fly over the highest cell under them, are above the other cells, by group.

    cells: x, y, z, area, conf. A cell's line is its cross distance from the area-weighted centre over the spacing,
    halves to even. One shuffle by keys serves the centre, the lines' maxima and the result.
    """
    import math

    p = math.radians((bearing + 90) % 360)
    whole = Window.partitionBy(*keys)
    centre = lambda c: F.sum(F.col("area") * F.col(c)).over(whole) / F.sum("area").over(whole)
    lines = cells.withColumns({"__cx": centre("x"), "__cy": centre("y")})
    cross = (F.col("x") - F.col("__cx")) * math.sin(p) + (F.col("y") - F.col("__cy")) * math.cos(p)
    lines = lines.withColumn("__line", F.rint(cross / max(1.0, spacing)).cast("long"))
    top = F.max("z").over(Window.partitionBy(*keys, "__line"))
    lines = lines.withColumn("__lift", F.greatest(F.lit(0.0), top - F.col("z"))).withColumn("__w", F.greatest(F.lit(1e-6), F.col("area") * (0.35 + 0.65 * F.col("conf"))))
    part = lambda least: F.sum(F.when(F.col("__lift") >= least, F.col("area")).otherwise(0.0)) / F.sum("area")
    figures = lines.groupBy(*keys).agg(
        F.count_distinct("__line").alias("lines"), weighted_mean(F.col("__lift"), F.col("__w")).alias("mean_lift"), F.max("__lift").alias("max_lift"),
        part(max(10.0, altitude * 0.12)).alias("elevated"), part(max(25.0, altitude * 0.28)).alias("severe"),
    )
    return figures.join(weighted_quantiles(lines, keys, "__lift", "__w", {"p90_lift": 0.9}), keys)


def plane_fit(points: DataFrame, keys: list[str], passes: int = 3, cut: float = 5.0) -> DataFrame:
    """z = a x + b y + c about the means by group, robust: a, b, mean x, y, z, samples, r2, rmse, contour.

    Each pass is one aggregation of seven sums; the weight of a residual is 1 within `cut` and cut / |residual| beyond,
    and the first pass takes residuals from the level plane. Groups of under 6 points, or in a line, drop out.
    """
    mean = points.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.count(F.lit(1)).alias("samples")).filter("samples >= 6")
    d = points.join(mean, keys).withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my"), "dz": F.col("z") - F.col("mz")})
    fit = None
    for _ in range(passes):
        at = d.withColumns({"a": F.lit(0.0), "b": F.lit(0.0)}) if fit is None else d.join(fit, keys)
        r = F.abs(F.col("dz") - F.col("a") * F.col("dx") - F.col("b") * F.col("dy"))
        at = at.withColumn("w", F.when(r < cut, 1.0).otherwise(cut / r))
        s = {n: F.sum(F.col("w") * F.col(p) * F.col(q)).alias(n) for n, p, q in (("xx", "dx", "dx"), ("yy", "dy", "dy"), ("xy", "dx", "dy"), ("xz", "dx", "dz"), ("yz", "dy", "dz"))}
        sums = at.groupBy(*keys).agg(*s.values()).withColumn("det", F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")).filter("abs(det) >= 1e-12")
        fit = sums.select(*keys, ((F.col("xz") * F.col("yy") - F.col("xy") * F.col("yz")) / F.col("det")).alias("a"), ((F.col("xx") * F.col("yz") - F.col("xy") * F.col("xz")) / F.col("det")).alias("b"))
    r = F.col("dz") - F.col("a") * F.col("dx") - F.col("b") * F.col("dy")
    quality = d.join(fit, keys).groupBy(*keys, "mx", "my", "mz", "samples", "a", "b").agg(F.sum(r * r).alias("ss"), F.sum(F.col("dz") * F.col("dz")).alias("total"))
    slope = F.hypot("a", "b")
    contour = F.when(slope >= 1e-8, F.pmod(F.degrees(F.atan2(F.col("a"), F.col("b"))) + 90, F.lit(180.0)))
    return quality.select(*keys, "samples", "a", "b", F.when(F.col("total") > 0, 1 - F.col("ss") / F.col("total")).otherwise(0.0).alias("r2"), F.sqrt(F.col("ss") / F.col("samples")).alias("rmse"), contour.alias("contour"))


def node_cost(bearing: Column, slope: Column, conf: Column, heading: Column | float, payload: str = "camera", altitude: float = 100.0, target: float = 100.0, fov: float = 90.0, reach: float = 200.0) -> Column:
    """struct of costs of flying a cell at a heading: quality, holes, low coverage, coverage, mismatch."""
    import math

    from ..functions.angles import axial_delta

    across = F.abs(F.sin(F.radians(axial_delta(bearing, heading))))
    miss = across * across * (0.35 + 0.65 * conf)
    steep = clamp(across * slope / 0.12, 0, 1.8)
    zero = F.lit(0.0)
    if payload == "lidar":
        lift = steep * (0.55 + 0.45 * conf)
        half = altitude * math.tan(math.radians(fov) / 2)
        over = F.greatest(zero, F.hypot(altitude * (1 + 0.65 * lift), F.lit(half)) / max(1.0, reach) - 1)
        holes = clamp(over * 1.25 + F.greatest(zero, miss + 0.35 * lift - 1.1), 0, 1)
        dense = clamp(1 - 1.05 * miss - 0.42 * lift - 1.6 * over, 0, 1.15)
        low = clamp((1 - dense) * 0.75 + holes * 0.9, 0, 1)
        quality = 0.85 * F.greatest(zero, 1 - dense) + 2.2 * holes + 1.75 * low + 0.35 * miss
        coverage = dense * target
    else:
        holes = zero
        low = clamp(F.greatest(zero, miss - 0.3) * 1.8 + F.greatest(zero, steep - 1) * 0.5, 0, 1)
        quality = F.greatest(zero, 1.35 * miss + 0.35 * steep) + 1.05 * low
        coverage = F.greatest(zero, 1 - miss - 0.2 * steep)
    return F.struct(quality.alias("quality"), holes.alias("holes"), low.alias("low"), coverage.alias("coverage"), miss.alias("mismatch"))
