"""Scores and gates of regions and plans, as Column expressions over a region's figures.

A region has the columns area, quality, compactness, convexity, fragments, transit, short (shares), lines, mean_line,
along, across (metres) and seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .angles import clamp, num

#: Fixed values of the gates: (basic, practical).
LINE_FLOOR, CONVEXITY, COMPACTNESS, CAPTURE, TRANSIT, SCALE, NEAR_MISS = (8.0, 10.0), (0.56, 0.64), (8.5, 6.25), (0.12, 0.22), (1.0, 0.55), (0.35, 0.40), (0.10, 0.08)
LEAST_CHILD, LEAST_REST, MEAN_CONVEXITY, MOST_OF_TWO = 0.14, 0.22, 0.65, 0.88


def region_score(prefix: str = "") -> Column:
    """Quality with penalties for shape, fragments, transit, short lines and time."""
    c = lambda n: F.col(prefix + n)
    shape = 0.06 * F.greatest(F.lit(0.0), c("compactness") - 3.4) + 0.35 * F.greatest(F.lit(0.0), 0.75 - c("convexity"))
    return c("quality") + shape + 0.18 * c("fragments") + 0.28 * c("transit") + 0.12 * c("short") + c("seconds") / 55_000.0


def capture() -> Column:
    """The share of flight that captures: less fragments, transit and short lines, within [0, 1]."""
    return clamp(1 - 0.65 * F.col("fragments") - 0.85 * F.col("transit") - 0.45 * F.col("short"), 0, 1)


def gate_margins(whole: Column | float, practical: bool) -> Column:
    """map of what a region fails by, by gate; empty if it passes.

    Lines that are short by no more than the tolerance count as a failure only beside others.
    """
    k = int(practical)
    least = F.greatest(F.lit(LINE_FLOOR[k]), SCALE[k] * F.greatest(F.lit(1.0), F.col("along"), F.col("across")))
    missing = F.greatest(F.lit(0.0), least - F.col("mean_line"))
    margins = {
        "fraction": LEAST_CHILD - F.col("area") / F.greatest(F.lit(1.0), num(whole)),
        "lines": 1.0 - F.col("lines"),
        "convexity": CONVEXITY[k] - F.col("convexity"),
        "compactness": F.col("compactness") - COMPACTNESS[k],
        "capture": CAPTURE[k] - capture(),
    } | ({"transit": F.col("transit") - TRANSIT[k]} if practical else {})
    hard = F.map_filter(F.create_map(*[x for n, m in margins.items() for x in (F.lit(n), m.cast("double"))]), lambda _, m: m > 0)
    line = F.create_map(F.lit("mean_line"), missing)
    counts = (missing > 0) & ((missing > clamp(least * NEAR_MISS[k], 12, 30)) | (F.size(hard) > 0))
    return F.when(counts, F.map_concat(hard, line)).otherwise(hard)


def plan_gates(regions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, regions, largest, smallest, convexity, passes) of plans: shares of the area, mean convexity by area, and all gates."""
    whole = regions.groupBy(*keys).agg(F.sum("area").alias("__whole"))
    rated = regions.join(whole, keys).withColumn("__ok", F.size(gate_margins(F.col("__whole"), True)) == 0)
    p = rated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("regions"), (F.max("area") / F.first("__whole")).alias("largest"), (F.min("area") / F.first("__whole")).alias("smallest"),
        (F.sum(F.col("area") * F.col("convexity")) / F.sum("area")).alias("convexity"), F.bool_and("__ok").alias("__all"),
    )
    fine = (F.col("regions") > 1) & (1 - F.col("largest") >= LEAST_REST) & (F.col("smallest") >= LEAST_CHILD) & (F.col("convexity") >= MEAN_CONVEXITY)
    two = (F.col("regions") != 2) | (F.col("largest") <= MOST_OF_TWO)
    return p.withColumn("passes", fine & two & F.col("__all")).drop("__all")


def exact_cost(quality: Column, seconds: Column, time_weight: float = 0.1) -> Column:
    """Quality and time, in units of three minutes, in one."""
    return (1 - time_weight) * quality + time_weight * seconds / 180.0


def signature(*columns: Column | str) -> Column:
    """A stable name of a plan: sixteen hexadecimal digits of its figures."""
    return F.left(F.sha1(F.to_json(F.struct(*columns)).cast("binary")), F.lit(16))
