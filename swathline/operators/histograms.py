"""Area-weighted histograms: built from values by group, merged, and asked for quantiles and areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .weighted import finite

BINS, LEAST_WIDTH, ACRE = 20, 0.01, 4046.8564224
STATS = "min, max, mean, count, area, histogram: array<struct<bin, count, area>>"


def _collect(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Non-empty bins of a group as one array by centre; 20 at most."""
    return bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", F.col("n").alias("count"), F.col("a").alias("area")))).alias("histogram"))


def value_stats(df: DataFrame, keys: list[str], value: str, area: str, density: bool = False) -> DataFrame:
    """Statistics of positive values (for density: of all, others as 0) by group, with a histogram of 20 even bins.

    Resolution (density False): the mean counts rows; bins are at least 0.01 wide, in whole numbers. Density: the mean
    weighs areas; zeros are a bin of their own and the positive values have 19. Two aggregations: extrema, then bins.
    """
    v = F.col(value).cast("double")
    v = F.when(finite(v) & (v > 0), v)
    rows = df.select(*keys, (F.coalesce(v, F.lit(0.0)) if density else v).alias("v"), F.col(area).alias("a")).filter("v IS NOT NULL")
    positive = F.when(F.col("v") > 0, F.col("v"))
    mean = F.sum(F.col("v") * F.col("a")) / F.sum("a") if density else F.avg("v")
    stats = rows.groupBy(*keys).agg(F.min("v").alias("min"), F.max("v").alias("max"), mean.alias("mean"), F.count(F.lit(1)).alias("count"), F.sum("a").alias("area"), F.min(positive).alias("least"), F.max(F.col("v") == 0).alias("zeros"))
    span = F.col("max") - F.col("least")
    if density:
        n = F.when(F.col("zeros"), BINS - 1).otherwise(BINS)
    else:
        n = F.when(span / BINS < LEAST_WIDTH, F.greatest(F.lit(1), F.floor(span / LEAST_WIDTH))).otherwise(BINS)
    stats = stats.withColumn("n_bins", F.when(span > 0, n).otherwise(1)).withColumn("width", F.when(span > 0, span / F.col("n_bins")))
    at = F.least(F.floor((F.col("v") - F.col("least")) / F.col("width")), F.col("n_bins") - 1)
    centre = F.when(F.col("v") == 0, 0.0).when(F.col("width").isNull(), F.col("least")).otherwise(F.col("least") + (at + 0.5) * F.col("width"))
    bins = rows.join(stats.select(*keys, "least", "width", "n_bins"), keys).groupBy(*keys, centre.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"))
    return stats.select(*keys, "min", "max", "mean", "count", "area").join(_collect(bins, keys), keys)


def merge_stats(stats: DataFrame, keys: list[str], tail_acres: float = 1.0) -> DataFrame:
    """Statistics of parts as those of the whole, by coarser keys.

    Means weigh areas (counts where there is none). Bins of the parts fall by their centres into 20 even ones over the
    whole range, or 19 and one of zeros where the least value is 0. min and max become the centres of the bins
    at which an acre has been passed from either end, if the whole has more than two such tails.
    """
    good = stats.filter((F.col("count") > 0) & finite(F.col("min")) & finite(F.col("max")) & (F.col("max") > 0))
    weight = F.when(F.col("area") > 0, F.col("area")).otherwise(F.col("count"))
    bins = good.select(*keys, F.explode("histogram").alias("h"))
    own = bins.groupBy(*keys).agg(F.coalesce(F.sum(F.when((F.col("h.bin") == 0) & (F.col("h.area") > 0), F.col("h.area"))), F.lit(0.0)).alias("zero"), F.min(F.when(F.col("h.bin") > 0, F.col("h.bin"))).alias("least_bin"))
    whole = good.groupBy(*keys).agg(F.min("min").alias("min"), F.max("max").alias("max"), (F.sum(F.col("mean") * weight) / F.sum(weight)).alias("mean"), F.sum("count").alias("count"), F.sum(weight).alias("area"))
    whole = whole.join(own, keys).withColumn("zeros", (F.col("zero") > 0) & (F.col("min") == 0))
    whole = whole.withColumn("start", F.when(F.col("zeros"), F.col("least_bin")).otherwise(F.col("min"))).withColumn("n_bins", F.when(F.col("zeros"), BINS - 1).otherwise(BINS))
    whole = whole.withColumn("width", (F.col("max") - F.col("start")) / F.col("n_bins"))
    h, flat = F.col("h"), ~(F.col("max") > F.col("min"))
    at = F.greatest(F.lit(0), F.least(F.floor((h["bin"] - F.col("start")) / F.when(F.col("width") > 0, F.col("width"))), F.col("n_bins") - 1))
    centre = F.when(flat, F.col("min")).when(F.col("zeros") & (h["bin"] == 0), 0.0).otherwise(F.col("start") + (F.coalesce(at, F.lit(0)) + 0.5) * F.col("width"))
    placed = bins.filter("h.count > 0").join(whole, keys).groupBy(*keys, centre.alias("bin")).agg(F.sum("h.count").alias("n"), F.sum(F.coalesce("h.area", F.lit(0.0))).alias("a"))
    both = whole.select(*keys, "min", "max", "mean", "count", "area").join(_collect(placed, keys), keys)
    tail = tail_acres * ACRE

    def reach(bins: Column) -> Column:
        """The first bin at which the running area reaches the tail."""
        run = F.aggregate(bins, F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at")),
                          lambda s, b: F.struct((s["sum"] + b["area"]).alias("sum"), F.coalesce(s["at"], F.when(s["sum"] + b["area"] >= tail, b["bin"])).alias("at")))
        return run["at"]

    total = F.aggregate("histogram", F.lit(0.0), lambda s, b: s + b["area"])
    low, high = reach(F.col("histogram")), reach(F.reverse("histogram"))
    trims = (total > 2 * tail) & (tail > 0) & (high > low) & (F.col("max") > F.col("min"))
    return both.withColumns({"min": F.when(trims, low).otherwise(F.col("min")), "max": F.when(trims, high).otherwise(F.col("max"))})


def bin_edges(histogram: Column, low: Column, high: Column) -> Column:
    """Array of struct<bin, area, lo, hi>: halfway between centres, the ends as far beyond as within; a lone bin spans min to max."""
    used = F.filter(histogram, lambda b: b["area"] > 0)
    n = F.size(used)
    centre = lambda i: F.get(used, i)["bin"]

    def edge(b: Column, i: Column) -> Column:
        lo = F.when(i > 0, (centre(i - 1) + b["bin"]) / 2).otherwise(b["bin"] - (centre(i + 1) - b["bin"]) / 2)
        hi = F.when(i < n - 1, (centre(i + 1) + b["bin"]) / 2).otherwise(b["bin"] + (b["bin"] - centre(i - 1)) / 2)
        first, last = F.least(low, b["bin"]), F.greatest(high, b["bin"])
        only = n == 1
        return F.struct(b["bin"].alias("bin"), b["area"].alias("area"), F.when(only, first).otherwise(lo).alias("lo"), F.when(only, F.when(last > first, last).otherwise(first + 1)).otherwise(hi).alias("hi"))

    return F.transform(used, edge)


def total_area(area: Column, histogram: Column) -> Column:
    return F.when(area > 0, area).otherwise(F.aggregate(histogram, F.lit(0.0), lambda s, b: s + F.coalesce(b["area"], F.lit(0.0))))


def area_below(edges: Column, threshold: Column) -> Column:
    """Of bin_edges: the area under a value, linear within a bin."""
    part = lambda b: F.when(b["hi"] > b["lo"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), (threshold - b["lo"]) / (b["hi"] - b["lo"])))).otherwise(F.when(threshold >= b["bin"], 1.0).otherwise(0.0))
    return F.aggregate(edges, F.lit(0.0), lambda s, b: s + b["area"] * part(b))


def quantile(edges: Column, area: Column, q: float) -> Column:
    """Of bin_edges: the value under which q of the area lies, linear within the bin that reaches it; 0 without bins."""
    target = min(1.0, max(0.0, q)) * area
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))

    def step(s: Column, b: Column) -> Column:
        after = s["sum"] + b["area"]
        within = b["lo"] + (b["hi"] - b["lo"]) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (target - s["sum"]) / b["area"]))
        return F.struct(after.alias("sum"), F.coalesce(s["at"], F.when(target <= after, F.when(b["hi"] > b["lo"], within).otherwise(b["bin"]))).alias("at"))

    found = F.aggregate(edges, start, step)["at"]
    last = F.element_at(edges, -1)
    return F.when((area > 0) & (F.size(edges) > 0), F.coalesce(found, last["hi"])).otherwise(0.0)


def weigh(signals: dict[str, Column], weights: dict[str, float]) -> dict[str, Column]:
    """A score's breakdown: maps of signals, weights and contributions, and their total."""
    total = sum((signals[k] * w for k, w in weights.items()), F.lit(0.0))
    as_map = lambda f: F.create_map(*[x for k in weights for x in (F.lit(k), f(k))])
    return {"signals": as_map(lambda k: signals[k]), "weights": as_map(lambda k: F.lit(weights[k])), "contributions": as_map(lambda k: signals[k] * weights[k]), "total": total}


def _short(value: Column, target: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - value / F.greatest(F.lit(1e-6), target))


def lidar_score(target: Column, edges: Column, area: Column, mean: Column) -> dict[str, Column]:
    whole = F.greatest(F.lit(1.0), area)
    hole = F.greatest(F.lit(5.0), target * 0.2)
    weak = F.greatest(hole + 1e-6, target * 0.7)
    signals = {"holes": area_below(edges, hole) / whole, "low": area_below(edges, weak) / whole, "q10": _short(quantile(edges, area, 0.1), target), "q25": _short(quantile(edges, area, 0.25), target), "mean": _short(mean, target)}
    return weigh(signals, {"holes": 4.2, "low": 2.4, "q10": 1.9, "q25": 1.2, "mean": 0.8})


def camera_score(target: Column, edges: Column, area: Column, mean: Column, high: Column) -> dict[str, Column]:
    whole = F.greatest(F.lit(1.0), area)
    over = lambda v: F.greatest(F.lit(0.0), v / F.greatest(F.lit(1e-6), target) - 1)
    signals = {"q90": over(quantile(edges, area, 0.9)), "over": F.greatest(F.lit(0.0), whole - area_below(edges, target)) / whole, "mean": over(mean), "q75": over(quantile(edges, area, 0.75)), "max": over(high)}
    return weigh(signals, {"q90": 1.85, "over": 1.25, "mean": 0.95, "q75": 0.55, "max": 0.2})
