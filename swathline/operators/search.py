"""Choosing among plans: skylines, thinning, picks, splits, components and the order of areas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import axial_delta


def skyline(plans: DataFrame, keys: list[str], time: str, quality: str, parts: int = 32) -> DataFrame:
    """Plans that no other of their group equals or beats in both and beats in one.

    In order of time, then quality, a plan stays if its quality is below the best of all earlier ones; equal plans stay
    together. Window passes in place of comparing pairs: first over each of `parts` parts of a group, dealt by a hash of both
    figures, then over what is left of it, so that no task sorts a large group.
    """

    def pass_over(p: DataFrame, by: list) -> DataFrame:
        earlier = Window.partitionBy(*by).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
        p = p.withColumns({"__before": F.min(quality).over(earlier), "__now": F.min(quality).over(Window.partitionBy(*by, time))})
        stays = (F.col(quality) == F.col("__now")) & (F.col("__before").isNull() | (F.col(quality) < F.col("__before")))
        return p.filter(stays).drop("__before", "__now")

    dealt = plans.withColumn("__part", F.pmod(F.xxhash64(time, quality), F.lit(parts)))
    return pass_over(pass_over(dealt, [*keys, "__part"]).drop("__part"), keys)


def thin(plans: DataFrame, keys: list[str], count: str, time: str, quality: str, each: int = 5, most: int = 20) -> DataFrame:
    """Of each group: by number of regions the fastest and the `each` best, then the `most` best of those."""
    by_quality = [F.col(quality), F.col(time), F.col("plan")]
    w = Window.partitionBy(*keys, count)
    p = plans.withColumns({"__q": F.row_number().over(w.orderBy(*by_quality)), "__t": F.row_number().over(w.orderBy(time, quality, "plan"))})
    p = p.filter((F.col("__q") <= each) | (F.col("__t") == 1))
    return p.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by_quality))).filter(F.col("__r") <= most).drop("__q", "__t", "__r")


def best(candidates: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The candidate of least score by group, ties to the first; one aggregation."""
    rest = [c for c in candidates.columns if c not in keys]
    return candidates.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(score, tie)).alias("b")).select(*keys, "b.*")


def roll_up(regions: DataFrame, keys: list[str], gap: float = 45.0, each: float = 0.02) -> DataFrame:
    """Plans from regions (area, quality, time): area-weighted quality and 0.02 a further region, time and a gap between."""
    n = F.count(F.lit(1))
    return regions.groupBy(*keys).agg(
        n.alias("regions"), (F.sum(F.col("area") * F.col("quality")) / F.sum("area") + each * (n - 1)).alias("quality"), (F.sum("time") + gap * (n - 1)).alias("time"), (F.max("area") / F.sum("area")).alias("largest"), (F.min("area") / F.sum("area")).alias("smallest")
    )


def split_at(cells: DataFrame, keys: list[str], along: str, weight: str, q: float) -> DataFrame:
    """cells with `left`: whether their place along the axis is at most the weighted q-quantile of their group."""
    from .weighted import weighted_quantiles

    cut = weighted_quantiles(cells, keys, along, weight, {"__cut": q})
    return cells.join(cut, keys).withColumn("left", F.col(along) <= F.col("__cut")).drop("__cut")


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir, where its lineage ends; without one, on a single machine, it is kept as it is."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return df.cache()
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable; nodes without edges are alone.

    Labels jump: each round takes the least label around, and then the label of that label, so rounds grow with
    the logarithm of a path. A round is a written table.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = nodes.select(F.col("node"), F.col("node").alias("component"))
    before = None
    for _ in range(most):
        around = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        labels = labels.join(around, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = cut(labels.join(jump, "component").select("node", F.col("further").alias("component")))
        state = tuple(labels.agg(F.sum(F.col("component").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("node", "component"))).first())
        if state == before:
            return labels
        before = state
    raise RuntimeError("labels did not settle")


def apart(angles: list[tuple[float, float]], least: float, most: int, period: float = 180.0) -> list[float]:
    """Greedy pick of (angle, cost) by cost, each at least so far from those picked; a few dozen candidates on the driver."""
    picked: list[float] = []
    for angle, _ in sorted(angles, key=lambda x: x[1]):
        turn = lambda b: abs((angle - b) % period)  # noqa: B023, E731
        if all(min(turn(b), period - turn(b)) >= least for b in picked):
            picked.append(angle)
        if len(picked) == most:
            break
    return picked


def fine_search(evaluate, start: list[float], steps: tuple[float, ...] = (8.0, 4.0, 2.0, 1.0), gain: float = 1e-4) -> tuple[float, float]:
    """(bearing, cost): the best of some bearings, then better ones a step to either side, with ever smaller steps.

    evaluate takes a list of bearings and gives a dict of costs: one Spark job a round for all of its candidates.
    """
    known = evaluate([b % 180 for b in start])
    at = min(known, key=lambda b: (known[b], b))
    for step in steps:
        while True:
            new = [b for b in ((at - step) % 180, (at + step) % 180) if b not in known]
            if new:
                known |= evaluate(new)
            to = min(((at - step) % 180, (at + step) % 180), key=lambda b: (known[b], b))
            if known[at] - known[to] <= gain:
                break
            at = to
    return at, known[at]


def boundary(cells: DataFrame, edges: DataFrame, side: str, step: float, keys: list[str]) -> DataFrame:
    """(keys, length, weight) of the edges between two sides of each group's split: they weigh more where terrain breaks and turns."""
    c = cells.select("cell", side, "strength", "aspect", "bearing")
    at = lambda k: c.select(*[F.col(x).alias(k if x == "cell" else f"{k}_{x}") for x in c.columns])
    both = edges.join(at("a"), "a").join(at("b"), "b").filter(F.col(f"a_{side}") != F.col(f"b_{side}"))
    turn = F.least(F.abs(F.col("a_aspect") - F.col("b_aspect")), 360 - F.abs(F.col("a_aspect") - F.col("b_aspect")))
    weight = step * (0.55 * (F.col("a_strength") + F.col("b_strength")) / 2 + 0.3 * turn + 0.15 * axial_delta(F.col("a_bearing"), F.col("b_bearing")))
    return both.groupBy(*keys).agg((F.count(F.lit(1)) * step).alias("length"), F.sum(weight).alias("weight"))


def ranked(entries: DataFrame, keys: list[str], name: str, value: str, most: int = 8) -> DataFrame:
    """The largest positive finite entries of each group, rounded to whole numbers, with their share of the group's sum."""
    from .weighted import finite

    good = entries.filter(finite(F.col(value)) & (F.col(value) > 0)).withColumn("rounded", F.floor(F.col(value) + 0.5))
    whole = Window.partitionBy(*keys)
    good = good.withColumn("share", F.col(value) / F.sum(value).over(whole))
    return good.withColumn("place", F.row_number().over(whole.orderBy(F.desc("rounded"), name))).filter(F.col("place") <= most).select(*keys, "place", name, "rounded", "share")


def combined(left: DataFrame, right: DataFrame, keys: list[str], most: int = 8, gap: float = 45.0) -> DataFrame:
    """Plans of two halves of a split joined into plans of the whole: areas and times add up, quality weighs areas.

    Halves meet by their split alone, each with a thinned frontier of a known size; plans of over `most` regions go.
    """
    r = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in ("plan", "regions", "area", "quality", "time")])
    both = left.join(r, keys).filter(F.col("regions") + F.col("r_regions") <= most)
    area = F.col("area") + F.col("r_area")
    return both.select(
        *keys, "plan", "r_plan", (F.col("regions") + F.col("r_regions")).alias("regions"), area.alias("area"), ((F.col("quality") * F.col("area") + F.col("r_quality") * F.col("r_area")) / area + 0.02).alias("quality"), (F.col("time") + F.col("r_time") + gap).alias("time")
    )
