"""Searches for the best bearing of many regions at once: a round is one job over all of their candidates, whatever their number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import axial, axial_delta
from .search import cut

#: Bearings to begin with, offsets from a seed, and steps of the finer rounds; the least gain; rounds of one step.
GLOBAL, LOCAL, STEPS, GAIN, ROUNDS = tuple(range(0, 180, 15)), (-10.0, 0.0, 10.0), (8.0, 4.0, 2.0, 1.0), 1e-4, 12

Evaluate = Callable[[DataFrame], DataFrame]


def search(regions: DataFrame, keys: list[str], evaluate: Evaluate, seed: str | None = None, offsets: tuple[float, ...] = LOCAL, steps: tuple[float, ...] = STEPS, rounds: int = ROUNDS) -> DataFrame:
    """(keys, bearing, cost): the best bearing of every region, from coarse to fine.

    evaluate takes (keys, bearing) and gives them with a cost. Without a seed twelve bearings begin, with one those at its offsets; then
    a step to either side is tried and taken while it gains over GAIN, with ever smaller steps. Equal costs go to the lower
    bearing. A step is taken at most `rounds` times, so a search is a bounded number of jobs over tables of one row a region.
    """
    first = F.array(*[F.lit(float(b)) for b in GLOBAL]) if seed is None else F.array(*[axial(F.col(seed) + o) for o in offsets])
    cost = lambda df: evaluate(df.select(*keys, F.round("bearing", 3).alias("bearing")).distinct())
    best = lambda df: df.groupBy(*keys).agg(F.min(F.struct("cost", "bearing")).alias("b")).select(*keys, "b.bearing", "b.cost")
    at = best(cost(regions.select(*keys, F.explode(first).alias("bearing"))))
    for step in steps:
        # A walk of one step: its turning point is the best of the bearings on the way there, so it is looked at as a whole.
        reach = F.array(*[F.struct(F.lit(s * k).alias("k"), axial(F.col("bearing") + s * k * step).alias("b")) for s in (-1, 1) for k in range(1, rounds + 1)])
        tried = at.select(*keys, F.explode(reach).alias("t")).select(*keys, "t.k", F.round("t.b", 3).alias("bearing"))
        known = tried.join(cost(tried), [*keys, "bearing"])
        laid = at.join(known.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("cost", "bearing").alias("c")))).alias("__near")), keys)
        here = F.struct("cost", "bearing")

        def walk(now, k):
            place = lambda i: F.when(i == 0, here).otherwise(F.col("__near")[i])
            near = F.least(place(now - 1), place(now + 1))
            to = F.when(near == place(now - 1), now - 1).otherwise(now + 1)
            return F.when(near.isNotNull() & (place(now)["cost"] - near["cost"] > GAIN), to).otherwise(now)

        end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(0), walk)
        moved = laid.withColumn("__k", end).withColumn("__to", F.when(F.col("__k") == 0, here).otherwise(F.col("__near")[F.col("__k")]))
        at = cut(moved.select(*keys, F.col("__to.bearing").alias("bearing"), F.col("__to.cost").alias("cost")))
    return at


def basins(candidates: DataFrame, keys: list[str], most: int = 3, least: float = 30.0, window: float = 0.03) -> DataFrame:
    """(keys, bearings): the cheapest bearings of every region (bearing, cost) in order: within a window of the best, each apart from those before."""
    laid = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cost", "bearing"))).alias("__c"))
    none = F.transform(F.slice("__c", 1, 0), lambda c: c["bearing"])
    limit = F.get("__c", F.lit(0))["cost"] * (1 + window)

    def take(found, c):
        good = (F.size(found) < most) & ((c["cost"] <= limit) | (F.size(found) == 0)) & ~F.exists(found, lambda b: axial_delta(c["bearing"], b) < least)
        return F.when(good, F.concat(found, F.array(c["bearing"]))).otherwise(found)

    return laid.select(*keys, F.aggregate("__c", none, take).alias("bearings"))


def hotspots(candidates: DataFrame, keys: list[str], poses: str, enough: int = 300) -> DataFrame:
    """(keys, bearing, cost): bearings of a circle of candidates that cost no more than their neighbours, of regions with many poses; others have none."""
    w = Window.partitionBy(*keys).orderBy("bearing")
    whole = Window.partitionBy(*keys)
    ends = {f"__{n}": f(F.struct("bearing", "cost")).over(whole)["cost"] for n, f in (("first", F.min), ("last", F.max))}
    c = candidates.filter(F.col(poses) > enough).withColumns({"__before": F.lag("cost").over(w), "__after": F.lead("cost").over(w), **ends})
    low = (F.col("cost") <= F.coalesce("__before", "__last")) & (F.col("cost") < F.coalesce("__after", "__first"))
    return c.filter(low).select(*keys, "bearing", "cost")


def face_splits(cells: DataFrame, keys: list[str], angle_step: int = 15, fractions: tuple[float, ...] = (-0.35, -0.18, 0.0, 0.18, 0.35), penalty: float = 0.02) -> DataFrame:
    """(keys, angle, fraction, gain): the straight cut of each region that most lessens the mixture of its bearings.

    cells: x, y, area, bearing. Cuts at every angle through fractions of the half width from the middle; a region's mixture is its area's
    mean squared sine about its axis; a cut has to leave a tenth on either side. Every cell meets every cut of its region once.
    """
    t = F.radians(2 * F.col("bearing"))
    c = cells.select(*keys, "x", "y", "area", (F.cos(t) * F.col("area")).alias("__c"), (F.sin(t) * F.col("area")).alias("__s"))
    c = c.withColumn("angle", F.explode(F.sequence(F.lit(0), F.lit(179), F.lit(angle_step))))
    place = F.col("x") * F.cos(F.radians("angle")) - F.col("y") * F.sin(F.radians("angle"))
    w = Window.partitionBy(*keys, "angle")
    c = c.withColumn("__p", place).withColumns({"__lo": F.min("__p").over(w), "__hi": F.max("__p").over(w)})
    c = c.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    left = F.col("__p") <= (F.col("__lo") + F.col("__hi")) / 2 + F.col("fraction") * (F.col("__hi") - F.col("__lo")) / 2
    side = lambda v, test: F.sum(F.when(test, F.col(v)).otherwise(0.0))
    sums = c.groupBy(*keys, "angle", "fraction").agg(*[side(v, test).alias(f"{n}{v}") for n, test in (("l", left), ("r", ~left)) for v in ("area", "__c", "__s")])
    mixed = lambda a, b, s: (F.col(a) if isinstance(a, str) else a) - F.hypot(b, s)
    whole = F.col("larea") + F.col("rarea")
    before = mixed(whole, F.col("l__c") + F.col("r__c"), F.col("l__s") + F.col("r__s"))
    after = mixed("larea", F.col("l__c"), F.col("l__s")) + mixed("rarea", F.col("r__c"), F.col("r__s"))
    found = sums.filter(F.least("larea", "rarea") >= 0.1 * whole).withColumn("gain", F.round((before - after) / (2 * whole) - penalty, 9))
    best = found.groupBy(*keys).agg(F.min(F.struct((-F.col("gain")).alias("g"), "angle", "fraction")).alias("b"))
    return best.select(*keys, "b.angle", "b.fraction", (-F.col("b.g")).alias("gain"))


def face_partition(cells: DataFrame, keys: list[str], most: int = 4, least: float = 0.03) -> DataFrame:
    """cells with `leaf`: areas cut where that gains most, the best leaf first, into `most` leaves at most; a leaf's name is its path of sides.

    Each round looks at all leaves of all areas in one job, and cuts one leaf of each area; it ends when no cut gains `least`.
    """
    out = cells.withColumn("leaf", F.lit("0"))
    for _ in range(most - 1):
        best = face_splits(out, [*keys, "leaf"]).filter(F.col("gain") >= least)
        chosen = best.groupBy(*keys).agg(F.min(F.struct((-F.col("gain")).alias("g"), "leaf", "angle", "fraction")).alias("__b"))
        spans = out.join(chosen, keys).filter(F.col("leaf") == F.col("__b.leaf"))
        place = F.col("x") * F.cos(F.radians("__b.angle")) - F.col("y") * F.sin(F.radians("__b.angle"))
        edge = spans.groupBy(*keys).agg(F.first("__b").alias("__cut"), F.min(place).alias("__lo"), F.max(place).alias("__hi"))
        on = F.col("x") * F.cos(F.radians("__cut.angle")) - F.col("y") * F.sin(F.radians("__cut.angle"))
        side = F.when(on <= (F.col("__lo") + F.col("__hi")) / 2 + F.col("__cut.fraction") * (F.col("__hi") - F.col("__lo")) / 2, "l").otherwise("r")
        out = cut(out.join(edge, keys, "left").withColumn("leaf", F.when(F.col("leaf") == F.col("__cut.leaf"), F.concat("leaf", side)).otherwise(F.col("leaf"))).drop("__cut", "__lo", "__hi"))
    return out


def merge_leaves(leaves: DataFrame, borders: DataFrame, keys: list[str], slack: float = 0.01, rounds: int = 3) -> DataFrame:
    """(keys, leaf, merged): leaves that are side by side and as good as one, joined, one pair of every area a round, the best pair first.

    leaves: keys, leaf, area, c, s (sums of cos and sin of doubled bearings by area); borders: keys, left, right.
    """
    leaves, borders = cut(leaves), cut(borders)
    names = leaves.select(*keys, "leaf", F.col("leaf").alias("merged"))
    for _ in range(rounds):
        now = leaves.join(names, [*keys, "leaf"]).groupBy(*keys, "merged").agg(*[F.sum(c).alias(c) for c in ("area", "c", "s")])
        to = lambda n: names.select(*keys, F.col("leaf").alias(n), F.col("merged").alias(f"__{n}"))  # noqa: B023, E731
        pairs = borders.join(to("left"), [*keys, "left"]).join(to("right"), [*keys, "right"]).select(*keys, F.least("__left", "__right").alias("a"), F.greatest("__left", "__right").alias("b")).filter("a <> b").distinct()
        own = lambda n: now.select(*keys, F.col("merged").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("area", "c", "s")])  # noqa: B023, E731
        both = pairs.join(own("a"), [*keys, "a"]).join(own("b"), [*keys, "b"])
        loss = F.hypot("a_c", "a_s") + F.hypot("b_c", "b_s") - F.hypot(F.col("a_c") + F.col("b_c"), F.col("a_s") + F.col("b_s"))
        both = both.withColumn("loss", F.round(loss / (2 * (F.col("a_area") + F.col("b_area"))), 9)).filter(F.col("loss") <= slack)
        best = both.groupBy(*keys).agg(F.min(F.struct("loss", "a", "b")).alias("__p"))
        names = cut(names.join(best, keys, "left").withColumn("merged", F.when(F.col("merged") == F.col("__p.b"), F.col("__p.a")).otherwise(F.col("merged"))).drop("__p"))
    return names
