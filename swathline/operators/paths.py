"""Ordered points as paths: lengths, speeds, islands, triggers, profiles and transfer costs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import num
from ..functions.geo import MAP_RADIUS, destination, haversine, initial_bearing, local_xy


def steps(path: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each point (lng, lat, alt) with the one before as p_lng, p_lat, p_alt and the metres between; the first has nulls and 0.

    One shuffle by keys; every further operator of this module that keeps the keys reuses its order.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = {f"p_{c}": F.lag(c).over(w) for c in ("lng", "lat", "alt")}
    path = path.withColumns(before)
    return path.withColumn("metres", F.coalesce(haversine(F.col("p_lng"), F.col("p_lat"), F.col("lng"), F.col("lat")), F.lit(0.0)))


def running(path: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """steps with the distance at the start and the end of each."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    path = steps(path, keys, order).withColumn("distance", F.sum("metres").over(w))
    return path.withColumn("start", F.col("distance") - F.col("metres"))


def islands(lines: DataFrame, keys: list[str], order: list[str], sweep: str) -> DataFrame:
    """Consecutive rows of one sweep as islands: number from 0, and whether it is flown forward, which alternates."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(sweep).over(w).eqNullSafe(F.col(sweep)) | (F.row_number().over(w) == 1), 0).otherwise(1)
    lines = lines.withColumn("__new", new)
    island = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("island", island).withColumn("forward", F.col("island") % 2 == 0).drop("__new")


def triggers(path: DataFrame, keys: list[str], order: list[str], spacing: float) -> DataFrame:
    """Camera positions along paths: the first point, every multiple of the spacing, and the end if that is over a quarter of it on.

    keys, seq, lng, lat, alt, bearing. Multiples within a step come from an explosion of that step alone; the bearing
    is that of the step. Paths of one point have no position.
    """
    w, back = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    p = running(path, keys, order).withColumns({"__i": F.row_number().over(w), "__last": F.row_number().over(back) == 1})
    p = p.filter("__i > 1").withColumn("bearing", initial_bearing(F.col("p_lng"), F.col("p_lat"), F.col("lng"), F.col("lat")))
    lo, hi = F.floor(F.col("start") / spacing).cast("long") + 1, F.floor(F.col("distance") / spacing).cast("long")
    at = lambda k: F.when(F.col("metres") > 0, (k * spacing - F.col("start")) / F.col("metres")).otherwise(0.0)
    mid = lambda c, k: F.col(f"p_{c}") + (F.col(c) - F.col(f"p_{c}")) * at(k)
    spot = lambda seq, *cs: F.struct(seq.cast("double").alias("seq"), *[c.alias(n) for n, c in zip(("lng", "lat", "alt"), cs, strict=True)])
    first = F.when(F.col("__i") == 2, F.array(spot(F.lit(0.0), F.col("p_lng"), F.col("p_lat"), F.col("p_alt"))))
    inner = F.when(lo <= hi, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda k: spot(k, mid("lng", k), mid("lat", k), mid("alt", k))))
    none = F.array().cast("array<struct<seq:double,lng:double,lat:double,alt:double>>")
    # The last position before the end is the last multiple, or the first point: on a path, so its distance is what is left.
    left = F.col("distance") - F.greatest(hi, F.lit(0)) * spacing
    end = F.when(F.col("__last") & (left > 0.25 * spacing), F.array(spot(F.lit(math.inf), F.col("lng"), F.col("lat"), F.col("alt"))))
    found = p.select(*keys, "bearing", F.explode(F.concat(*[F.coalesce(c, none) for c in (first, inner, end)])).alias("s"))
    seq = F.row_number().over(Window.partitionBy(*keys).orderBy("s.seq")) - 1
    return found.select(*keys, seq.alias("seq"), "s.lng", "s.lat", "s.alt", "bearing")


def profile_summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Length, samples, and extrema and mean of the clearances that are known and finite."""
    c = F.when(~F.isnan("clearance") & (F.abs("clearance") < math.inf), F.col("clearance"))
    return samples.groupBy(*keys).agg(F.max("distance").alias("total"), F.min(c).alias("least"), F.avg(c).alias("mean"), F.max(c).alias("most"), F.count(F.lit(1)).alias("samples"))


def decimate(samples: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """At most about `most` samples of a profile (distance, terrain, clearance): of every bucket the first, the last and the extrema.

    Buckets are even over the length, and a sample on the border of two is looked at in both. Profiles that are short
    enough stay whole.
    """
    buckets = max(1, most // 4)
    w = Window.partitionBy(*keys)
    s = samples.withColumns({"__n": F.count(F.lit(1)).over(w), "__total": F.max("distance").over(w), "__first": F.min(order).over(w), "__end": F.max(order).over(w)})
    width = F.col("__total") / buckets
    at = F.floor(F.col("distance") / width)
    at = F.least(F.when(at * width > F.col("distance"), at - 1).otherwise(at), F.lit(buckets - 1)).cast("int")  # a quotient may be rounded up to the border
    on_border = (at > 0) & (F.col("distance") <= at * width)
    s = s.withColumn("__b", F.explode(F.when(F.col("__total") > 0, F.when(on_border, F.array(at - 1, at)).otherwise(F.array(at))).otherwise(F.array(F.lit(0)))))
    b = Window.partitionBy(*keys, "__b")
    keep = (F.col(order) == F.min(order).over(b)) | (F.col(order) == F.max(order).over(b)) | (F.col(order) == F.col("__first")) | (F.col(order) == F.col("__end")) | (F.col("__n") <= most)
    for c in ("terrain", "clearance"):
        for up in (F.col(c), -F.col(c)):
            best = F.min(F.when(up.isNotNull(), F.struct(up.alias("v"), F.col(order).alias("i")))).over(b)["i"]
            keep = keep | F.coalesce(F.col(order) == best, F.lit(False))
    return s.withColumn("__keep", keep).filter("__keep").select(*samples.columns).dropDuplicates([*keys, order])


def clip(samples: DataFrame, keys: list[str], start: float, end: float) -> DataFrame:
    """Samples within a range of distances; where there are under two, also the nearest before and after. Fewer than two in all: none."""
    w = Window.partitionBy(*keys)
    inside = F.col("distance").between(start, end)
    s = samples.withColumns({"__in": inside, "__n": F.sum(F.when(inside, 1).otherwise(0)).over(w), "__lo": F.max(F.when(F.col("distance") < start, F.col("distance"))).over(w), "__hi": F.min(F.when(F.col("distance") > end, F.col("distance"))).over(w)})
    s = s.filter(F.col("__in") | ((F.col("__n") < 2) & ((F.col("distance") == F.col("__lo")) | (F.col("distance") == F.col("__hi")))))
    return s.withColumn("__all", F.count(F.lit(1)).over(w)).filter("__all >= 2").select(*samples.columns)


def spacing_bucket(spacing: Column) -> Column:
    """The next of 1, 2, 5 times a power of ten; 1 for what isn't positive."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(spacing)))
    part = spacing / base
    return F.when(spacing > 0, base * F.when(part <= 1, 1.0).when(part <= 2, 2.0).when(part <= 5, 5.0).otherwise(10.0)).otherwise(1.0)


def segment_seconds(metres: Column, climb: Column, speed: float = 16.0, up: float = 4.0, down: float = 3.0) -> Column:
    """The slowest of flying, climbing and descending."""
    return F.greatest(metres / speed, F.greatest(climb, F.lit(0.0)) / up, F.greatest(-climb, F.lit(0.0)) / down)


def transfer_cost(path: DataFrame, keys: list[str], order: list[str], speed: float = 16.0, up: float = 4.0, down: float = 3.0) -> DataFrame:
    """Length, seconds and energy-weighted cost of each path: level time, and 2.5 times the climb's and 0.6 times the descent's."""
    s = steps(path, keys, order)
    rise = F.coalesce(F.col("alt") - F.col("p_alt"), F.lit(0.0))
    cost = F.col("metres") / speed + 2.5 * F.greatest(rise, F.lit(0.0)) / up + 0.6 * F.greatest(-rise, F.lit(0.0)) / down
    return s.groupBy(*keys).agg(F.sum("metres").alias("metres"), F.sum(segment_seconds(F.col("metres"), rise, speed, up, down)).alias("seconds"), F.sum(cost).alias("cost"))


def connector(along: Column, cross: Column, radius: Column | float) -> Column:
    """Metres from one sweep's end to the next one's start: a half turn and what lies between."""
    r = num(radius)
    return math.pi * r + F.hypot(along, F.greatest(F.lit(0.0), cross - 2 * r))


def triggers_flat(lines: DataFrame, keys: list[str], spacing: float) -> DataFrame:
    """Camera positions along straight lines (lng1, lat1, lng2, lat2): the start, every multiple of the spacing on the great circle, the end.

    keys, seq, lng, lat. A line without length has its start alone.
    """
    total = haversine(F.col("lng1"), F.col("lat1"), F.col("lng2"), F.col("lat2"))
    b = lines.withColumns({"__total": total, "__bearing": initial_bearing(F.col("lng1"), F.col("lat1"), F.col("lng2"), F.col("lat2"))})
    last = (F.ceil(F.col("__total") / spacing)).cast("int")
    p = b.withColumn("seq", F.explode(F.when(F.col("__total") > 0, F.sequence(F.lit(0), last)).otherwise(F.array(F.lit(0)))))
    lng, lat = destination(F.col("lng1"), F.col("lat1"), F.col("__bearing"), F.col("seq") * spacing)
    first, end = F.col("seq") == 0, F.col("seq") == last
    at = lambda a, mid, z: F.when(first, F.col(a)).when(end, F.col(z)).otherwise(mid)
    return p.select(*keys, "seq", at("lng1", lng, "lng2").alias("lng"), at("lat1", lat, "lat2").alias("lat"))


def triggers_in_fragments(steps_: DataFrame, keys: list[str], order: str, spacing: float) -> DataFrame:
    """(keys, seq, distance): positions along broken lines: distances run on over gaps, and there are none within them.

    steps_: keys, order, metres, gap (whether the step crosses a gap). Positions are the multiples of the spacing within steps that
    are no gap, those at a step's start left to the step before.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = steps_.withColumn("__end", F.sum("metres").over(w)).withColumn("__start", F.col("__end") - F.col("metres")).filter("NOT gap AND metres > 0")
    lo, hi = F.floor(F.col("__start") / spacing).cast("long") + 1, F.floor(F.col("__end") / spacing).cast("long")
    found = s.filter(lo <= hi).withColumn("__k", F.explode(F.sequence(lo, hi)))
    return found.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("__k")) - 1).alias("seq"), (F.col("__k") * spacing).alias("distance"))


def corridor(points: DataFrame, keys: list[str], padding: float = 90.0) -> DataFrame:
    """(keys, west, south, east, north): the box, in degrees, around a connection's points (seq, lng, lat) and so many metres more."""
    ref = points.groupBy(*keys).agg(F.min_by(F.struct("lng", "lat"), F.col("seq")).alias("__o"))
    p = points.join(ref, keys)
    east, north = local_xy(F.col("lng"), F.col("lat"), F.col("__o.lng"), F.col("__o.lat"))
    b = p.withColumns({"__e": east, "__n": north}).groupBy(*keys).agg(F.first("__o").alias("o"), *[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("__e", "__n")])
    lng = lambda e: F.col("o.lng") + F.degrees(e / (MAP_RADIUS * F.cos(F.radians("o.lat"))))
    lat = lambda n: F.col("o.lat") + F.degrees(n / MAP_RADIUS)
    return b.select(*keys, lng(F.col("lo__e") - padding).alias("west"), lat(F.col("lo__n") - padding).alias("south"), lng(F.col("hi__e") + padding).alias("east"), lat(F.col("hi__n") + padding).alias("north"))


def mission_summary(areas: DataFrame, connectors: DataFrame, keys: list[str]) -> DataFrame:
    """Metres and seconds of areas (metres, speed) and of connectors (metres, seconds) of each mission, and in all."""
    a = areas.groupBy(*keys).agg(F.sum("metres").alias("area_metres"), F.sum(F.when(F.col("speed") > 0, F.col("metres") / F.col("speed")).otherwise(0.0)).alias("area_seconds"))
    c = connectors.groupBy(*keys).agg(F.sum("metres").alias("connector_metres"), F.sum("seconds").alias("connector_seconds"))
    both = a.join(c, keys, "left").fillna(0.0, ["connector_metres", "connector_seconds"])
    return both.withColumns({"metres": F.col("area_metres") + F.col("connector_metres"), "seconds": F.col("area_seconds") + F.col("connector_seconds")})


def planned_summary(fragments: DataFrame, keys: list[str], sweep: str) -> DataFrame:
    """Lines, fragments, gaps, lengths, connectors and turns of planned lines (sweep, part, metres, gap, connector) of each area."""
    sweeps = fragments.groupBy(*keys, sweep).agg(F.count(F.lit(1)).alias("parts"), F.sum("metres").alias("metres"), F.sum("gap").alias("gap"), F.max("connector").alias("connector"))
    n = F.count(F.lit(1))
    flown = F.sum(F.col("metres") + F.col("gap")) + F.sum("connector")
    s = sweeps.groupBy(*keys).agg(n.alias("lines"), F.sum(F.col("parts") - 1).alias("fragments"), F.sum("gap").alias("gaps"), F.sum(F.col("metres") + F.col("gap")).alias("length"), flown.alias("path"), F.sum("connector").alias("connectors"), (n - 1).alias("turns"))
    return s.withColumns({"transit": F.when(F.col("path") > 0, F.col("connectors") / F.col("path")).otherwise(0.0), "broken": F.col("fragments") / F.col("lines")})


def transfer_band(segments: DataFrame, keys: list[str], terrain, clearance: float, height: float, spacing: float = 30.0, slack: float = 0.5) -> DataFrame:
    """(keys, samples, floor, ceiling, below, above, fits) of transfers: the band they must keep to, and how far they leave it.

    segments: keys, x1, y1, z1, x2, y2, z2; terrain(df) gives df with `ground` under x, y, null where unknown: a transfer
    over such ground doesn't fit. Every segment is sampled at both ends and at most `spacing` metres apart.
    """
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n = F.greatest(F.lit(2), F.ceil(length / spacing).cast("int") + 1)
    s = segments.withColumn("__n", n).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    t = F.col("__k") / (F.col("__n") - 1)
    s = terrain(s.withColumns({c: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * t for c in "xyz"}))
    lo, hi = F.col("ground") + clearance - slack, F.col("ground") + height + slack
    b = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.max(lo).alias("floor"), F.min(hi).alias("ceiling"), F.greatest(F.lit(0.0), F.max(lo - F.col("z"))).alias("below"), F.greatest(F.lit(0.0), F.max(F.col("z") - hi)).alias("above"), F.bool_and(F.col("ground").isNotNull()).alias("__known"))
    return b.withColumn("fits", F.col("__known") & (F.col("below") <= slack) & (F.col("above") <= slack)).drop("__known")


def adaptive(segments: DataFrame, keys: list[str], ground, target: float, tolerance: float, depth: int) -> DataFrame:
    """(keys, distance, z, terrain): samples of segments (from, to, z_from, z_to: metres along, and heights), halved where it matters.

    A part is halved while it is longer than the target, or the terrain or the clearance in its middle is off the line between its
    ends by over the tolerance; never beyond `depth` halvings, nor where it is at most half the target long. ground(distance)
    is the terrain as an expression. Parts of one depth are halved together: one projection a depth, no shuffle.
    """
    at = lambda p: ground(F.col(p))
    parts = segments.select(*keys, F.col("from").alias("a"), F.col("to").alias("b"), F.col("z_from").alias("za"), F.col("z_to").alias("zb"))
    parts = parts.withColumns({"ga": at("a"), "gb": at("b")})
    for _ in range(depth):
        mid = parts.withColumns({"m": (F.col("a") + F.col("b")) / 2, "zm": (F.col("za") + F.col("zb")) / 2}).withColumn("gm", at("m"))
        span = F.col("b") - F.col("a")
        off = F.abs(F.col("gm") - (F.col("ga") + F.col("gb")) / 2)
        # The path is straight within a part, so the clearance is off by as much as the terrain.
        split = (span > target / 2) & ((span > target) | (off > tolerance))
        half = lambda p, q: F.struct(*[F.col(f"{n}{p}" if n else p).alias(f"{n}a" if n else "a") for n in ("", "z", "g")], *[F.col(f"{n}{q}" if n else q).alias(f"{n}b" if n else "b") for n in ("", "z", "g")])
        parts = mid.select(*keys, F.explode(F.when(split, F.array(half("a", "m"), half("m", "b"))).otherwise(F.array(half("a", "b")))).alias("h")).select(*keys, "h.*")
    first = parts.select(*keys, F.col("a").alias("distance"), F.col("za").alias("z"), F.col("ga").alias("terrain"))
    return first.unionByName(parts.select(*keys, F.col("b").alias("distance"), F.col("zb").alias("z"), F.col("gb").alias("terrain"))).dropDuplicates([*keys, "distance"])


def merged_crossings(xs: Column, eps: float = 1e-6) -> Column:
    """A sorted array of crossings with those within eps of the one before as one, at their running mean."""
    def step(found: Column, x: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        joined = F.concat(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), F.array((last + x) / 2))
        return F.when((F.size(found) > 0) & (F.abs(x - F.try_element_at(found, F.lit(-1))) <= eps), joined).otherwise(F.concat(found, F.array(x)))

    return F.aggregate(xs, F.slice(xs, 1, 0), step)
