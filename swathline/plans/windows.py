"""Queries of order-dependent operators over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sensors import turn_radius
from ..operators import generators, paths
from ..sources.bindings import areas, poses, with_tables

ORDER = ["ts", "event_id"]


def path_length(spark: SparkSession, sf: str) -> DataFrame:
    cost = paths.transfer_cost(poses(spark, sf), ["user_id"], ORDER)
    return cost.select("user_id", *[F.round(c, 3).alias(c) for c in ("metres", "seconds", "cost")])


def speeds(spark: SparkSession, sf: str) -> DataFrame:
    """Speeds between consecutive poses with time between them: mean and percentiles by vehicle."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    s = paths.steps(poses(spark, sf), ["user_id"], ORDER).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("dt", (F.col("us") - F.lag("us").over(w)) / 1e6).filter("dt > 0")
    v = F.col("metres") / F.col("dt") * 1000
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.percentile(v, 0.5), 4).alias("p50"), F.round(F.percentile(v, 0.9), 4).alias("p90"))


def sweep_islands(spark: SparkSession, sf: str) -> DataFrame:
    return paths.islands(poses(spark, sf), ["user_id"], ORDER, "event_type").select("event_id", "island", "forward")


def trigger_points(spark: SparkSession, sf: str) -> DataFrame:
    found = paths.triggers(poses(spark, sf), ["user_id"], ORDER, 900.0)
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("photos"), F.round(F.sum("lng"), 4).alias("lng"), F.round(F.sum("lat"), 4).alias("lat"), F.round(F.sum("alt"), 2).alias("alt"))


def distance_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Start and end of every island along its vehicle's path."""
    p = paths.islands(paths.running(poses(spark, sf), ["user_id"], ORDER), ["user_id"], ORDER, "event_type")
    return p.groupBy("user_id", "island").agg(F.round(F.min("start"), 3).alias("start"), F.round(F.max("distance"), 3).alias("end")).filter(F.col("end") > F.col("start"))


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    p = paths.running(poses(spark, sf), ["user_id"], ORDER)
    terrain = 400 + F.pmod(F.col("event_id") * 37, F.lit(211)).cast("double")
    return p.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)).alias("i"), "distance", terrain.alias("terrain"), F.when(F.col("event_id") % 11 != 0, F.col("alt") - terrain).alias("clearance"))


def profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = paths.profile_summary(_profile(spark, sf), ["user_id"])
    return s.select("user_id", "samples", *[F.round(c, 3).alias(c) for c in ("total", "least", "mean", "most")], F.round(paths.spacing_bucket(F.col("total") / 100), 6).alias("bucket"))


def decimate_extrema(spark: SparkSession, sf: str) -> DataFrame:
    p = _profile(spark, sf).withColumn("clearance", F.round("clearance", 6))  # heights have two places: equal clearances differ in their last bits
    return paths.decimate(p, ["user_id"], "i", 32).select("user_id", "i", F.round("distance", 3).alias("distance"))


def profile_clip(spark: SparkSession, sf: str) -> DataFrame:
    return paths.clip(_profile(spark, sf), ["user_id"], 30000.0, 33000.0).select("user_id", "i", F.round("distance", 3).alias("distance"))


def sweep_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Flight lines over every area: lines, lengths, connectors, time."""
    rings = areas(spark, sf).select("area_id", F.transform("ring", lambda p: F.struct(((p["x"] - 8.5) * 75000).alias("x"), ((p["y"] - 47.3) * 111000).alias("y"))).alias("ring"))
    m = generators.sweep_metrics(rings, ["area_id"], bearing=25.0, spacing=31.0, speed=12.0, radius=turn_radius(F.lit(31.0), 40.0))
    return m.select("area_id", "lines", "fragments", *[F.round(c, 3).alias(c) for c in ("length", "connectors", "mean_line", "median_line", "short", "transit", "seconds")])


QUERIES = {f.__name__: f for f in (path_length, speeds, sweep_islands, trigger_points, distance_ranges, profile_summary, decimate_extrema, profile_clip, sweep_metrics)}

_STEPS = """WITH l AS (SELECT *, lag(lng) OVER w AS pl, lag(lat) OVER w AS pb, lag(alt) OVER w AS pa, lag(ts) OVER w AS pt, row_number() OVER w AS i FROM poses WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, coalesce(2 * 6371000::DOUBLE * asin(sqrt(pow(sin(radians(lat - pb) / 2), 2) + cos(radians(pb)) * cos(radians(lat)) * pow(sin(radians(lng - pl) / 2), 2))), 0) AS m, coalesce(alt - pa, 0) AS dz FROM l),
r AS (SELECT *, sum(m) OVER (PARTITION BY user_id ORDER BY i) AS d FROM s)"""
_ISLAND = ", n AS (SELECT *, CASE WHEN i = 1 OR event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM r), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY i)::BIGINT AS island FROM n)"
_PROFILE = ", p AS (SELECT user_id, i::INTEGER AS i, d AS distance, 400 + ((event_id * 37) % 211)::DOUBLE AS terrain, CASE WHEN event_id % 11 <> 0 THEN alt - 400 - ((event_id * 37) % 211)::DOUBLE END AS clearance FROM r)"

ORACLE = {
    "path_length": with_tables(_STEPS + " SELECT user_id, round(sum(m), 3) AS metres, round(sum(greatest(m / 16, greatest(dz, 0) / 4, greatest(-dz, 0) / 3)), 3) AS seconds, round(sum(m / 16 + 2.5 * greatest(dz, 0) / 4 + 0.6 * greatest(-dz, 0) / 3), 3) AS cost FROM s GROUP BY user_id", "poses"),
    "speeds": with_tables(_STEPS + ", v AS (SELECT user_id, m / ((epoch_us(ts) - epoch_us(pt)) / 1e6) * 1000 AS v FROM s WHERE epoch_us(ts) > epoch_us(pt)) SELECT user_id, count(*) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.9), 4) AS p90 FROM v GROUP BY user_id", "poses"),
    "sweep_islands": with_tables(_STEPS + _ISLAND + " SELECT event_id, island, island % 2 = 0 AS forward FROM k", "poses"),
    "trigger_points": with_tables(
        _STEPS
        + """, e AS (SELECT *, max(i) OVER (PARTITION BY user_id) AS last, d - m AS st FROM r), o AS (SELECT user_id, pl AS lng, pb AS lat, pa AS alt FROM e WHERE i = 2
        UNION ALL SELECT user_id, pl + (lng - pl) * (k * 900 - st) / m, pb + (lat - pb) * (k * 900 - st) / m, pa + (alt - pa) * (k * 900 - st) / m FROM (SELECT *, unnest(range(floor(st / 900)::BIGINT + 1, floor(d / 900)::BIGINT + 1)) AS k FROM e WHERE i > 1)
        UNION ALL SELECT user_id, lng, lat, alt FROM e WHERE i = last AND i > 1 AND d - floor(d / 900) * 900 > 225) SELECT user_id, count(*) AS photos, round(sum(lng), 4) AS lng, round(sum(lat), 4) AS lat, round(sum(alt), 2) AS alt FROM o GROUP BY user_id""",
        "poses",
    ),
    "distance_ranges": with_tables(_STEPS + _ISLAND + ' SELECT user_id, island, round(min(d - m), 3) AS "start", round(max(d), 3) AS "end" FROM k GROUP BY ALL HAVING round(max(d), 3) > round(min(d - m), 3)', "poses"),
    "profile_summary": with_tables(
        _STEPS + _PROFILE + ", q AS (SELECT user_id, count(*) AS samples, max(distance) AS total, min(clearance) AS least, avg(clearance) AS mean, max(clearance) AS most FROM p GROUP BY user_id), g AS (SELECT *, pow(10, floor(log10(CASE WHEN total > 0 THEN total / 100 END))) AS base FROM q) SELECT user_id, samples, round(total, 3) AS total, round(least, 3) AS least, round(mean, 3) AS mean, round(most, 3) AS most, round(CASE WHEN total > 0 THEN base * CASE WHEN total / 100 / base <= 1 THEN 1 WHEN total / 100 / base <= 2 THEN 2 WHEN total / 100 / base <= 5 THEN 5 ELSE 10 END ELSE 1 END, 6) AS bucket FROM g",
        "poses",
    ),
    "decimate_extrema": with_tables(
        _STEPS + _PROFILE
        + """, t AS (SELECT *, max(distance) OVER w AS total, count(*) OVER w AS n, max(i) OVER w AS last FROM p WINDOW w AS (PARTITION BY user_id)), b AS (SELECT t.*, b FROM t JOIN range(8) z(b) ON distance >= b * total / 8 AND distance <= (b + 1) * total / 8 OR (total = 0 AND b = 0) OR (b = 7 AND distance = total)),
        x AS (SELECT user_id, unnest([min(i), max(i), arg_min(i, terrain * 100000 + i), arg_max(i, terrain * 100000 - i), min_by(i, round(clearance, 6) * 100000 + i), max_by(i, round(clearance, 6) * 100000 - i)]) AS i FROM b GROUP BY user_id, b)
        SELECT DISTINCT t.user_id, t.i, round(distance, 3) AS distance FROM t WHERE n <= 32 OR i = 1 OR i = last OR EXISTS (SELECT 1 FROM x WHERE x.user_id = t.user_id AND x.i = t.i)""",
        "poses",
    ),
    "profile_clip": with_tables(
        _STEPS + _PROFILE
        + """, t AS (SELECT *, distance BETWEEN 30000 AND 33000 AS inside FROM p), a AS (SELECT *, count(*) FILTER (inside) OVER w AS n, max(distance) FILTER (distance < 30000) OVER w AS lo, min(distance) FILTER (distance > 33000) OVER w AS hi FROM t WINDOW w AS (PARTITION BY user_id)),
        c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS k FROM a WHERE inside OR (n < 2 AND (distance = lo OR distance = hi))) SELECT user_id, i, round(distance, 3) AS distance FROM c WHERE k >= 2""",
        "poses",
    ),
    "sweep_metrics": with_tables(
        """WITH q AS (SELECT area_id, (lng - 8.5::DOUBLE) * 75000 AS cx, half * 75000 AS hx, half * 111000 AS hy FROM areas), v AS (SELECT area_id, cx, k, (CASE WHEN k IN (0, 3) THEN -hx ELSE hx END) AS x, (CASE WHEN k < 2 THEN -hy ELSE hy END) AS y FROM q, range(4) t(k)),
        f AS (SELECT area_id, k, x * sin(radians(25)) + y * cos(radians(25)) AS al, x * cos(radians(25)) - y * sin(radians(25)) AS cr FROM v), e AS (SELECT a.area_id, a.al AS a1, a.cr AS c1, b.al AS a2, b.cr AS c2 FROM f a JOIN f b ON a.area_id = b.area_id AND b.k = (a.k + 1) % 4),
        n AS (SELECT area_id, ceil(greatest(1, max(cr) - min(cr)) / 31)::BIGINT AS n FROM f GROUP BY area_id), l AS (SELECT area_id, unnest(range(-n - 1, n + 2)) AS i FROM n),
        h AS (SELECT l.area_id, i, a1 + (i * 31 - c1) * (a2 - a1) / (c2 - c1) AS x FROM l JOIN e ON l.area_id = e.area_id AND abs(c2 - c1) > 1e-12 AND i * 31 >= least(c1, c2) AND i * 31 < greatest(c1, c2)),
        w AS (SELECT area_id, i, min(x) AS lo, max(x) AS hi FROM h GROUP BY ALL HAVING count(*) >= 2 AND max(x) - min(x) > 1e-9), o AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY i) % 2 = 1 AS fwd FROM w),
        d AS (SELECT *, hi - lo AS len, CASE WHEN fwd THEN lo ELSE hi END AS st, CASE WHEN fwd THEN hi ELSE lo END AS en FROM o), c AS (SELECT *, pi() * 40 + sqrt(pow(st - lag(en) OVER z, 2) + pow(greatest(0, 31 * (i - lag(i) OVER z) - 80), 2)) AS con FROM d WINDOW z AS (PARTITION BY area_id ORDER BY i))
        SELECT area_id, count(*) AS lines, 0::BIGINT AS fragments, round(sum(len), 3) AS length, round(coalesce(sum(con), 0), 3) AS connectors, round(avg(len), 3) AS mean_line, round(median(len), 3) AS median_line, round(sum((len < 155)::INTEGER) / count(*), 3) AS short,
        round(coalesce(sum(con), 0) / greatest(1, sum(len) + coalesce(sum(con), 0)), 3) AS transit, round((sum(len) + coalesce(sum(con), 0)) / 12 + 25, 3) AS seconds FROM c GROUP BY area_id""",
        "areas",
    ),
}
