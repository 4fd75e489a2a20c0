"""Queries of routes between and within areas: positions, corridors, summaries, bands, samples, orders and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paths, sequences
from ..sources.bindings import areas, poses, table, with_tables
from ..streaming import poses as live
from .joins import connection_matrix


def _legs(spark: SparkSession, sf: str) -> DataFrame:
    a = areas(spark, sf)
    return a.select("area_id", (F.col("lng") - F.col("half")).alias("lng1"), (F.col("lat") - F.col("area_id") % 5 * 0.0002).alias("lat1"), (F.col("lng") + F.col("half") * (F.col("area_id") % 3)).alias("lng2"), (F.col("lat") + 0.0007).alias("lat2"))


def flat_triggers(spark: SparkSession, sf: str) -> DataFrame:
    """Camera positions along a straight line over every area."""
    return paths.triggers_flat(_legs(spark, sf), ["area_id"], 37.0).select("area_id", "seq", F.round("lng", 8).alias("lng"), F.round("lat", 8).alias("lat"))


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") * 31 % 257).cast("double").alias("metres"), (F.col("event_id") % 4 == 3).alias("gap"))


def fragment_triggers(spark: SparkSession, sf: str) -> DataFrame:
    """Positions along every vehicle's broken line, none within its gaps."""
    return paths.triggers_in_fragments(_steps(spark, sf), ["user_id"], "event_id", 60.0)


def corridors(spark: SparkSession, sf: str) -> DataFrame:
    p = poses(spark, sf).select("user_id", F.col("event_id").alias("seq"), "lng", "lat")
    return paths.corridor(p, ["user_id"]).select("user_id", *[F.round(c, 7).alias(c) for c in ("west", "south", "east", "north")])


def mission_summaries(spark: SparkSession, sf: str) -> DataFrame:
    s = _steps(spark, sf)
    own = s.filter("NOT gap").select("user_id", "metres", (F.col("event_id") % 17).cast("double").alias("speed"))
    found = paths.mission_summary(own, s.filter("gap").select("user_id", "metres", (F.col("metres") / 16).alias("seconds")), ["user_id"])
    return found.select("user_id", *[F.round(c, 4).alias(c) for c in ("area_metres", "area_seconds", "connector_metres", "connector_seconds", "metres", "seconds")])


def planned_summaries(spark: SparkSession, sf: str) -> DataFrame:
    s = _steps(spark, sf).select("user_id", (F.col("event_id") % 7).alias("sweep"), "event_id", "metres", F.when(F.col("gap"), 12.5).otherwise(0.0).alias("gap"), (F.col("user_id") % 9 * 5.0).alias("connector"))
    found = paths.planned_summary(s, ["user_id"], "sweep")
    return found.select("user_id", "lines", "fragments", "turns", *[F.round(c, 5).alias(c) for c in ("gaps", "length", "path", "connectors", "transit", "broken")])


def transfer_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Transfers from each area over hills, sampled each 30 m; beyond 9,000 m the ground isn't known."""
    n = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(n.alias("leg"), (n * 10.0).alias("x1"), F.lit(0.0).alias("y1"), (120 + n % 50).cast("double").alias("z1"), (n * 10.0 + n % 13 * 40).alias("x2"), (n % 7 * 25.0).alias("y2"), (150 + n % 31).cast("double").alias("z2"))
    hills = lambda df: df.withColumn("ground", F.when(F.col("x") <= 9000, 40 + 30 * F.sin(F.col("x") / 200) + F.col("y") / 20))
    b = paths.transfer_band(s, ["leg"], hills, 60.0, 120.0)
    return b.select("leg", "samples", *[F.round(c, 4).alias(c) for c in ("floor", "ceiling", "below", "above")], "fits")


def adaptive_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of a flight over a ridge for every area."""
    n = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(n.alias("leg"), F.lit(0.0).alias("from"), (800.0 + n % 40 * 10).alias("to"), F.lit(620.0).alias("z_from"), (600.0 + n % 30).alias("z_to"))
    ridge = lambda d: 420 + 90 * F.exp(-F.pow(d - 600, F.lit(2)) / (2 * 110.0 * 110.0)) + 0.01 * d
    found = paths.adaptive(s, ["leg"], ridge, 100.0, 2.0, 8)
    return found.groupBy("leg").agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("distance"), 4).alias("distances"), F.round(F.min(F.col("z") - F.col("terrain")), 4).alias("least"))


def crossings_merged(spark: SparkSession, sf: str) -> DataFrame:
    x = F.array_sort(F.collect_list(F.round(F.col("p_partkey") % 37 + (F.col("p_partkey") % 5) * 3e-7, 9)))
    p = table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 60).alias("line")).agg(x.alias("xs"))
    return p.select("line", F.size(paths.merged_crossings(F.col("xs"))).alias("crossings"))


def mission_orders(spark: SparkSession, sf: str) -> DataFrame:
    """What the cheapest order of every mission's areas costs, with the ways to its first and from its last."""
    links = connection_matrix(spark, sf)
    ends = areas(spark, sf).select(F.floor(F.col("area_id") / 6).alias("mission"), "area_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("flip"))
    ends = ends.withColumns({"start": (F.col("area_id") * 7 % 30 + F.col("flip") * 3).cast("double"), "end": (F.col("area_id") * 11 % 40 - F.col("flip") * 2).cast("double")})
    o = sequences.sequence(links, ends, ["mission"], "area_id")
    return o.groupBy("mission").agg(F.count(F.lit(1)).alias("areas"), F.countDistinct("area_id").alias("distinct"), F.round(F.max("cost"), 3).alias("cost"))


def undo_states(spark: SparkSession, sf: str) -> DataFrame:
    """What every user can undo and redo after all their steps, five at most."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("view", "click"), "push").when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "undo").otherwise("redo").alias("action"), F.col("event_id").alias("id"))
    s = live.undo_state(e, ["user_id"], ["event_id"], most=5)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return s.select("user_id", text("undo").alias("undo"), text("redo").alias("redo"))


def affected_ids(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    t = table(spark, sf, "events").select(n.alias("transaction"), F.array(n % 7, n % 5).alias("before"), F.array(n % 3, n % 5, n % 11).alias("after"))
    return live.affected(t, ["transaction"])


def profile_requests(spark: SparkSession, sf: str) -> DataFrame:
    """What every user's profile has last been asked for."""
    n = F.col("event_id")
    kind = F.when(n % 10 == 0, "snapshot").when(n % 3 == 0, "detail").otherwise("overview")
    return live.profile_requests(table(spark, sf, "events").select("user_id", n, kind.alias("kind")), ["user_id"], "event_id")


QUERIES = {f.__name__: f for f in (flat_triggers, fragment_triggers, corridors, mission_summaries, planned_summaries, transfer_bands, adaptive_profile, crossings_merged, mission_orders, undo_states, affected_ids, profile_requests)}

_STEPS = "s AS (SELECT user_id, event_id, (event_id * 31 % 257)::DOUBLE AS metres, event_id % 4 = 3 AS gap FROM events)"
ORACLE = {
    "flat_triggers": with_tables(
        """WITH l AS (SELECT area_id, lng - half AS x1, lat - area_id % 5 * 0.0002::DOUBLE AS y1, lng + half * (area_id % 3) AS x2, lat + 0.0007::DOUBLE AS y2 FROM areas),
        h AS (SELECT *, radians(y1) AS p, pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2) AS h, atan2(sin(radians(x2 - x1)) * cos(radians(y2)), cos(radians(y1)) * sin(radians(y2)) - sin(radians(y1)) * cos(radians(y2)) * cos(radians(x2 - x1))) AS b FROM l),
        t AS (SELECT *, 2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)) AS total FROM h), k AS (SELECT *, ceil(total / 37)::INTEGER AS last, unnest(range(ceil(total / 37)::INTEGER + 1))::INTEGER AS seq FROM t),
        d AS (SELECT *, seq * 37 / 6371000::DOUBLE AS d FROM k), e AS (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(b)) AS f FROM d)
        SELECT area_id, seq, round(CASE WHEN seq = 0 THEN x1 WHEN seq = last THEN x2 ELSE x1 + degrees(atan2(sin(b) * sin(d) * cos(p), cos(d) - sin(p) * sin(f))) END, 8) AS lng, round(CASE WHEN seq = 0 THEN y1 WHEN seq = last THEN y2 ELSE degrees(f) END, 8) AS lat FROM e""",
        "areas",
    ),
    "fragment_triggers": f"""WITH {_STEPS}, r AS (SELECT *, sum(metres) OVER (PARTITION BY user_id ORDER BY event_id) AS e FROM s), k AS (SELECT user_id, unnest(range(floor((e - metres) / 60)::BIGINT + 1, floor(e / 60)::BIGINT + 1)) * 60::DOUBLE AS distance FROM r WHERE NOT gap AND metres > 0)
        SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY distance) - 1)::INTEGER AS seq, distance FROM k""",
    "corridors": with_tables(
        """WITH o AS (SELECT user_id, arg_min(lng, event_id) AS a, arg_min(lat, event_id) AS b FROM poses GROUP BY user_id), e AS (SELECT p.user_id, a, b, min(lng) AS x0, max(lng) AS x1, min(lat) AS y0, max(lat) AS y1 FROM poses p JOIN o USING (user_id) GROUP BY ALL), k AS (SELECT *, degrees(90 / (6378137 * cos(radians(b)))) AS dx, degrees(90 / 6378137::DOUBLE) AS dy FROM e)
        SELECT user_id, round(x0 - dx, 7) AS west, round(y0 - dy, 7) AS south, round(x1 + dx, 7) AS east, round(y1 + dy, 7) AS north FROM k""",
        "poses",
    ),
    "mission_summaries": f"""WITH {_STEPS}, a AS (SELECT user_id, sum(metres) AS m, sum(CASE WHEN event_id % 17 > 0 THEN metres / (event_id % 17) ELSE 0 END) AS t FROM s WHERE NOT gap GROUP BY user_id), c AS (SELECT user_id, sum(metres) AS m, sum(metres / 16) AS t FROM s WHERE gap GROUP BY user_id)
        SELECT user_id, round(a.m, 4) AS area_metres, round(a.t, 4) AS area_seconds, round(coalesce(c.m, 0), 4) AS connector_metres, round(coalesce(c.t, 0), 4) AS connector_seconds, round(a.m + coalesce(c.m, 0), 4) AS metres, round(a.t + coalesce(c.t, 0), 4) AS seconds FROM a LEFT JOIN c USING (user_id)""",
    "planned_summaries": f"""WITH {_STEPS}, p AS (SELECT user_id, event_id % 7 AS sweep, count(*) AS n, sum(metres) AS m, sum(CASE WHEN gap THEN 12.5::DOUBLE ELSE 0 END) AS g, user_id % 9 * 5::DOUBLE AS c FROM s GROUP BY ALL), t AS (SELECT user_id, count(*) AS lines, sum(n - 1)::BIGINT AS f, sum(g) AS g, sum(m + g) AS l, sum(c) AS c FROM p GROUP BY user_id)
        SELECT user_id, lines, f AS fragments, lines - 1 AS turns, round(g, 5) AS gaps, round(l, 5) AS length, round(l + c, 5) AS path, round(c, 5) AS connectors, round(CASE WHEN l + c > 0 THEN c / (l + c) ELSE 0 END, 5) AS transit, round(f / lines::DOUBLE, 5) AS broken FROM t""",
    "transfer_bands": """WITH s AS (SELECT s_suppkey AS leg, s_suppkey * 10::DOUBLE AS x1, 0::DOUBLE AS y1, 120::DOUBLE + s_suppkey % 50 AS z1, s_suppkey * 10::DOUBLE + s_suppkey % 13 * 40 AS x2, s_suppkey % 7 * 25::DOUBLE AS y2, 150::DOUBLE + s_suppkey % 31 AS z2 FROM supplier),
        n AS (SELECT *, greatest(2, ceil(sqrt(pow(x2 - x1, 2) + y2 * y2) / 30)::INTEGER + 1) AS n FROM s), k AS (SELECT *, unnest(range(n)) / (n - 1)::DOUBLE AS t FROM n), p AS (SELECT leg, x1 + (x2 - x1) * t AS x, y2 * t AS y, z1 + (z2 - z1) * t AS z FROM k),
        g AS (SELECT *, CASE WHEN x <= 9000 THEN 40 + 30 * sin(x / 200) + y / 20 END AS g FROM p), b AS (SELECT leg, count(*) AS n, max(g + 59.5) AS f, min(g + 120.5) AS c, greatest(0, coalesce(max(g + 59.5 - z), 0)) AS lo, greatest(0, coalesce(max(z - g - 120.5), 0)) AS hi, bool_and(g IS NOT NULL) AS known FROM g GROUP BY leg)
        SELECT leg, n AS samples, round(f, 4) AS floor, round(c, 4) AS ceiling, round(lo, 4) AS below, round(hi, 4) AS above, known AND lo <= 0.5 AND hi <= 0.5 AS fits FROM b""",
    "adaptive_profile": """WITH RECURSIVE s AS (SELECT s_suppkey AS leg, 800::DOUBLE + s_suppkey % 40 * 10 AS total, 600::DOUBLE + s_suppkey % 30 AS z1 FROM supplier),
        p(leg, total, z1, a, b, d, final) AS (SELECT leg, total, z1, 0::DOUBLE, total, 0, false FROM s UNION ALL
          SELECT leg, total, z1, CASE WHEN split AND h = 1 THEN (a + b) / 2 ELSE a END, CASE WHEN split AND h = 0 THEN (a + b) / 2 ELSE b END, d + 1, NOT split FROM (
            SELECT *, b - a > 50 AND d < 8 AND (b - a > 100 OR abs(420 + 90 * exp(-pow((a + b) / 2 - 600, 2) / 24200) + 0.01 * (a + b) / 2 - (420 + 90 * exp(-pow(a - 600, 2) / 24200) + 0.01 * a + 420 + 90 * exp(-pow(b - 600, 2) / 24200) + 0.01 * b) / 2) > 2) AS split FROM p WHERE NOT final) q, (VALUES (0), (1)) t(h) WHERE split OR h = 0),
        x AS (SELECT DISTINCT leg, total, z1, unnest([a, b]) AS m FROM p WHERE final), y AS (SELECT leg, m, 620 + (z1 - 620) * m / total - (420 + 90 * exp(-pow(m - 600, 2) / 24200) + 0.01 * m) AS c FROM x)
        SELECT leg, count(*) AS samples, round(sum(m), 4) AS distances, round(min(c), 4) AS least FROM y GROUP BY leg""",
    "crossings_merged": "SELECT p_partkey // 60 AS line, count(DISTINCT p_partkey % 37)::INTEGER AS crossings FROM part GROUP BY 1",
    "mission_orders": with_tables(
        """WITH RECURSIVE a AS (SELECT area_id // 6 AS mission, area_id, flip::INTEGER AS flip, 1 << (area_id % 6)::INTEGER AS bit, (lng - 8.5::DOUBLE) * 75000 + (CASE WHEN flip = 0 THEN 1 ELSE -1 END) * half * 75000 AS out, (lng - 8.5::DOUBLE) * 75000 - (CASE WHEN flip = 0 THEN 1 ELSE -1 END) * half * 75000 AS come, area_id * 37 % 211 + 400::DOUBLE AS z, area_id * 7 % 30 + flip * 3 AS st, area_id * 11 % 40 - flip * 2 AS en FROM areas, range(2) t(flip)),
        l AS (SELECT a.mission, a.area_id, a.flip, b.area_id AS too, b.flip AS tof, b.bit, round(abs(a.out - b.come) / 16 + 2.5 * greatest(0, b.z - a.z) / 4 + 0.6 * greatest(0, a.z - b.z) / 3, 4) AS c FROM a JOIN a b ON a.mission = b.mission AND a.area_id <> b.area_id),
        p(mission, seen, area_id, flip, n, c) AS (SELECT mission, bit, area_id, flip, 1, st::DOUBLE FROM a UNION ALL SELECT p.mission, p.seen | l.bit, l.too, l.tof, p.n + 1, p.c + l.c FROM p JOIN l ON l.mission = p.mission AND l.area_id = p.area_id AND l.flip = p.flip AND p.seen & l.bit = 0),
        n AS (SELECT mission, count(DISTINCT area_id) AS n FROM a GROUP BY mission) SELECT p.mission, any_value(n.n) AS areas, any_value(n.n) AS "distinct", round(min(p.c + a.en), 3) AS cost FROM p JOIN n ON n.mission = p.mission AND n.n = p.n JOIN a ON a.mission = p.mission AND a.area_id = p.area_id AND a.flip = p.flip GROUP BY p.mission""",
        "areas",
    ),
    "undo_states": """WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'push' WHEN event_type IN ('error', 'signup') THEN 'undo' ELSE 'redo' END AS act, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        s(user_id, i, u, r) AS (SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM e UNION ALL
          SELECT s.user_id, e.i, CASE e.act WHEN 'push' THEN list_concat(s.u, [e.event_id])[greatest(len(s.u) - 3, 1):] WHEN 'undo' THEN s.u[:greatest(len(s.u) - 1, 0)] ELSE list_concat(s.u, s.r[greatest(len(s.r), 1):]) END, CASE e.act WHEN 'push' THEN [] WHEN 'undo' THEN list_concat(s.r, s.u[greatest(len(s.u), 1):]) ELSE s.r[:greatest(len(s.r) - 1, 0)] END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
        SELECT s.user_id, coalesce(array_to_string(u, ' '), '') AS undo, coalesce(array_to_string(r, ' '), '') AS redo FROM s JOIN (SELECT user_id, max(n) AS n FROM e GROUP BY user_id) t ON t.user_id = s.user_id AND t.n = s.i""",
    "profile_requests": """WITH k AS (SELECT user_id, event_id, CASE WHEN event_id % 10 = 0 THEN 'snapshot' WHEN event_id % 3 = 0 THEN 'detail' ELSE 'overview' END AS kind FROM events), s AS (SELECT user_id, max(event_id) AS snapshot FROM k WHERE kind = 'snapshot' GROUP BY user_id)
        SELECT s.user_id, snapshot, max(event_id) FILTER (kind = 'overview' AND event_id > snapshot) AS overview, max(event_id) FILTER (kind = 'detail' AND event_id > snapshot) AS detail FROM s JOIN k USING (user_id) GROUP BY ALL""",
    "affected_ids": "SELECT DISTINCT event_id AS \"transaction\", unnest([event_id % 7, event_id % 5, event_id % 3, event_id % 11]) AS id FROM events",
}
