"""Queries over texts, logs and streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sensors import CAMERAS
from ..sources import documents as docs
from ..sources.bindings import poses, table, with_tables
from ..streaming import poses as streams


def props_json(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.from_json("props", "k int")["k"].alias("k"), "value")
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("value"))


def camera_match(spark: SparkSession, sf: str) -> DataFrame:
    """Cameras for names as files spell them."""
    spelt = F.array(*[F.lit(n) for n in _spellings()])
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file"), F.get(spelt, (F.col("s_suppkey") % len(_spellings())).cast("int")).alias("name"))
    return docs.match_camera(spark, names).select("file", "name", "camera")


def plan_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Areas written as flight plans and read again."""
    from ..sources.bindings import areas

    a = areas(spark, sf).select((F.col("area_id") % 7).alias("file"), F.col("area_id").alias("item"), "ring", F.pmod(F.col("area_id") * 1.0, F.lit(180.0)).alias("bearing"), F.lit(30.0).alias("spacing"), (100.0 + F.col("area_id") % 20).alias("altitude"), F.lit("MAP61").alias("payload"))
    back = docs.read_flight_plan(docs.write_flight_plan(a))
    return back.groupBy("file").agg(F.count(F.lit(1)).alias("areas"), F.round(F.sum("bearing"), 4).alias("bearing"), F.round(F.sum("altitude"), 4).alias("altitude"), F.round(F.sum(F.get("ring", F.lit(2))["x"]), 4).alias("corner"))


def pose_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = streams.windows(poses(spark, sf), "1 day")
    return w.select("start", "user_id", "poses", F.round("alt", 4).alias("alt"))


def pose_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return streams.sessions(poses(spark, sf), "6 hours")


def newest_updates(spark: SparkSession, sf: str) -> DataFrame:
    return streams.newest(poses(spark, sf).select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"])


def update_history(spark: SparkSession, sf: str) -> DataFrame:
    return streams.history(poses(spark, sf).select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 10)


def snapshot_apply(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("polygon"), F.col("p_size").alias("version"))
    snapshots = p.filter("polygon % 6 = 0").withColumn("version", F.col("version") + 100)
    return streams.applied(p, snapshots, p.filter("polygon % 3 = 0").select("polygon"), "polygon")


QUERIES = {f.__name__: f for f in (props_json, camera_match, plan_round_trip, pose_windows, pose_sessions, newest_updates, update_history, snapshot_apply)}


def _spellings() -> list[str]:
    return ["RX1RII 42MP", "sony-rx1r2", "Survey61 V5", "A6100", "zenmuse p1", "DJI Zenmuse P1 24mm lens", "inspect", "MAP61 17 mm", "rgb_61", "unknown", "", "SUR24"]


_NAMES = ", ".join(f"({i}, '{k}', '{n}')" for i, (k, *_, names) in enumerate(CAMERAS) for n in names)
_LIST = "[" + ", ".join(f"'{n}'" for n in _spellings()) + "]"

ORACLE = {
    "props_json": "SELECT json_extract_string(props, '$.k')::INTEGER AS k, count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY 1",
    "camera_match": f"""WITH r(seq, key, n0) AS (VALUES {_NAMES}), k AS (SELECT seq, key, regexp_replace(lower(n0), '[^a-z0-9]', '', 'g') AS n FROM r), f AS (SELECT s_suppkey AS file, {_LIST}[(s_suppkey % {len(_spellings())} + 1)::INTEGER] AS name FROM supplier), g AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS m FROM f),
        j AS (SELECT file, arg_min(key, (CASE WHEN m = n THEN 0 ELSE 100 END) + seq) AS camera FROM g JOIN k ON length(m) > 0 AND (starts_with(m, n) OR starts_with(n, m)) GROUP BY file) SELECT file, name, camera FROM f LEFT JOIN j USING (file)""",
    "plan_round_trip": with_tables("SELECT area_id % 7 AS file, count(*) AS areas, round(sum(fmod(area_id, 180)), 4) AS bearing, round(sum(100::DOUBLE + area_id % 20), 4) AS altitude, round(sum(lng + half), 4) AS corner FROM areas GROUP BY 1", "areas"),
    "pose_windows": with_tables("SELECT date_trunc('day', ts)::TIMESTAMP AS \"start\", user_id, count(*) AS poses, round(avg(alt), 4) AS alt FROM poses GROUP BY ALL", "poses"),
    "pose_sessions": with_tables(
        "WITH n AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM poses WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM n) SELECT user_id, min(ts) AS \"first\", max(ts) AS \"last\", count(*) AS poses FROM s GROUP BY user_id, k", "poses"
    ),
    "newest_updates": with_tables("SELECT DISTINCT ON (user_id, event_type) user_id, event_type, ts, event_id FROM poses ORDER BY user_id, event_type, ts DESC, event_id DESC", "poses"),
    "update_history": with_tables("SELECT user_id, ts, event_id FROM poses QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10", "poses"),
    "snapshot_apply": "SELECT p_partkey AS polygon, CASE WHEN p_partkey % 6 = 0 THEN p_size + 100 ELSE p_size END AS version FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 6 = 0",
}
