"""Queries that write files of a kind and read them again, and of what files name and need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terrain
from ..functions.geo import mercator_x, mercator_y
from ..functions.sensors import CAMERAS
from ..operators import raster, terrain_tiles
from ..sources import documents, files
from ..sources.bindings import areas, cells, points, table, with_tables


def _tiles(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).select(F.floor(F.col("row") / 20).alias("tile"), (F.col("row") % 20).cast("int").alias("row"), F.col("col").cast("int").alias("col"), "z", "cell")


def png_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Heights as coloured tiles in PNG files, read and decoded again, with a surface where it is valid."""
    t = _tiles(spark, sf)
    coded = t.select("tile", "row", "col", *[v.alias(n) for n, v in zip("rgb", terrain.encode(F.col("z")), strict=True)], F.lit(255).alias("a"))
    read = files.read_png(files.write_png(coded, ["tile"]), ["tile"]).filter("a > 0")
    base = read.select("tile", "row", "col", terrain.decode(F.col("r"), F.col("g"), F.col("b")).alias("z"))
    over = t.filter("cell % 4 = 0").select("tile", "row", "col", F.when(F.col("cell") % 8 == 0, F.lit(float("nan"))).otherwise(F.col("z") - 100).alias("z"))
    return raster.overlay(base, over, ["tile", "row", "col"]).select("tile", "row", "col", F.round("z", 3).alias("z"))


def tiff_rasters(spark: SparkSession, sf: str) -> DataFrame:
    """Heights in GeoTIFF files, read again: samples and which of them are valid, by tile."""
    t = _tiles(spark, sf).withColumns({"min_x": F.lit(1000.0), "max_y": 5000.0 - F.col("tile") * 600, "z": F.when(F.col("cell") % 6 == 0, F.lit(float("nan"))).otherwise(F.floor(F.col("z")).cast("double"))})
    written = files.write_tiff(t, ["tile"], "min_x", "max_y", 30.0)
    read = files.read_tiff(written, ["tile"]).groupBy("tile").agg(F.count(F.when(F.col("valid"), 1)).alias("valid"), F.round(F.sum(F.when(F.col("valid"), F.col("z") * (F.col("row") * 3 + F.col("col") + 1))), 2).alias("mix"))
    about = files.describe_tiff(written, ["tile"]).select("tile", "width", "epsg", "nodata", F.round("max_y", 3).alias("max_y"), F.round("max_x", 3).alias("max_x"), F.length("id").alias("id"))
    return about.join(read, "tile")


def las_clouds(spark: SparkSession, sf: str) -> DataFrame:
    """Point clouds in LAS files, read again, by file and class; all in one coordinate system."""
    p = points(spark, sf).select((F.col("l_orderkey") % 13).alias("cloud"), "x", "y", (F.col("w") / 100).alias("z"), (F.ascii("class") % 31).alias("class"))
    written = files.write_las(p, ["cloud"])
    read = files.read_las(written, ["cloud"])
    hundredths = lambda c: F.sum(F.rint(F.col(c) * 100).cast("long"))
    return read.groupBy("cloud", "class").agg(F.count(F.lit(1)).alias("n"), hundredths("x").alias("x"), hundredths("y").alias("y"))


def kmz_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Areas as KML in zipped files, read again: their boxes."""
    a = areas(spark, sf)
    corners = F.array_join(F.transform("ring", lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"), F.lit("0"))), " ")
    text = F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>'), corners, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"))
    read = documents.read_kml(files.read_kmz(files.write_kmz(a.select("area_id", text.alias("text")), ["area_id"]), ["area_id"]), keys=("area_id",))
    return documents.ring_bounds(read, ("area_id",)).select("area_id", *[F.round(c, 9).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """Tab-separated tracks of every user, read again: every third row, and speeds."""
    n = F.col("event_id")
    rows = table(spark, sf, "events").select("user_id", n, F.concat_ws("\t", F.format_string("%.1f", n * 0.5 - n % 2), (n * 7 % 311).cast("string"), F.lit("x"), (n % 97).cast("string"), F.when(n % 10 == 4, "n/a").otherwise((n % 13).cast("string"))).alias("line"))
    laid = rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda s: s["line"]), "\n").alias("body"))
    text = laid.select("user_id", F.concat(F.lit("GPSTime\tEasting\tother\tNorthing\tHeight\n"), "body").alias("text"))
    read = documents.read_trajectory(text, keys=("user_id",), every=3)
    return read.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("speed"), 4).alias("mean"), F.count("speed").alias("speeds"), F.round(F.percentile("speed", 0.9), 4).alias("p90"))


def camera_models(spark: SparkSession, sf: str) -> DataFrame:
    """The first usable sensor of every file of sensors."""
    n = F.col("p_partkey")
    sensor = lambda k: F.struct(F.concat(F.lit(f"s{k}-"), n.cast("string")).alias("name"), F.struct(F.when((n + k) % 3 != 0, (n + k * 100).cast("double")).alias("focal_length_px"), F.when(n % 2 == 0, F.array(n * 1.5, n * 0.5)).alias("principal_point_px")).alias("internals"), F.when((n + k) % 5 != 0, F.array((n * 4 + k).cast("int"), (n * 3).cast("int"))).alias("image_size_px"), (2.0 + n % 4).alias("pixel_size_um"))
    text = table(spark, sf, "part").select(n.alias("file"), F.to_json(F.struct(F.array(sensor(1), sensor(2)).alias("sensors"))).alias("text"))
    return documents.read_camera_model(text).select("file", *[F.round(c, 9).alias(c) for c in ("f_m", "sx_m")], "w_px", "h_px", *[F.round(c, 3).alias(c) for c in ("cx_px", "cy_px")])


#: Payloads as plans name them.
PAYLOADS = ["RX1RII 42MP", "rx1rii-42mp", "SURVEY61 v5", "survey61_v7", "SUR24 (old)", "Zenmuse P1", "LIDAR_v5", "Wingtra  lidar", "XT32M2X", "MAPSTAROblique_v4", "inspect", "RGB61_v9", "thermal", "", "a6100_v5"]


def payload_sensors(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    names = F.array(*map(F.lit, PAYLOADS))
    p = table(spark, sf, "part").select(n.alias("item"), F.get(names, (n % len(PAYLOADS)).cast("int")).alias("name"), F.when(n % 4 != 0, F.get(names, (F.floor(n / 7) % len(PAYLOADS)).cast("int"))).alias("key"))
    return documents.resolve_payload(spark, p).select("item", "camera", "lidar")


def _plans(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    kinds = F.array(*map(F.lit, ("takeoff", "area", "waypoint", "area", "loiter", "land", "other")))
    return table(spark, sf, "events").select("user_id", n.alias("item"), F.get(kinds, (n * 5 % 7).cast("int")).alias("kind"), (n % 180).cast("double").alias("lng"), F.when(n % 4 != 0, (n % 90).cast("double")).alias("lat"), (n % 300).cast("double").alias("altitude"), (n % 3 * 20.0).alias("radius"))


def replaced_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's plan with the areas of others in its slots, in the order flown."""
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") % 15 + 1).alias("user_id"), F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("area"))
    return documents.replace_areas(_plans(spark, sf), s, ["user_id"], sequenced=True)


def plan_ends(spark: SparkSession, sf: str) -> DataFrame:
    e = documents.sequence_ends(_plans(spark, sf), ["user_id"])
    return e.select("user_id", F.col("take_off.item").alias("take_off"), F.col("landing.item").alias("landing"), F.col("take_off.altitude").alias("altitude"))


def _known(spark: SparkSession, sf: str) -> DataFrame:
    """A table of tiles about the areas, some of which are missing."""
    from .joins import tile_cover

    return tile_cover(spark, sf).select("tx", "ty").distinct().filter("(tx * 7 + ty) % 5 <> 0")


def tile_prefetch(spark: SparkSession, sf: str) -> DataFrame:
    """The tiles that the areas' terrain needs, and which there are."""
    a = areas(spark, sf).select(*[f(F.col(c) + s * F.col("half")).alias(n) for n, f, c, s in (("min_x", mercator_x, "lng", -1), ("max_x", mercator_x, "lng", 1), ("min_y", mercator_y, "lat", -1), ("max_y", mercator_y, "lat", 1))])
    return terrain_tiles.prefetch(a, _known(spark, sf), 16, 110.0).select("tx", "ty", "there")


def tile_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for tiles with those around: how many there are."""
    wish = _known(spark, sf).select((F.col("tx") * 65536 + F.col("ty")).alias("request"), (F.col("tx") + 1).alias("x"), F.col("ty").alias("y"))
    return terrain_tiles.batch(wish, _known(spark, sf), 16, 1, ["request"])


def tile_fetches(spark: SparkSession, sf: str) -> DataFrame:
    """Requests beyond the map's edges, and those that there is no tile of."""
    tiles = spark.range(64).select((F.col("id") % 8).alias("tx"), F.floor(F.col("id") / 8).alias("ty"), F.col("id").alias("tile")).filter("id % 9 <> 4")
    wish = table(spark, sf, "part").select(F.col("p_partkey").alias("request"), (F.col("p_partkey") % 31 - 12).alias("x"), (F.col("p_partkey") % 17 - 4).alias("y"))
    return terrain_tiles.fetch(wish, tiles, 3).select("request", "tile")


QUERIES = {f.__name__: f for f in (png_tiles, tiff_rasters, las_clouds, kmz_areas, trajectories, camera_models, payload_sensors, replaced_areas, plan_ends, tile_prefetch, tile_batches, tile_fetches)}

_T = "t AS (SELECT row // 20 AS tile, (row % 20)::INTEGER AS row, col::INTEGER AS col, z, cell FROM cells)"
_NAMES = "[" + ", ".join(f"'{p}'" for p in PAYLOADS) + "]"


def _registry(rows) -> str:
    return ", ".join(f"({i}, '{k}', '{n}')" for i, (k, ns) in enumerate(rows) for n in dict.fromkeys([k, *ns]))


_KINDS = "['takeoff', 'area', 'waypoint', 'area', 'loiter', 'land', 'other']"
_PLANS = f"e AS (SELECT user_id, event_id AS item, {_KINDS}[event_id * 5 % 7 + 1] AS kind, CASE WHEN event_id % 4 <> 0 THEN event_id % 90 END AS lat, (event_id % 300)::DOUBLE AS altitude, event_id % 3 AS radius FROM events)"
_KNOWN = """w AS (SELECT area_id, 2 * pi() * 6378137 / 65536 AS side, radians(lng - half) * 6378137 AS x0, radians(lng + half) * 6378137 AS x1, 6378137 * ln(tan(pi() / 4 + radians(lat - half) / 2)) AS y0, 6378137 * ln(tan(pi() / 4 + radians(lat + half) / 2)) AS y1 FROM areas),
c AS (SELECT unnest(range(floor((x0 + pi() * 6378137) / side)::BIGINT - 1, floor((x1 + pi() * 6378137) / side)::BIGINT + 2)) AS tx, floor((pi() * 6378137 - y1) / side)::BIGINT - 1 AS a, floor((pi() * 6378137 - y0) / side)::BIGINT + 2 AS b FROM w), d AS (SELECT DISTINCT tx, unnest(range(a, b)) AS ty FROM c), k AS (SELECT * FROM d WHERE (tx * 7 + ty) % 5 <> 0)"""
ORACLE = {
    "png_tiles": with_tables(f"WITH {_T} SELECT tile, row, col, round(CASE WHEN cell % 4 = 0 AND cell % 8 <> 0 THEN z - 100 ELSE round_even((z + 10000) * 10, 0) / 10 - 10000 END, 3) AS z FROM t", "cells"),
    "tiff_rasters": with_tables(f"WITH {_T} SELECT tile, (max(col) + 1)::INTEGER AS width, 3857::INTEGER AS epsg, -9999::DOUBLE AS nodata, 5000::DOUBLE - tile * 600 AS max_y, 1000::DOUBLE + (max(col) + 1) * 30 AS max_x, 64::INTEGER AS id, count(*) FILTER (cell % 6 <> 0) AS valid, round(sum(floor(z) * (row * 3 + col + 1)) FILTER (cell % 6 <> 0), 2) AS mix FROM t GROUP BY tile", "cells"),
    "las_clouds": with_tables("SELECT l_orderkey % 13 AS cloud, (ascii(class) % 31)::INTEGER AS class, count(*) AS n, sum(round_even(x * 100, 0)::BIGINT)::BIGINT AS x, sum(round_even(y * 100, 0)::BIGINT)::BIGINT AS y FROM points GROUP BY ALL", "points"),
    "kmz_areas": with_tables("SELECT area_id, round(lng - half, 9) AS min_x, round(lat - half, 9) AS min_y, round(lng + half, 9) AS max_x, round(lat + half, 9) AS max_y FROM areas", "areas"),
    "trajectories": """WITH r AS (SELECT user_id, event_id, event_id * 0.5::DOUBLE - event_id % 2 AS t, (event_id * 7 % 311)::DOUBLE AS x, (event_id % 97)::DOUBLE AS y, (event_id % 13)::DOUBLE AS z, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events WHERE event_id % 10 <> 4), k AS (SELECT * FROM r WHERE i % 3 = 0),
        s AS (SELECT user_id, t - lag(t) OVER w AS dt, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS d FROM k WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), v AS (SELECT user_id, CASE WHEN dt > 0 THEN d / dt END AS v FROM s)
        SELECT user_id, count(*) AS "rows", round(avg(v), 4) AS mean, count(v) AS speeds, round(quantile_cont(v, 0.9), 4) AS p90 FROM v GROUP BY user_id""",
    "camera_models": """WITH s AS (SELECT p_partkey AS n, k, 2::DOUBLE + p_partkey % 4 AS px FROM part, range(1, 3) t(k)), g AS (SELECT n, min(k) AS k, any_value(px) AS px FROM s WHERE (n + k) % 3 <> 0 AND (n + k) % 5 <> 0 AND n + k * 100 <> 0 GROUP BY n)
        SELECT n AS file, round((n + k * 100) * px * 1e-6, 9) AS f_m, round(px * 1e-6, 9) AS sx_m, (n * 4 + k)::INTEGER AS w_px, (n * 3)::INTEGER AS h_px, round(CASE WHEN n % 2 = 0 THEN n * 1.5::DOUBLE ELSE (n * 4 + k) / 2::DOUBLE END, 3) AS cx_px, round(CASE WHEN n % 2 = 0 THEN n * 0.5::DOUBLE ELSE n * 3 / 2::DOUBLE END, 3) AS cy_px FROM g""",
    "payload_sensors": f"""WITH c(seq, sensor, n) AS (VALUES {_registry([(c[0], c[-1]) for c in CAMERAS])}), l(seq, sensor, n) AS (VALUES {_registry(documents.LIDARS)}), r AS (SELECT 'c' AS kind, * FROM c UNION ALL SELECT 'l', * FROM l),
        p AS (SELECT p_partkey AS item, {_NAMES}[p_partkey % {len(PAYLOADS)} + 1] AS a, CASE WHEN p_partkey % 4 <> 0 THEN {_NAMES}[p_partkey // 7 % {len(PAYLOADS)} + 1] END AS b FROM part), g AS (SELECT item, 0 AS place, a AS c FROM p UNION ALL SELECT item, 1, b FROM p),
        h AS (SELECT item, place, c, kind, seq, sensor, n, regexp_replace(lower(c), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS y FROM g, r WHERE c <> ''),
        j AS (SELECT *, regexp_replace(x, 'v[0-9]+$', '') AS u, regexp_replace(y, 'v[0-9]+$', '') AS v FROM h), k AS (SELECT *, CASE WHEN c = n THEN 0 WHEN contains(x, y) OR contains(y, x) OR (u <> '' AND v <> '' AND (contains(u, v) OR contains(v, u))) THEN 1 END AS f FROM j),
        z AS (SELECT item, kind, min_by(sensor, (f, place, seq)) AS s FROM k WHERE f IS NOT NULL GROUP BY ALL) SELECT p.item, coalesce(z1.s, '{CAMERAS[0][0]}') AS camera, z2.s AS lidar FROM p LEFT JOIN z z1 ON z1.item = p.item AND z1.kind = 'c' LEFT JOIN z z2 ON z2.item = p.item AND z2.kind = 'l'""",
    "replaced_areas": f"""WITH {_PLANS}, i AS (SELECT user_id, item, kind, CASE WHEN kind = 'area' THEN count(*) FILTER (kind = 'area') OVER (PARTITION BY user_id ORDER BY item) - 1 END AS slot FROM e WHERE kind NOT IN ('waypoint', 'loiter')),
        a AS (SELECT s_suppkey % 15 + 1 AS user_id, s_suppkey AS area, row_number() OVER (PARTITION BY s_suppkey % 15 ORDER BY s_suppkey) - 1 AS k FROM supplier), m AS (SELECT user_id, count(slot) AS slots, coalesce(max(item) FILTER (slot IS NOT NULL), max(item)) AS last FROM i GROUP BY user_id),
        u AS (SELECT i.user_id, item::DOUBLE AS pos, 0 AS more, kind, area FROM i LEFT JOIN a ON a.user_id = i.user_id AND a.k = i.slot WHERE slot IS NULL OR area IS NOT NULL UNION ALL SELECT a.user_id, last + 0.5, k, 'area', area FROM a JOIN m USING (user_id) WHERE k >= slots)
        SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY pos, more) - 1)::INTEGER AS place, kind, area FROM u""",
    "plan_ends": f"""WITH {_PLANS}, f AS (SELECT user_id, kind, min(item) AS item FROM e WHERE kind IN ('takeoff', 'land') GROUP BY ALL), g AS (SELECT e.* FROM f JOIN e ON e.user_id = f.user_id AND e.item = f.item WHERE lat IS NOT NULL AND radius > 0)
        SELECT user_id, max(item) FILTER (kind = 'takeoff') AS take_off, max(item) FILTER (kind = 'land') AS landing, max(altitude) FILTER (kind = 'takeoff') AS altitude FROM g GROUP BY user_id""",
    "tile_prefetch": with_tables(
        f"WITH {_KNOWN}, n AS (SELECT unnest(range(greatest(0, floor((x0 - 220 + pi() * 6378137) / side)::BIGINT), floor((x1 + 220 + pi() * 6378137) / side)::BIGINT + 1)) AS tx, floor((pi() * 6378137 - y1 - 220) / side)::BIGINT AS a, floor((pi() * 6378137 - y0 + 220) / side)::BIGINT + 1 AS b FROM w), q AS (SELECT DISTINCT tx, unnest(range(a, b)) AS ty FROM n) SELECT q.tx, q.ty, k.tx IS NOT NULL AS there FROM q LEFT JOIN k ON k.tx = q.tx AND k.ty = q.ty", "areas"
    ),
    "tile_batches": with_tables(f"WITH {_KNOWN}, r AS (SELECT tx * 65536 + ty AS request, tx + 1 AS x, ty AS y FROM k), n AS (SELECT request, x, y, count(k.tx) AS n, bool_or(k.tx = x AND k.ty = y) AS own FROM r LEFT JOIN k ON abs(k.tx - x) <= 1 AND abs(k.ty - y) <= 1 GROUP BY ALL) SELECT request, x, y, CASE WHEN own THEN n ELSE 0 END AS tiles, coalesce(own AND n = 9, false) AS whole FROM n", "areas"),
    "tile_fetches": "WITH t AS (SELECT range % 8 AS tx, range // 8 AS ty, range AS tile FROM range(64) WHERE range % 9 <> 4) SELECT p_partkey AS request, tile FROM part JOIN t ON tx = (p_partkey % 31 - 12 + 16) % 8 AND ty = greatest(0, least(7, p_partkey % 17 - 4))",
}
