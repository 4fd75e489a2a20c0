"""Flight plans, area files and pose files as DataFrames, from columns of text; and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sensors import cameras

FLIGHT_PLAN = """struct<flightPlan: struct<items: array<struct<type: string, complexItemType: string, command: string, altitude: double, polygon: array<array<double>>,
grid: struct<angle: double, spacing: double, altitude: double, turnAroundDistance: double>, camera: struct<name: string, key: string>>>>>"""
POSES = "struct<captures: array<struct<id: string, coordinates: array<double>, crs: string, orientation: array<double>, time: string>>>"
GEOTAGS = "struct<flights: array<struct<kind: string, geotag: array<struct<coordinate: array<string>, omega: string, phi: string, kappa: string, sequence: string>>>>>"


def read_flight_plan(texts: DataFrame, text: str = "text", keys: tuple[str, ...] = ("file",), convention: str = "northCW") -> DataFrame:
    """(keys, item, ring of x = lng and y = lat, bearing, spacing, altitude, payload) for every area item of flight plans.

    Files give vertices as lat, lon; items of other kinds and areas of under three vertices are left out; text that is
    no plan has no rows.
    """
    items = texts.select(*keys, F.posexplode(F.from_json(F.col(text), FLIGHT_PLAN)["flightPlan"]["items"]).alias("item", "i"))
    items = items.filter("i.type = 'ComplexItem' AND i.complexItemType = 'area' AND size(i.polygon) >= 3")
    angle = F.col("i.grid.angle")
    bearing = F.pmod(90.0 - angle, F.lit(360.0)) if convention == "eastCW" else F.pmod(angle, F.lit(360.0))
    ring = F.transform("i.polygon", lambda p: F.struct(F.get(p, F.lit(1)).alias("x"), F.get(p, F.lit(0)).alias("y")))
    return items.select(*keys, "item", ring.alias("ring"), bearing.alias("bearing"), F.col("i.grid.spacing").alias("spacing"), F.col("i.grid.altitude").alias("altitude"), F.coalesce("i.camera.key", "i.camera.name").alias("payload"))


def write_flight_plan(areas: DataFrame, keys: tuple[str, ...] = ("file",), order: str = "item") -> DataFrame:
    """(keys, text): one flight plan of each group of areas, in order. Read again it gives the same areas."""
    item = F.struct(
        F.lit("ComplexItem").alias("type"), F.lit("area").alias("complexItemType"), F.transform("ring", lambda p: F.array(p["y"], p["x"])).alias("polygon"),
        F.struct(F.col("bearing").alias("angle"), "spacing", "altitude").alias("grid"), F.struct(F.col("payload").alias("key")).alias("camera"),
    )
    placed = areas.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), item.alias("item")))), lambda s: s["item"]).alias("items"))
    return placed.select(*keys, F.to_json(F.struct(F.struct("items").alias("flightPlan"))).alias("text"))


def read_kml(texts: DataFrame, text: str = "text", keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """(keys, polygon, ring): the outer ring of every polygon of KML texts, closed; rings of under three points are left out."""
    outer = F.xpath(F.col(text), F.lit("//*[local-name()='Polygon']/*[local-name()='outerBoundaryIs']//*[local-name()='coordinates']/text()"))
    rows = texts.select(*keys, F.posexplode(outer).alias("polygon", "c"))
    pairs = F.transform(F.filter(F.split(F.trim(F.regexp_replace("c", r"\s+", " ")), " "), lambda p: p.contains(",")), lambda p: F.split(p, ","))
    point = lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y"))
    ring = F.filter(F.transform(pairs, point), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    rows = rows.select(*keys, "polygon", ring.alias("ring")).filter(F.size("ring") >= 3)
    closed = F.get("ring", F.lit(0)) == F.element_at("ring", -1)
    return rows.withColumn("ring", F.when(closed, F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1))))


def ring_bounds(rings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    p = rings.select(*keys, F.explode("ring").alias("p"))
    return p.groupBy(*keys).agg(*[f(f"p.{c}").alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")])


def read_poses(texts: DataFrame, text: str = "text", keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """(keys, id, time, lng, lat, alt, yaw, pitch, roll) of captures with coordinates in degrees; others are left out."""
    c = texts.select(*keys, F.explode(F.from_json(F.col(text), POSES)["captures"]).alias("c"))
    c = c.filter((F.size("c.coordinates") >= 2) & (F.col("c.crs").isNull() | F.col("c.crs").contains("4326")))
    at = lambda a, i, n: F.get(f"c.{a}", F.lit(i)).alias(n)
    return c.select(*keys, "c.id", F.to_timestamp("c.time").alias("time"), at("coordinates", 1, "lng"), at("coordinates", 0, "lat"), at("coordinates", 2, "alt"), at("orientation", 0, "yaw"), at("orientation", 1, "pitch"), at("orientation", 2, "roll"))


def read_geotags(texts: DataFrame, text: str = "text", keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Poses of the first processed flight of a file, else the first raw one, else the first; angles in radians become degrees."""
    flights = texts.select(*keys, F.posexplode(F.from_json(F.col(text), GEOTAGS)["flights"]).alias("i", "f"))
    rank = F.when(F.lower("f.kind").contains("processedforward"), 0).when(F.lower("f.kind").contains("raw"), 1).otherwise(2)
    first = flights.groupBy(*keys).agg(F.min_by("f.geotag", F.struct(rank, "i")).alias("tags"))
    tags = first.select(*keys, F.posexplode("tags").alias("seq", "t"))
    num = lambda c: c.try_cast("double")
    row = tags.select(*keys, "seq", *[num(F.get("t.coordinate", F.lit(i))).alias(n) for i, n in enumerate(("lat", "lng", "alt"))], *[num(F.col(f"t.{n}")).alias(n) for n in ("omega", "phi", "kappa")])
    radians = F.greatest(*[F.abs(n) for n in ("omega", "phi", "kappa")]) <= 6.3
    return row.select(*keys, "seq", "lng", "lat", "alt", *[F.when(radians, F.degrees(n)).otherwise(F.col(n)).alias(n) for n in ("omega", "phi", "kappa")])


def geojson(poses: DataFrame, keys: tuple[str, ...], id_col: str) -> DataFrame:
    """(keys, text): a feature collection of points by group."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lng", "lat", "alt").alias("coordinates")).alias("geometry"), F.struct(F.col(id_col).alias("id")).alias("properties"))
    return poses.groupBy(*keys).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("at"), feature.alias("f")))).getField("f").alias("features"))).alias("text"))


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def match_camera(spark: SparkSession, names: DataFrame, name: str = "name") -> DataFrame:
    """names with `camera`: the first of the registry whose key or a name of which equals it or begins it, or it begins, marks aside."""
    known = cameras(spark).select("seq", "key", F.explode("names").alias("n")).select("seq", "key", _plain(F.col("n")).alias("n"))
    given = _plain(F.col(name))
    fits = (F.length(given) > 0) & (given.startswith(F.col("n")) | F.col("n").startswith(given))
    distinct = names.select(name).distinct()
    found = distinct.join(F.broadcast(known), fits).groupBy(name).agg(F.min_by("key", F.struct(F.when(given == F.col("n"), 0).otherwise(1), "seq")).alias("camera"))
    return names.join(found, name, "left")


#: The lidar's key and its names in files.
LIDARS = [("WINGTRA_LIDAR_XT32M2X", ["LIDAR", "LIDAR_v5", "Wingtra Lidar", "Hesai XT32M2X", "WINGTRA_LIDAR_XT32M2X"])]
SENSORS = "struct<sensors: array<struct<name: string, internals: struct<focal_length_px: double, principal_point_px: array<double>>, image_size_px: array<int>, pixel_size_um: double>>>"
TRAJECTORY = ("GPSTime", "Easting", "Northing", "Height")


def _unversioned(name: Column) -> Column:
    """Letters and digits of a name in lower case, without a version number at its end."""
    return F.regexp_replace(_plain(name), "v[0-9]+$", "")


def resolve_payload(spark: SparkSession, payloads: DataFrame, name: str = "name", key: str = "key") -> DataFrame:
    """payloads with `lidar` and `camera`: the sensor that a plan's payload names.

    A sensor is known by its exact name, else by a plain one that equals the payload's, holds it or stands in it, with or without a
    version number at the end; the name counts before the key, the registry's order among equals. Without a match there is no
    lidar, and the camera is the registry's first. The registries are a few dozen names.
    """
    known = lambda rows, n: spark.createDataFrame([(i, k, x) for i, (k, xs) in enumerate(rows) for x in dict.fromkeys([k, *xs])], f"__seq int, {n} string, __n string")
    from ..functions.sensors import CAMERAS

    cameras_, lidars = known([(c[0], c[-1]) for c in CAMERAS], "camera"), known(LIDARS, "lidar")
    distinct = payloads.select(name, key).distinct()
    given = distinct.select(name, key, F.posexplode(F.array(F.col(name), F.col(key))).alias("__place", "__c")).filter("__c IS NOT NULL AND __c <> ''")
    a, b, p, q = _unversioned(F.col("__c")), _unversioned(F.col("__n")), _plain(F.col("__c")), _plain(F.col("__n"))
    either = lambda x, y: x.contains(y) | y.contains(x)
    fits = either(p, q) | ((F.length(a) > 0) & (F.length(b) > 0) & either(a, b))
    rank = F.when(F.col("__c") == F.col("__n"), 0).when(fits, 1)
    out = distinct
    for registry, column in ((lidars, "lidar"), (cameras_, "camera")):
        met = given.crossJoin(F.broadcast(registry)).withColumn("__rank", rank).filter("__rank IS NOT NULL")
        best = met.groupBy(F.col(name).alias("__name"), F.col(key).alias("__key")).agg(F.min_by(column, F.struct("__rank", "__place", "__seq")).alias(column))
        out = out.join(best, F.col(name).eqNullSafe(F.col("__name")) & F.col(key).eqNullSafe(F.col("__key")), "left").drop("__name", "__key")
    out = out.withColumn("camera", F.coalesce("camera", F.lit(CAMERAS[0][0])))
    own = out.select(F.col(name).alias("__name"), F.col(key).alias("__key"), "lidar", "camera")
    return payloads.join(own, F.col(name).eqNullSafe(F.col("__name")) & F.col(key).eqNullSafe(F.col("__key"))).drop("__name", "__key")


def read_camera_model(texts: DataFrame, text: str = "text", keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """(keys, f_m, sx_m, sy_m, w_px, h_px, cx_px, cy_px) of the first sensor of each file that has a focal length, a size and a pixel."""
    s = texts.select(*keys, F.posexplode(F.from_json(F.col(text), SENSORS)["sensors"]).alias("i", "s"))
    s = s.filter((F.col("s.internals.focal_length_px") != 0) & (F.size("s.image_size_px") == 2) & F.col("s.pixel_size_um").isNotNull())
    first = s.groupBy(*keys).agg(F.min_by("s", "i").alias("s"))
    pixel, at = F.col("s.pixel_size_um") * 1e-6, lambda c, i: F.get(F.col(c), F.lit(i))
    w, h = at("s.image_size_px", 0), at("s.image_size_px", 1)
    centre = lambda i, size: F.coalesce(at("s.internals.principal_point_px", i), size / 2)
    return first.select(*keys, (F.col("s.internals.focal_length_px") * pixel).alias("f_m"), pixel.alias("sx_m"), pixel.alias("sy_m"), w.alias("w_px"), h.alias("h_px"), centre(0, w).alias("cx_px"), centre(1, h).alias("cy_px"))


def read_trajectory(texts: DataFrame, text: str = "text", keys: tuple[str, ...] = ("file",), every: int = 1) -> DataFrame:
    """(keys, seq, time, x, y, z, speed) of every n-th row of tab-separated trajectories with a head line.

    Rows that aren't numbers are left out before they are counted; speed is that from the row before, null where time stands still.
    """
    from pyspark.sql import Window

    lines = texts.select(*keys, F.split(F.col(text), "\\r?\\n").alias("l"))
    head = F.split(F.get("l", F.lit(0)), "\\t")
    rows = lines.select(*keys, head.alias("h"), F.posexplode(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))).alias("line", "t")).withColumn("c", F.split("t", "\\t"))
    value = lambda n: F.get("c", F.array_position("h", F.lit(n)).cast("int") - 1).try_cast("double")
    rows = rows.select(*keys, "line", *[value(n).alias(c) for n, c in zip(TRAJECTORY, ("time", "x", "y", "z"), strict=True)]).filter("time IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    w = Window.partitionBy(*keys).orderBy("line")
    rows = rows.withColumn("__n", F.row_number().over(w) - 1).filter(F.col("__n") % every == 0).withColumn("seq", (F.col("__n") / every).cast("int"))
    before = lambda c: F.lag(c).over(w)
    passed = F.col("time") - before("time")
    way = F.sqrt(sum(((F.col(c) - before(c)) ** 2 for c in "xyz"), F.lit(0.0)))
    return rows.withColumn("speed", F.when(passed > 0, way / passed)).select(*keys, "seq", "time", "x", "y", "z", "speed")


def replace_areas(plans: DataFrame, areas: DataFrame, keys: list[str], sequenced: bool = False) -> DataFrame:
    """(keys, place, kind, area): the items of plans with others' areas in their area slots.

    plans: keys, item, kind; areas: keys, seq, area. The first slot takes the first area and so on; slots beyond the areas go, areas
    beyond the slots follow the last one, or the whole plan where it has none. sequenced: waypoints and loiters go too.
    """
    from pyspark.sql import Window

    items = plans.filter(~F.col("kind").isin("waypoint", "loiter")) if sequenced else plans
    w = Window.partitionBy(*keys)
    items = items.withColumn("slot", F.when(F.col("kind") == "area", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("item")) - 1))
    items = items.withColumns({"__slots": F.count("slot").over(w), "__last": F.coalesce(F.max(F.when(F.col("slot").isNotNull(), F.col("item"))).over(w), F.max("item").over(w))})
    own = areas.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")) - 1)
    kept = items.join(own.select(*keys, F.col("__place").alias("slot"), "area"), [*keys, "slot"], "left").filter("slot IS NULL OR area IS NOT NULL").select(*keys, F.col("item").cast("double").alias("at"), F.lit(0).alias("more"), "kind", "area")
    ends = items.groupBy(*keys).agg(F.max("__slots").alias("slots"), F.max("__last").cast("double").alias("at"))
    added = own.join(ends, keys).filter(F.col("__place") >= F.col("slots")).select(*keys, (F.col("at") + 0.5).alias("at"), (F.col("__place") + 1).alias("more"), F.lit("area").alias("kind"), "area")
    both = kept.unionByName(added)
    return both.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("at", "more")) - 1).alias("place"), "kind", "area")


def sequence_ends(plans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, take_off, landing): the first items of those kinds (kind, item, lng, lat, altitude, radius) with a point, an altitude and a radius over 0."""
    first = plans.filter(F.col("kind").isin("takeoff", "land")).groupBy(*keys, "kind").agg(F.min_by(F.struct("item", "lng", "lat", "altitude", "radius"), "item").alias("e"))
    good = first.filter("e.lng IS NOT NULL AND e.lat IS NOT NULL AND e.altitude IS NOT NULL AND e.radius > 0")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("e")))
    return good.groupBy(*keys).agg(of("takeoff").alias("take_off"), of("land").alias("landing"))


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """(request_id, name, text): a file of JSON lines for each request and name."""
    artifacts.write.mode("overwrite").partitionBy("request_id", "name").text(path)


# Ordered lists of ids, as arrays.


def append_ids(order: Column, ids: Column) -> Column:
    return F.array_distinct(F.concat(order, ids))


def remove_ids(order: Column, ids: Column) -> Column:
    return F.filter(order, lambda x: ~F.array_contains(ids, x))


def replace_ids(order: Column, gone: Column, by: Column) -> Column:
    """The ids of `by` where the first of `gone` stood, or at the end; those of `gone` removed."""
    at = F.array_position(F.transform(order, lambda x: F.array_contains(gone, x)), F.lit(True)).cast("int")
    before = F.when(at > 0, F.slice(order, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(order)
    after = F.when(at > 0, F.slice(order, F.greatest(at, F.lit(1)), F.size(order))).otherwise(F.slice(order, 1, 0))
    return F.array_distinct(F.concat(remove_ids(before, gone), by, remove_ids(after, gone)))
