"""Queries of joins by place over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sensors
from ..operators import generators, neighbours, raster, sequences, spatial
from ..sources.bindings import areas, cells, points, poses, table, with_tables


def _diamonds(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes over the points: a diamond for each supplier."""
    cx, cy, r = 40.0 + F.col("s_suppkey") * 17 % 960, 20.0 + F.col("s_suppkey") * 3, 30 + F.abs("s_acctbal") / 200
    corner = lambda dx, dy: F.struct((cx + dx * r).alias("x"), (cy + dy * r).alias("y"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("shape"), F.array(corner(-1, 0), corner(0, -1), corner(1, 0), corner(0, 1)).alias("ring"))


def contains_count(spark: SparkSession, sf: str) -> DataFrame:
    """Points in every shape; a point may lie in several."""
    found = spatial.contains(_diamonds(spark, sf), points(spark, sf).select("x", "y", "w"), ["shape"], 80.0)
    return found.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 2).alias("w"))


def neighbour_band(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted difference of each cell from those within 2.6 steps, weights falling with the distance."""
    c = cells(spark, sf).select("cell", (F.col("col") * 100.0).alias("x"), (F.col("row") * 100.0).alias("y"), "z")
    pairs = spatial.within(c, c, 260.0).filter("cell <> r_cell")
    w = 1 - F.col("distance") / 260.0
    return pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("near"), F.round(F.sum(w * F.abs(F.col("z") - F.col("r_z"))) / F.sum(w), 4).alias("contrast"))


def strip_tiles(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("strip"), (F.col("s_suppkey") * 37.0 % 900).alias("x1"), (F.col("s_suppkey") * 11.0).alias("y1"), (F.col("s_suppkey") * 37.0 % 900 + 400).alias("x2"), (F.col("s_suppkey") * 11.0 + 90).alias("y2"))
    tiles = spatial.strips_to_tiles(s, ["strip"], 45.0, 256.0).groupBy("strip").agg(F.count(F.lit(1)).alias("tiles"), F.sum(F.col("tx") * 1000 + F.col("ty")).alias("key_sum"))
    lo, hi = spatial.clip_to_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), (256.0, 256.0, 1024.0, 1024.0))
    return tiles.join(s.select("strip", F.round(lo, 6).alias("part_from"), F.round(hi, 6).alias("part_to")), "strip")


def _tiles(spark: SparkSession, sf: str) -> DataFrame:
    """All cells as tiles of 20 by 20 pixels."""
    return cells(spark, sf).select(F.floor(F.col("row") / 20).alias("tile"), (F.col("row") % 20).alias("row"), "col", "z", "cell")


def bilinear_sample(spark: SparkSession, sf: str) -> DataFrame:
    p = poses(spark, sf).select("event_id", F.floor(F.col("event_id") / 100).alias("tile"), (F.col("event_id") % 431 / 20.0 - 0.7).alias("c"), (F.col("user_id") % 397 / 19.0 - 0.7).alias("r"))
    found = raster.sample_bilinear(p, _tiles(spark, sf).select("tile", "row", "col", "z"), ["tile"], F.col("c"), F.col("r"), 20)
    return found.select("event_id", F.round("z", 4).alias("z"))


def raster_overlay(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).select("row", "col", "z")
    over = c.filter((F.col("row") + F.col("col")) % 3 == 0).withColumn("z", F.col("z") - 400)
    return raster.overlay(c, over, ["row", "col"]).select("row", "col", F.round("z", 3).alias("z"))


def eroded_mask(spark: SparkSession, sf: str) -> DataFrame:
    return raster.erode(_tiles(spark, sf).filter("cell % 13 <> 0").select("tile", "row", "col"), ["tile"], 20, 1)


def smoothed_raster(spark: SparkSession, sf: str) -> DataFrame:
    c = _tiles(spark, sf).select("tile", "row", "col", F.when(F.col("cell") % 9 != 0, F.col("z")).otherwise(0.0).alias("v"))
    return raster.smooth(c, ["tile"], 20).select("tile", "row", "col", F.round("v", 4).alias("v"))


def surface_normals(spark: SparkSession, sf: str) -> DataFrame:
    return raster.normals(_tiles(spark, sf), ["tile"], 30.0).select("tile", "row", "col", *[F.round(n, 6).alias(n) for n in ("nx", "ny", "nz")])


def halo_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell as a map tile beside those around it; the columns lie across the map's edge, where it is joined."""
    t = cells(spark, sf).select(F.pmod(F.col("col") - 10, F.lit(1 << 20)).alias("x"), F.col("row").alias("y"), "z")
    return raster.halo(t, 20, 1).groupBy("x", "y").agg(F.count(F.lit(1)).alias("tiles"), F.round(F.sum(F.col("z") * (F.col("dx") + 3 * F.col("dy") + 5)), 3).alias("mix"))


def region_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neighbours.region_adjacency(cells(spark, sf), "region", 100.0)
    return pairs.select("region_a", "region_b", "boundary", F.round("strength", 3).alias("strength"))


def connection_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Every ordered pair of a mission's areas, both ways round at either end: metres, climb, seconds and cost."""
    a = areas(spark, sf).select(F.floor(F.col("area_id") / 6).alias("mission"), "area_id", "half", ((F.col("lng") - 8.5) * 75000).alias("x"), (F.col("area_id") * 37 % 211 + 400.0).alias("z"))
    return sequences.connections(a, ["mission"], "area_id", 16.0, 4.0, 3.0).select("mission", "area_id", "to_area", "flip", "to_flip", *[F.round(c, 4).alias(c) for c in ("metres", "seconds", "cost")])


def rasterized(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of every diamond, tile by tile of 128 pixels, as many tiles as it reaches."""
    found = generators.rasterize_tiles(_quarter(spark, sf), ["shape"], 128)
    return found.groupBy("shape").agg(F.countDistinct("tx", "ty").alias("tiles"), F.count(F.lit(1)).alias("pixels"), F.sum((F.col("ty") * 128 + F.col("row")) * 7 + F.col("tx") * 128 + F.col("col")).alias("key_sum"))


def _quarter(spark: SparkSession, sf: str) -> DataFrame:
    return _diamonds(spark, sf).select("shape", F.transform("ring", lambda p: F.struct((p["x"] / 4).alias("x"), (p["y"] / 4).alias("y"))).alias("ring"))


def mask_union(spark: SparkSession, sf: str) -> DataFrame:
    """Eroded masks of all diamonds of a group, as one, tile by tile."""
    rings = generators.in_tiles(_quarter(spark, sf), ["shape"], 128).withColumn("group", F.col("shape") % 5)
    mask = raster.polygon_mask(rings, ["group", "shape", "tx", "ty"], ["group", "tx", "ty"], 128, 1)
    return mask.groupBy("group", "tx", "ty").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("row") * 7 + F.col("col")).alias("key_sum"))


def tile_set(spark: SparkSession, sf: str) -> DataFrame:
    """The tiles of all areas, each once."""
    return tile_cover(spark, sf).select("tx", "ty").distinct()


def tile_cover(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.geo import mercator_x, mercator_y

    a = areas(spark, sf).select("area_id", *[f(F.col(c) + s * F.col("half")).alias(n) for n, f, c, s in (("min_x", mercator_x, "lng", -1), ("max_x", mercator_x, "lng", 1), ("min_y", mercator_y, "lat", -1), ("max_y", mercator_y, "lat", 1))])
    return generators.tile_cover(a, ["area_id"], 16, 1)


def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of 24 m of every diamond: how many, and their clipped area."""
    return generators.grid_cells(_diamonds(spark, sf), ["shape"], 24.0).groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 3).alias("area"))


def _ground(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).select(F.col("cell").alias("pixel"), (F.col("col") * 25.0).alias("x"), (F.col("row") * 25.0).alias("y"), (F.col("z") / 50).alias("z"))
    return c.withColumns({"nx": F.lit(-0.05), "ny": F.lit(0.0), "nz": F.lit(0.9987)})


def _shots(spark: SparkSession, sf: str) -> DataFrame:
    """Every pose over the cells' plane, with one of the registry's cameras or a number that is none."""
    p = poses(spark, sf).select(F.col("event_id").alias("pose"), (F.col("event_id") % 8).cast("int").alias("camera"), (F.col("event_id") * 13 % 500).cast("double").alias("x"), (F.col("event_id") / 4).alias("y"), (20 + F.col("alt") / 50).alias("z"), F.lit(20.0).alias("ground"), (F.col("event_id") % 21 - 10.0).alias("o"), (F.col("user_id") % 15 - 7.0).alias("p"), (F.col("event_id") % 360).cast("double").alias("k"))
    return p.withColumns(sensors.rotation(F.col("o"), F.col("p"), F.col("k")))


def camera_tile(spark: SparkSession, sf: str) -> DataFrame:
    """Resolution and overlap of every terrain pixel under all nadir and oblique poses and their cameras."""
    seen = spatial.at_least(spatial.visible(_ground(spark, sf), _shots(spark, sf), sensors.cameras(spark), 20.0), 2)
    return seen.select("pixel", "overlap", F.round("gsd", 7).alias("gsd"))


def camera_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The poses that see each terrain region."""
    seen = spatial.views(_ground(spark, sf), _shots(spark, sf), sensors.cameras(spark), 20.0)
    return spatial.hit_ids(seen, cells(spark, sf).select(F.col("cell").alias("pixel"), "region"), ["region"])


def tile_candidates(spark: SparkSession, sf: str) -> DataFrame:
    t = cells(spark, sf).select((F.col("col") * 25.0).alias("x0"), (F.col("row") * 25.0).alias("y0"), "cell").select("cell", "x0", "y0", (F.col("x0") + 25).alias("x1"), (F.col("y0") + 25).alias("y1"))
    p = _shots(spark, sf).select("pose", "x", "y", (F.col("pose") % 7 * 3.0).alias("reach")).filter("pose % 3 = 0")
    return spatial.candidates(t, p, ["cell"], 25.0)


def lidar_tile(spark: SparkSession, sf: str) -> DataFrame:
    """Point density of all terrain tiles of 20 by 20 pixels under every flight strip that can reach them."""
    from ..operators.lidar import density

    n = F.col("s_suppkey")
    strips = table(spark, sf, "supplier").select(n.alias("strip"), (n * 13.0 % 160).alias("x1"), (n * 47.0).alias("y1"), F.lit(80.0).alias("z1"), (n * 13.0 % 160).alias("x2"), (n * 47.0 + 160).alias("y2"), F.lit(80.0).alias("z2"), F.lit(16.0).alias("speed"), F.lit(160000.0).alias("rate"))
    met = spatial.strips_to_tiles(strips, strips.columns, 120.0, 160.0).filter("tx = 0").withColumnRenamed("ty", "tile")
    met = met.withColumns({c: F.col(c) - F.col("tile") * 160.0 for c in ("y1", "y2")}).drop("tx")
    ground = _tiles(spark, sf).select("tile", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), (F.col("z") / 100).alias("z"))
    return density(ground, met, 8.0).select("tile", "row", "col", "passes", F.round("density", 3).alias("density"))


def overlay_blend(spark: SparkSession, sf: str) -> DataFrame:
    """A surface over the terrain where it is valid: not NaN, not the no-data value, not clear."""
    c = cells(spark, sf).select("row", "col", "z", "cell")
    z = F.when(F.col("cell") % 5 == 0, F.lit(float("nan"))).when(F.col("cell") % 7 == 0, -9999.0).otherwise(F.col("z") - 250)
    over = c.filter("cell % 2 = 0").select("row", "col", z.alias("z"), (F.col("cell") % 11).cast("double").alias("alpha"))
    return raster.overlay(c, over, ["row", "col"], nodata=-9999.0, alpha="alpha").select("row", "col", F.round("z", 3).alias("z"))


def overlay_coded(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.terrain import encode

    c = cells(spark, sf)
    base = c.select("row", "col", *[v.alias(n) for n, v in zip("rgb", encode(F.col("z")), strict=True)], (F.col("cell") % 256).cast("int").alias("a"))
    return raster.overlay_coded(base, c.filter("cell % 3 = 0").select("row", "col", (F.col("z") - 700).alias("z")), ["row", "col"])


def reprojected(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of each tile sampled at the places of poses, only where all four around are valid."""
    src = _tiles(spark, sf).select("tile", "row", "col", "z", (F.col("cell") % 17 != 0).alias("valid"))
    p = poses(spark, sf).select("event_id", F.floor(F.col("event_id") / 100).alias("tile"), (F.col("event_id") % 431 / 20.0 - 0.7).alias("c"), (F.col("user_id") % 397 / 19.0 - 0.7).alias("r"))
    return raster.reproject(p, src, ["tile"], F.col("c"), F.col("r"), 20, 20, 0.5).select("event_id", F.round("z", 4).alias("z"))


def tile_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Heights under every pose from map tiles, bilinear and of the pixel."""
    from ..functions.geo import WORLD

    side = WORLD / (1 << 14)
    tiles = _tiles(spark, sf).select(F.lit(8000).cast("long").alias("tx"), (F.col("tile") + 5000).alias("ty"), "row", "col", "z")
    n = F.col("event_id")
    p = poses(spark, sf).select("event_id", ((8000 + n % 613 / 613) * side - WORLD / 2).alias("x"), (WORLD / 2 - (5000 + n / 200.3) * side).alias("y"))
    soft = raster.sample_tiles(p, tiles, 14, 20).select("event_id", F.round("z", 4).alias("z"))
    return soft.join(raster.sample_tiles(p, tiles, 14, 20, nearest=True).select("event_id", F.round("z", 4).alias("pixel_z")), "event_id")


def contour_directions(spark: SparkSession, sf: str) -> DataFrame:
    """The mean direction of the contours of every tile, by a kernel of nine."""
    f = raster.contour_direction(_tiles(spark, sf), ["tile"], ["tile"], 30.0)
    return f.select("tile", "samples", F.round("contour", 4).alias("contour"), F.round("dispersion", 6).alias("dispersion"))


def heat_images(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap, resolution and density of every cell as colours."""
    c = cells(spark, sf).select("cell", (F.col("cell") % 9).alias("overlap"), F.when(F.col("cell") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("z") / 30000).alias("gsd"), (F.col("cell") % 130 - 10.0).alias("density"))
    packed = lambda df, n: df.withColumn(n, ((F.col("r").cast("long") * 256 + F.col("g")) * 256 + F.col("b")) * 256 + F.col("a")).drop("r", "g", "b", "a")
    for value, kind, low, high in (("overlap", "overlap", 0.0, 6.0), ("gsd", "resolution", 0.01, 0.06), ("density", "density", 10.0, 100.0)):
        c = packed(raster.heat_image(c, value, kind, low, high), f"{kind}_rgba")
    return c.select("cell", "overlap_rgba", "resolution_rgba", "density_rgba")


def geoid_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Poses' heights above the ellipsoid by a table of undulations in steps of 15 degrees."""
    grid = spark.range(13 * 24).select(F.floor(F.col("id") / 24).alias("row"), (F.col("id") % 24).alias("col")).withColumn("z", (F.col("row") * 7 + F.col("col") * 5) % 100 - 50.0)
    p = poses(spark, sf).select("event_id", (F.col("event_id") % 3600 / 10.0 - 180).alias("lng"), (F.col("user_id") % 1700 / 10.0 - 85).alias("lat"), F.col("alt").alias("z"))
    return raster.ellipsoid_heights(p, grid, F.col("lng"), F.col("lat"), 15.0).select("event_id", F.round("z", 4).alias("z"))


QUERIES = {f.__name__: f for f in (contains_count, neighbour_band, strip_tiles, bilinear_sample, raster_overlay, eroded_mask, smoothed_raster, surface_normals, halo_tiles, region_adjacency, connection_matrix, rasterized, mask_union, tile_set, tile_cover, grid_cells, camera_tile, camera_hits, tile_candidates, lidar_tile, overlay_blend, overlay_coded, reprojected, tile_heights, contour_directions, heat_images, geoid_heights)}

_DIAMOND = "SELECT s_suppkey AS shape, 40::DOUBLE + s_suppkey * 17 % 960 AS cx, 20::DOUBLE + s_suppkey * 3 AS cy, 30 + abs(s_acctbal) / 200 AS r FROM supplier"
_STRIP = "SELECT s_suppkey AS strip, (s_suppkey * 37 % 900)::DOUBLE AS x1, s_suppkey * 11::DOUBLE AS y1, (s_suppkey * 37 % 900 + 400)::DOUBLE AS x2, s_suppkey * 11::DOUBLE + 90 AS y2 FROM supplier"
_TILES = "t AS (SELECT row // 20 AS tile, row % 20 AS row, col, z, cell FROM cells)"
_QUARTER = f"s AS (SELECT shape, cx / 4 AS cx, cy / 4 AS cy, r / 4 AS r FROM ({_DIAMOND}))"
_PIXELS = f"{_QUARTER}, h AS (SELECT shape, cx, cy, r, unnest(range(floor(cy - r)::BIGINT - 1, ceil(cy + r)::BIGINT + 1)) AS gy FROM s), w AS (SELECT shape, gy, ceil(cx - (r - abs(gy + 0.5 - cy)))::BIGINT AS a, floor(cx + (r - abs(gy + 0.5 - cy)))::BIGINT AS b FROM h WHERE abs(gy + 0.5 - cy) < r), p AS (SELECT shape, gy, unnest(range(a, b + 1)) AS gx FROM w)"
_SAMPLES = "p AS (SELECT event_id, event_id // 100 AS tile, event_id % 431 / 20::DOUBLE - 0.7::DOUBLE AS c, user_id % 397 / 19::DOUBLE - 0.7::DOUBLE AS r FROM poses)"
_CAMERAS = "k(camera, f, sx, sy, w, h) AS (VALUES " + ", ".join(f"({i}, {f!r}::DOUBLE, {sx!r}::DOUBLE, {sy!r}::DOUBLE, {w}, {h})" for i, (_, f, sx, sy, w, h, _) in enumerate(sensors.CAMERAS)) + ")"
_SHOTS = """p AS (SELECT event_id AS pose, CASE WHEN event_id % 8 < 7 THEN event_id % 8 ELSE 0 END AS camera, (event_id * 13 % 500)::DOUBLE AS px, event_id / 4::DOUBLE AS py, 20 + alt / 50 AS pz, radians(event_id % 21 - 10::DOUBLE) AS o, radians(user_id % 15 - 7::DOUBLE) AS ph, radians((event_id % 360)::DOUBLE) AS ka FROM poses)"""
_VIEWS = f"""{_CAMERAS}, {_SHOTS}, q AS (SELECT p.*, f, sx, sy, w, h, greatest(1, pz - 20) * sqrt(pow(w * sx, 2) + pow(h * sy, 2)) / 2 / f * 1.25 AS reach, cos(ka) * cos(ph) AS r11, cos(ka) * sin(ph) * sin(o) - sin(ka) * cos(o) AS r12, cos(ka) * sin(ph) * cos(o) + sin(ka) * sin(o) AS r13,
    sin(ka) * cos(ph) AS r21, sin(ka) * sin(ph) * sin(o) + cos(ka) * cos(o) AS r22, sin(ka) * sin(ph) * cos(o) - cos(ka) * sin(o) AS r23, -sin(ph) AS r31, cos(ph) * sin(o) AS r32, cos(ph) * cos(o) AS r33 FROM p JOIN k ON k.camera = p.camera),
    g AS (SELECT cell AS pixel, region, col * 25::DOUBLE AS x, row * 25::DOUBLE AS y, z / 50 AS z FROM cells),
    d AS (SELECT pixel, region, pose, f, sx, sy, w, h, x - px AS dx, y - py AS dy, z - pz AS dz, r11, r12, r13, r21, r22, r23, r31, r32, r33 FROM g JOIN q ON abs(x - px) <= reach AND abs(y - py) <= reach WHERE pow(x - px, 2) + pow(y - py, 2) <= reach * reach),
    c AS (SELECT *, r11 * dx + r21 * dy + r31 * dz AS cx, r12 * dx + r22 * dy + r32 * dz AS cy, r13 * dx + r23 * dy + r33 * dz AS cz, 0.05 * dx - 0.9987 * dz AS away FROM d),
    i AS (SELECT *, f * cx / cz AS um, f * cy / cz AS vm FROM c WHERE cz < -1e-9),
    v AS (SELECT *, r11 * um + r12 * vm + r13 * f AS a1, r21 * um + r22 * vm + r23 * f AS a2, r31 * um + r32 * vm + r33 * f AS a3 FROM i WHERE w / 2::DOUBLE - um / sx >= 0 AND w / 2::DOUBLE - um / sx < w AND h / 2::DOUBLE - vm / sy >= 0 AND h / 2::DOUBLE - vm / sy < h AND away > 1e-3 * sqrt(dx * dx + dy * dy + dz * dz)),
    n AS (SELECT *, -0.05 * a1 + 0.9987 * a3 AS dt, -0.05 * r11 + 0.9987 * r31 AS n1, -0.05 * r12 + 0.9987 * r32 AS n2 FROM v),
    views AS (SELECT pixel, region, pose, sqrt(sqrt(pow(dt * r11 - n1 * a1, 2) + pow(dt * r21 - n1 * a2, 2) + pow(dt * r31 - n1 * a3, 2)) * abs(away) / (dt * dt) * sx * sqrt(pow(dt * r12 - n2 * a1, 2) + pow(dt * r22 - n2 * a2, 2) + pow(dt * r32 - n2 * a3, 2)) * abs(away) / (dt * dt) * sy) AS gsd FROM n WHERE abs(dt) >= 1e-12)"""


def _ramp(t: str) -> str:
    """A display colour as r * 65536 + g * 256 + b."""
    up, down = lambda a: f"floor(255 * (t - {a}) / 0.25 + 0.5)", lambda a: f"floor(255 * (1 - (t - {a}) / 0.25) + 0.5)"
    r, g, b = f"CASE WHEN t < 0.5 THEN 0 WHEN t < 0.75 THEN {up(0.5)} ELSE 255 END", f"CASE WHEN t < 0.25 THEN {up(0)} WHEN t < 0.75 THEN 255 ELSE {down(0.75)} END", f"CASE WHEN t < 0.25 THEN 255 WHEN t < 0.5 THEN {down(0.25)} ELSE 0 END"
    return f"((({r}) * 65536 + ({g}) * 256 + ({b})) * 256 + 200)::BIGINT".replace("(t ", f"(({t}) ").replace("WHEN t <", f"WHEN ({t}) <")


ORACLE = {
    "contains_count": with_tables(f"WITH s AS ({_DIAMOND}) SELECT shape, count(*) AS n, round(sum(w), 2) AS w FROM s JOIN points ON abs(x - cx) + abs(y - cy) < r GROUP BY shape", "points"),
    "neighbour_band": with_tables("SELECT a.cell, count(*) AS near, round(sum((1 - d / 260) * abs(a.z - b.z)) / sum(1 - d / 260), 4) AS contrast FROM (SELECT a.cell, a.z, b.z AS bz, b.cell AS bc, sqrt(pow((a.col - b.col) * 100, 2) + pow((a.row - b.row) * 100, 2)) AS d FROM cells a JOIN cells b ON a.cell <> b.cell AND abs(a.col - b.col) <= 2 AND abs(a.row - b.row) <= 2) a JOIN cells b ON b.cell = a.bc WHERE d <= 260 GROUP BY a.cell", "cells"),
    "strip_tiles": f"""WITH s AS ({_STRIP}), b AS (SELECT *, unnest(range(-3, 20)) AS tx FROM s), t AS (SELECT *, unnest(range(-3, 60)) AS ty FROM b),
        k AS (SELECT strip, count(*) AS tiles, sum(tx * 1000 + ty)::BIGINT AS key_sum FROM t WHERE x1 - 45 <= (tx + 1) * 256 AND x2 + 45 >= tx * 256 AND y1 - 45 <= (ty + 1) * 256 AND y2 + 45 >= ty * 256 GROUP BY strip),
        c AS (SELECT strip, greatest(0, (256 - x1) / (x2 - x1), (256 - y1) / (y2 - y1)) AS lo, least(1, (1024 - x1) / (x2 - x1), (1024 - y1) / (y2 - y1)) AS hi FROM s)
        SELECT strip, tiles, key_sum, round(CASE WHEN lo <= hi THEN lo END, 6) AS part_from, round(CASE WHEN lo <= hi THEN hi END, 6) AS part_to FROM k JOIN c USING (strip)""",
    "raster_overlay": with_tables("SELECT row, col, round(CASE WHEN (row + col) % 3 = 0 THEN z - 400 ELSE z END, 3) AS z FROM cells", "cells"),
    "region_adjacency": with_tables(
        """WITH g AS (SELECT c.cell, c.region, c.row, c.col, coalesce((e.z - w.z) / 200, (e.z - c.z) / 100, (c.z - w.z) / 100) AS gx, coalesce((n.z - s.z) / 200, (n.z - c.z) / 100, (c.z - s.z) / 100) AS gy FROM cells c
          LEFT JOIN cells e ON e.row = c.row AND e.col = c.col + 1 LEFT JOIN cells w ON w.row = c.row AND w.col = c.col - 1 LEFT JOIN cells n ON n.row = c.row + 1 AND n.col = c.col LEFT JOIN cells s ON s.row = c.row - 1 AND s.col = c.col),
        f1 AS (SELECT *, sqrt(gx * gx + gy * gy) AS slope, CASE WHEN sqrt(gx * gx + gy * gy) <= 1e-6 THEN 0 ELSE fmod(degrees(atan2(gx, gy)) + 360, 360::DOUBLE) END AS aspect FROM g),
        f AS (SELECT *, CASE WHEN slope <= 1e-6 THEN 0 ELSE fmod(aspect + 90, 180::DOUBLE) END AS pref FROM f1),
        b AS (SELECT a.cell, avg(least(abs(a.aspect - o.aspect), 360 - abs(a.aspect - o.aspect))) AS da, avg(least(abs(a.pref - o.pref), 180 - abs(a.pref - o.pref))) AS dp, avg(abs(a.slope - o.slope)) AS ds FROM f a JOIN f o ON o.slope IS NOT NULL AND ((o.row = a.row AND abs(o.col - a.col) = 1) OR (o.col = a.col AND abs(o.row - a.row) = 1)) GROUP BY a.cell),
        k AS (SELECT f.cell, f.region, f.row, f.col, coalesce((0.65 * da + 0.35 * dp + 70 * ds) * greatest(0.3, least(1.8, slope / 0.18)), 0) AS s FROM f LEFT JOIN b USING (cell))
        SELECT least(a.region, b.region) AS region_a, greatest(a.region, b.region) AS region_b, count(*) * 100::DOUBLE AS boundary, round(avg((a.s + b.s) / 2), 3) AS strength FROM k a JOIN k b ON ((b.row = a.row AND b.col = a.col + 1) OR (b.col = a.col AND b.row = a.row + 1)) AND a.region <> b.region GROUP BY ALL""",
        "cells",
    ),
    "tile_cover": with_tables(
        """WITH w AS (SELECT area_id, 2 * pi() * 6378137 / 65536 AS side, radians(lng - half) * 6378137 AS x0, radians(lng + half) * 6378137 AS x1, 6378137 * ln(tan(pi() / 4 + radians(lat - half) / 2)) AS y0, 6378137 * ln(tan(pi() / 4 + radians(lat + half) / 2)) AS y1 FROM areas),
        t AS (SELECT area_id, unnest(range(floor((x0 + pi() * 6378137) / side)::BIGINT - 1, floor((x1 + pi() * 6378137) / side)::BIGINT + 2)) AS tx, floor((pi() * 6378137 - y1) / side)::BIGINT - 1 AS a, floor((pi() * 6378137 - y0) / side)::BIGINT + 2 AS b FROM w) SELECT area_id, tx, unnest(range(a, b)) AS ty FROM t""",
        "areas",
    ),
    "bilinear_sample": with_tables(
        f"""WITH {_TILES}, {_SAMPLES}, q AS (SELECT *, greatest(0, least(18, floor(c)))::BIGINT AS c0, greatest(0, least(18, floor(r)))::BIGINT AS r0 FROM p), f AS (SELECT *, greatest(0, least(1, c - c0)) AS fc, greatest(0, least(1, r - r0)) AS fr FROM q)
        SELECT event_id, round(CASE WHEN c BETWEEN -0.5 AND 19.5 AND r BETWEEN -0.5 AND 19.5 THEN (a.z + (b.z - a.z) * fc) * (1 - fr) + (d.z + (e.z - d.z) * fc) * fr END, 4) AS z FROM f LEFT JOIN t a ON a.tile = f.tile AND a.row = r0 AND a.col = c0 LEFT JOIN t b ON b.tile = f.tile AND b.row = r0 AND b.col = c0 + 1 LEFT JOIN t d ON d.tile = f.tile AND d.row = r0 + 1 AND d.col = c0 LEFT JOIN t e ON e.tile = f.tile AND e.row = r0 + 1 AND e.col = c0 + 1""",
        "poses", "cells",
    ),
    "reprojected": with_tables(
        f"""WITH {_TILES}, v AS (SELECT tile, row, col, z FROM t WHERE cell % 17 <> 0), {_SAMPLES}, f AS (SELECT *, floor(c)::BIGINT AS c0, floor(r)::BIGINT AS r0 FROM p)
        SELECT event_id, round(CASE WHEN c BETWEEN 0 AND 19 AND r BETWEEN 0 AND 19 THEN ((a.z + (b.z - a.z) * (c - c0)) * (1 - (r - r0)) + (d.z + (e.z - d.z) * (c - c0)) * (r - r0)) * 0.5 END, 4) AS z FROM f LEFT JOIN v a ON a.tile = f.tile AND a.row = r0 AND a.col = c0 LEFT JOIN v b ON b.tile = f.tile AND b.row = r0 AND b.col = least(19, c0 + 1)
        LEFT JOIN v d ON d.tile = f.tile AND d.row = least(19, r0 + 1) AND d.col = c0 LEFT JOIN v e ON e.tile = f.tile AND e.row = least(19, r0 + 1) AND e.col = least(19, c0 + 1)""",
        "poses", "cells",
    ),
    "tile_heights": with_tables(
        f"""WITH {_TILES}, p AS (SELECT event_id, 0.0::DOUBLE AS zero, event_id % 613 / 613::DOUBLE AS fx, event_id / 200.3::DOUBLE - floor(event_id / 200.3::DOUBLE) AS fy, floor(event_id / 200.3::DOUBLE)::BIGINT AS tile FROM poses),
        q AS (SELECT *, fx * 19 AS c, fy * 19 AS r, least(18, floor(fx * 19))::BIGINT AS c0, least(18, floor(fy * 19))::BIGINT AS r0 FROM p)
        SELECT event_id, round((a.z + (b.z - a.z) * (c - c0)) * (1 - (r - r0)) + (d.z + (e.z - d.z) * (c - c0)) * (r - r0), 4) AS z, round(n.z, 4) AS pixel_z FROM q LEFT JOIN t a ON a.tile = q.tile AND a.row = r0 AND a.col = c0 LEFT JOIN t b ON b.tile = q.tile AND b.row = r0 AND b.col = c0 + 1
        LEFT JOIN t d ON d.tile = q.tile AND d.row = r0 + 1 AND d.col = c0 LEFT JOIN t e ON e.tile = q.tile AND e.row = r0 + 1 AND e.col = c0 + 1 LEFT JOIN t n ON n.tile = q.tile AND n.row = floor(fy * 20 + 1e-9) AND n.col = floor(fx * 20 + 1e-9)""",
        "poses", "cells",
    ),
    "eroded_mask": with_tables(f"WITH {_TILES}, m AS (SELECT tile, row, col FROM t WHERE cell % 13 <> 0) SELECT a.tile, a.row, a.col FROM m a JOIN m b ON a.tile = b.tile AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 WHERE a.row BETWEEN 1 AND 18 AND a.col BETWEEN 1 AND 18 GROUP BY a.tile, a.row, a.col HAVING count(*) = 9", "cells"),
    "smoothed_raster": with_tables(
        f"WITH {_TILES}, m AS (SELECT tile, row, col, CASE WHEN cell % 9 <> 0 THEN z ELSE 0 END AS v FROM t), s AS (SELECT a.tile, a.row, a.col, sum(b.v * (2 - abs(a.row - b.row)) * (2 - abs(a.col - b.col))) / sum((2 - abs(a.row - b.row)) * (2 - abs(a.col - b.col))) AS s FROM m a JOIN m b ON a.tile = b.tile AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND b.v > 0 GROUP BY ALL) SELECT m.tile, m.row, m.col, round(CASE WHEN m.row IN (0, 19) OR m.col IN (0, 19) OR m.v = 0 THEN m.v ELSE s END, 4) AS v FROM m LEFT JOIN s USING (tile, row, col)",
        "cells",
    ),
    "surface_normals": with_tables(
        f"""WITH {_TILES}, n AS (SELECT a.tile, a.row, a.col, (coalesce(e.z, a.z) - coalesce(w.z, a.z)) / (CASE WHEN e.z IS NULL OR w.z IS NULL THEN 30 ELSE 60 END) AS gx, (coalesce(s.z, a.z) - coalesce(o.z, a.z)) / (CASE WHEN s.z IS NULL OR o.z IS NULL THEN 30 ELSE 60 END) AS gy
        FROM t a LEFT JOIN t e ON e.tile = a.tile AND e.row = a.row AND e.col = a.col + 1 LEFT JOIN t w ON w.tile = a.tile AND w.row = a.row AND w.col = a.col - 1 LEFT JOIN t s ON s.tile = a.tile AND s.row = a.row + 1 AND s.col = a.col LEFT JOIN t o ON o.tile = a.tile AND o.row = a.row - 1 AND o.col = a.col)
        SELECT tile, row, col, round(-gx / sqrt(gx * gx + gy * gy + 1), 6) AS nx, round(-gy / sqrt(gx * gx + gy * gy + 1), 6) AS ny, round(1 / sqrt(gx * gx + gy * gy + 1), 6) AS nz FROM n""",
        "cells",
    ),
    "contour_directions": with_tables(
        f"""WITH {_TILES}, g AS (SELECT a.tile, a.row, a.col, sum((b.col - a.col) * (2 - abs(b.row - a.row)) * b.z) / 240 AS gx, -sum((b.row - a.row) * (2 - abs(b.col - a.col)) * b.z) / 240 AS gy FROM t a JOIN t b ON a.tile = b.tile AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL HAVING count(*) = 9),
        h AS (SELECT tile, atan2(-gy, gx) AS th FROM g WHERE sqrt(gx * gx + gy * gy) >= 1e-6)
        SELECT tile, count(*) AS samples, round(CASE WHEN count(*) >= 10 THEN fmod(degrees(atan2(sum(sin(th)), sum(cos(th)))) + 360, 360::DOUBLE) END, 4) AS contour, round(CASE WHEN count(*) >= 10 THEN 1 - sqrt(pow(avg(sin(th)), 2) + pow(avg(cos(th)), 2)) END, 6) AS dispersion FROM h GROUP BY tile""",
        "cells",
    ),
    "halo_tiles": with_tables("WITH t AS (SELECT (col - 10 + 1048576) % 1048576 AS x, row AS y, z FROM cells), w AS (SELECT x, y, (x + dx + 1048576) % 1048576 AS nx, greatest(0, y + dy) AS ny, dx, dy FROM t, range(-1, 2) p(dx), range(-1, 2) q(dy)) SELECT w.x, w.y, count(*) AS tiles, round(sum(b.z * (dx + 3 * dy + 5)), 3) AS mix FROM w JOIN t b ON b.x = nx AND b.y = ny GROUP BY w.x, w.y", "cells"),
    "connection_matrix": with_tables(
        """WITH a AS (SELECT area_id // 6 AS mission, area_id, flip::INTEGER AS flip, (lng - 8.5::DOUBLE) * 75000 + (CASE WHEN flip = 0 THEN 1 ELSE -1 END) * half * 75000 AS out, (lng - 8.5::DOUBLE) * 75000 - (CASE WHEN flip = 0 THEN 1 ELSE -1 END) * half * 75000 AS come, area_id * 37 % 211 + 400::DOUBLE AS z FROM areas, range(2) t(flip)),
        c AS (SELECT a.mission, a.area_id, b.area_id AS to_area, a.flip, b.flip AS to_flip, abs(a.out - b.come) AS m, greatest(0, b.z - a.z) / 4 AS up, greatest(0, a.z - b.z) / 3 AS down FROM a JOIN a b ON a.mission = b.mission AND a.area_id <> b.area_id)
        SELECT mission, area_id, to_area, flip, to_flip, round(m, 4) AS metres, round(greatest(m / 16, up, down), 4) AS seconds, round(m / 16 + 2.5 * up + 0.6 * down, 4) AS cost FROM c""",
        "areas",
    ),
    "rasterized": f"WITH {_PIXELS} SELECT shape, count(DISTINCT (gx // 128, gy // 128)) AS tiles, count(*) AS pixels, sum(gy * 7 + gx)::BIGINT AS key_sum FROM (SELECT *, 0 AS k FROM p) GROUP BY shape".replace("gx // 128", "floor(gx / 128::DOUBLE)").replace("gy // 128", "floor(gy / 128::DOUBLE)"),
    "mask_union": f"""WITH {_PIXELS}, t AS (SELECT shape, floor(gx / 128::DOUBLE)::BIGINT AS tx, floor(gy / 128::DOUBLE)::BIGINT AS ty, gx - 128 * floor(gx / 128::DOUBLE)::BIGINT AS col, gy - 128 * floor(gy / 128::DOUBLE)::BIGINT AS row FROM p),
        e AS (SELECT a.shape, a.tx, a.ty, a.row, a.col FROM t a JOIN (SELECT shape, tx, ty, row + dr AS row, col + dc AS col FROM t, range(-1, 2) u(dr), range(-1, 2) v(dc)) b ON a.shape = b.shape AND a.tx = b.tx AND a.ty = b.ty AND a.row = b.row AND a.col = b.col WHERE a.row BETWEEN 1 AND 126 AND a.col BETWEEN 1 AND 126 GROUP BY ALL HAVING count(*) = 9)
        SELECT "group", tx, ty, count(*) AS pixels, sum(row * 7 + col)::BIGINT AS key_sum FROM (SELECT DISTINCT shape % 5 AS "group", tx, ty, row, col FROM e) GROUP BY "group", tx, ty""",
    "grid_cells": f"""WITH s AS ({_DIAMOND}), b AS (SELECT *, cx - r AS x0, cy - r AS y0, ceil(2 * r / 24)::BIGINT AS n FROM s), b2 AS (SELECT *, unnest(range(n)) AS i FROM b), c AS (SELECT shape, cx, cy, r, x0 + i * 24 AS xa, y0 + j * 24 AS ya FROM (SELECT *, unnest(range(n)) AS j FROM b2)),
        k AS (SELECT *, unnest([xa, xa + 24, cx, cx - r, cx + r, cx - (r - abs(ya - cy)), cx + (r - abs(ya - cy)), cx - (r - abs(ya + 24 - cy)), cx + (r - abs(ya + 24 - cy))]) AS x FROM c), u AS (SELECT DISTINCT * FROM k WHERE x >= xa AND x <= xa + 24),
        v AS (SELECT shape, xa, ya, x, greatest(0, least(ya + 24, cy + (r - abs(x - cx))) - greatest(ya, cy - (r - abs(x - cx)))) AS h FROM u), w AS (SELECT shape, xa, ya, (x - lag(x) OVER q) * (h + lag(h) OVER q) / 2 AS a FROM v WINDOW q AS (PARTITION BY shape, xa, ya ORDER BY x)),
        z AS (SELECT shape, sum(a) AS area FROM w GROUP BY shape, xa, ya HAVING sum(a) >= 0.12 * 576) SELECT shape, count(*) AS n, round(sum(area), 3) AS area FROM z GROUP BY shape""",
    "camera_tile": with_tables(f"WITH {_VIEWS} SELECT pixel, CASE WHEN count(*) >= 2 THEN count(*) ELSE 0 END AS overlap, round(CASE WHEN count(*) >= 2 THEN min(gsd) END, 7) AS gsd FROM views GROUP BY pixel", "poses", "cells"),
    "camera_hits": with_tables(f"WITH {_VIEWS}, u AS (SELECT DISTINCT region, pose FROM views) SELECT region, count(*) AS poses, sum(pose * (pose % 1009 + 1))::BIGINT AS mark FROM u GROUP BY region", "poses", "cells"),
    "tile_candidates": with_tables(
        """WITH s AS (SELECT (event_id * 13 % 500)::DOUBLE AS x, event_id / 4::DOUBLE AS y, event_id % 7 * 3::DOUBLE AS reach FROM poses WHERE event_id % 3 = 0), t AS (SELECT cell, col * 25::DOUBLE AS x0, row * 25::DOUBLE AS y0 FROM cells),
        n AS (SELECT cell, count(*) AS n FROM t JOIN s ON pow(greatest(x0 - x, x - x0 - 25, 0), 2) + pow(greatest(y0 - y, y - y0 - 25, 0), 2) <= reach * reach GROUP BY cell) SELECT t.cell, coalesce(n, (SELECT count(*) FROM s)) AS poses, n IS NULL AS "all" FROM t LEFT JOIN n USING (cell)""",
        "poses", "cells",
    ),
    "overlay_blend": with_tables("SELECT row, col, round(CASE WHEN cell % 2 = 0 AND cell % 5 <> 0 AND cell % 7 <> 0 AND cell % 11 > 0 THEN z - 250 ELSE z END, 3) AS z FROM cells", "cells"),
    "overlay_coded": with_tables(
        "WITH e AS (SELECT row, col, cell, greatest(0, least(16777215, round_even((z + 10000 - CASE WHEN cell % 3 = 0 THEN 700 ELSE 0 END) * 10, 0)))::BIGINT AS v FROM cells) SELECT row, col, (v >> 16)::INTEGER AS r, ((v >> 8) & 255)::INTEGER AS g, (v & 255)::INTEGER AS b, CASE WHEN cell % 3 = 0 THEN 255 ELSE cell % 256 END::INTEGER AS a FROM e", "cells"
    ),
    "heat_images": with_tables(
        f"""WITH v AS (SELECT cell, cell % 9 AS o, z / 30000 AS g, cell % 130 - 10::DOUBLE AS d FROM cells) SELECT cell, CASE WHEN o = 0 THEN 0 ELSE {_ramp("least(1::DOUBLE, o / 6::DOUBLE)")} END AS overlap_rgba, CASE WHEN cell % 4 = 0 THEN 0 ELSE {_ramp("greatest(0::DOUBLE, least(1::DOUBLE, (g - 0.01::DOUBLE) / (0.06::DOUBLE - 0.01::DOUBLE)))")} END AS resolution_rgba,
        CASE WHEN d <= 0 THEN 0 ELSE {_ramp("1 - greatest(0::DOUBLE, least(1::DOUBLE, (d - 10) / 90))")} END AS density_rgba FROM v""",
        "cells",
    ),
    "geoid_heights": with_tables(
        """WITH g AS (SELECT r.range AS r, c.range AS c, (r.range * 7 + c.range % 24 * 5) % 100 - 50::DOUBLE AS u FROM range(13) r, range(25) c), p AS (SELECT event_id, alt, (event_id % 3600 / 10::DOUBLE) / 15 AS gc, (90 - (user_id % 1700 / 10::DOUBLE - 85)) / 15 AS gr FROM poses), q AS (SELECT *, floor(gc)::BIGINT AS c0, floor(gr)::BIGINT AS r0 FROM p)
        SELECT event_id, round(alt + (a.u + (b.u - a.u) * (gc - c0)) * (1 - (gr - r0)) + (d.u + (e.u - d.u) * (gc - c0)) * (gr - r0), 4) AS z FROM q JOIN g a ON a.r = r0 AND a.c = c0 JOIN g b ON b.r = r0 AND b.c = c0 + 1 JOIN g d ON d.r = r0 + 1 AND d.c = c0 JOIN g e ON e.r = r0 + 1 AND e.c = c0 + 1""",
        "poses",
    ),
}

ORACLE["tile_set"] = f"SELECT DISTINCT tx, ty FROM ({ORACLE['tile_cover']})"
