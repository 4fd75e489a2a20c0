"""Queries of scalar operators over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angles, geo, sensors, terrain
from ..sources.bindings import areas, cells, poses, table, with_tables


def r6(**columns) -> list:
    """Columns rounded to six places, so that engines that add in another order agree."""
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def mercator_xy(spark: SparkSession, sf: str) -> DataFrame:
    p = poses(spark, sf)
    x, y = geo.mercator_x(F.col("lng")), geo.mercator_y(F.col("lat"))
    lng, lat = geo.inverse_mercator(x, y)
    return p.select("event_id", *r6(x=x, y=y, lng_back=lng, lat_back=lat))


def tile_keys(spark: SparkSession, sf: str) -> DataFrame:
    tx, ty = geo.tile_of(F.col("lng"), F.col("lat"), 14)
    p = poses(spark, sf).withColumns({"tx": tx, "ty": ty})
    b = geo.tile_bounds(14, F.col("tx"), F.col("ty"))
    nx, ny = geo.tile_normal(14, F.col("tx") - 9000, F.col("ty") + 12000)
    pixel = geo.WORLD / (1 << 14) / 512
    col, row = geo.world_to_pixel(geo.mercator_x(F.col("lng")), geo.mercator_y(F.col("lat")), b[0], b[3], pixel)
    bx, by = geo.pixel_to_world(F.floor(col), F.floor(row), b[0], b[3], pixel)
    top_left = F.get(geo.tile_corners(14, F.col("tx"), F.col("ty")), F.lit(0))
    return p.select("event_id", geo.tile_key(14, F.col("tx"), F.col("ty")).alias("key"), nx.alias("wrapped_x"), ny.alias("held_y"), F.round(col, 3).alias("pixel_col"), F.round(row, 3).alias("pixel_row"),
                    *r6(min_x=b[0], min_y=b[1], max_x=b[2], max_y=b[3], centre_x=bx, centre_y=by, corner_lng=top_left["lng"], corner_lat=top_left["lat"]))


def local_frames(spark: SparkSession, sf: str) -> DataFrame:
    e, n = geo.local_xy(F.col("lng"), F.col("lat"), 8.55, 47.304)
    along, cross = geo.sweep_frame(e, n, F.lit(37.5))
    to_lng, to_lat = geo.destination(F.col("lng"), F.col("lat"), F.col("alt"), 250.0)
    back = geo.initial_bearing(F.col("lng"), F.col("lat"), F.lit(8.55), F.lit(47.304))
    far = geo.haversine(F.col("lng"), F.col("lat"), F.lit(8.55), F.lit(47.304))
    return poses(spark, sf).select("event_id", *r6(east=e, north=n, along=along, cross=cross, to_lng=to_lng, to_lat=to_lat, bearing=back, metres=far))


def bearings(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("z") * 3 - 4000, F.col("z") * 11
    turned = angles.from_convention(F.col("bearing"), F.when(F.col("cell") % 2 == 0, "eastCW").otherwise("northCW"))
    return cells(spark, sf).select("cell", *r6(axis=angles.axial(a), axial=angles.axial_delta(a, b), circular=angles.circular_delta(a, b), turned=turned, held=angles.clamp(F.col("z"), 950, 1050)))


def camera_spacing(spark: SparkSession, sf: str) -> DataFrame:
    """Every camera of the registry at every altitude."""
    flights = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("flight"), (60.0 + F.col("s_suppkey") % 90).alias("h"), (F.col("s_suppkey") % 3).alias("turned"))
    both = flights.crossJoin(F.broadcast(sensors.cameras(spark)))
    yes, no = F.lit(True), F.lit(False)
    return both.select(
        "flight", F.col("key").alias("camera"),
        *r6(gsd=sensors.gsd(F.col("h")), side=sensors.line_spacing(F.col("h"), 70, no), side_turned=sensors.line_spacing(F.col("h"), 70, yes), forward=sensors.forward_spacing(F.col("h"), 75, no), forward_turned=sensors.forward_spacing(F.col("h"), 75, yes),
            spacing=sensors.spacing_for(F.lit("camera"), F.col("h"), 70, F.col("turned") * 45.0)),
        *r6(radius=sensors.turn_model(F.col("key"))["radius"], rate=sensors.turn_model(F.col("key"))["rate"], speed=sensors.cruise_speed(F.lit("camera"), F.lit(None).cast("double"))),
    )


def lidar_density(spark: SparkSession, sf: str) -> DataFrame:
    flights = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("flight"), (40.0 + F.col("s_suppkey") % 90).alias("h"), (F.col("s_suppkey") % 17).cast("double").alias("speed"), F.element_at(F.array(*map(F.lit, ("single", "dual", "triple"))), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("mode"),
        F.when(F.col("s_suppkey") % 5 == 0, F.col("s_suppkey") * 1.0).alias("explicit"),
    )
    h, mode = F.col("h"), F.col("mode")
    return flights.select(
        "flight", sensors.effective_rate(mode).alias("rate"), sensors.azimuth_samples(90.0, sensors.swath_width(h), 4.0).alias("beams"),
        *r6(swath=sensors.swath_width(h), spacing=sensors.lidar_line_spacing(h, 30), one_pass=sensors.single_pass_density(mode, h, F.col("speed")), delivered=sensors.deliverable_density(mode, h, 30, F.col("speed")),
            target=sensors.target_density(F.col("explicit"), mode, h, 30, F.col("speed")), flown=sensors.cruise_speed(F.lit("lidar"), F.nullif(F.col("speed"), F.lit(0.0)))),
    )


def rotations(spark: SparkSession, sf: str) -> DataFrame:
    """Rotation matrices of poses, and where a ground point falls in each image."""
    p = poses(spark, sf).select("event_id", F.col("event_id") % 40 - 20.0, F.col("user_id") % 30 - 15.0, (F.col("event_id") % 360).cast("double"), "alt").toDF("event_id", "o", "p", "k", "alt")
    r = sensors.rotation(F.col("o"), F.col("p"), F.col("k"))
    zero = F.lit(0.0)
    u, v, seen = sensors.ray_pixel((F.lit(3.0), F.lit(5.0), zero), (zero, zero, F.col("alt")), r, F.lit(0.035), F.lit(4.88e-6), F.lit(4.88e-6), F.lit(7952), F.lit(5304))
    beam = sensors.beam_direction((zero, F.lit(1.0), zero), (F.lit(1.0), zero, zero), F.col("o"), F.col("p"), 1.0, 2.0, 3.0)
    beam = [F.get(beam, F.lit(i)) for i in range(3)]
    return p.select("event_id", seen.alias("seen"), F.round(F.when(seen, u), 3).alias("u"), F.round(F.when(seen, v), 3).alias("v"), *r6(**r), *r6(beam_x=beam[0], beam_y=beam[1], beam_z=beam[2]))


def terrain_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Elevations as coded colours and back, and display colours."""
    z = F.col("z") * 3.7 - 2500
    red, green, blue = terrain.encode(z)
    ramp = terrain.heat_colour((F.col("z") - 900) / 1300)
    c = cells(spark, sf).select("cell", F.round(z, 4).alias("z"), red.alias("red"), green.alias("green"), blue.alias("blue"), ramp.alias("ramp"))
    back = terrain.decode(F.col("red"), F.col("green"), F.col("blue"))
    return c.select("cell", "z", "red", "green", "blue", F.round(back, 1).alias("back"), *[F.col(f"ramp.{k}").alias(f"ramp_{k}") for k in ("r", "g", "b")])


def grid_choices(spark: SparkSession, sf: str) -> DataFrame:
    a = areas(spark, sf)
    lo = [F.col("lng") - F.col("half"), F.col("lat") - F.col("half")]
    hi = [F.col("lng") + F.col("half"), F.col("lat") + F.col("half")]
    x0, y0, x1, y1 = geo.mercator_x(lo[0]), geo.mercator_y(lo[1]), geo.mercator_x(hi[0]), geo.mercator_y(hi[1])
    size = (x1 - x0) * (y1 - y0)
    first_x, last_x, first_y, last_y = geo.tile_range(15, x0, y0, x1, y1)
    meets = geo.boxes_meet((lo[0], lo[1], hi[0], hi[1]), (F.lit(8.51), F.lit(47.2995), F.lit(8.52), F.lit(47.301)))
    along, across = geo.extents(F.transform("ring", lambda p: F.struct((p["x"] * 1e5).alias("x"), (p["y"] * 1e5).alias("y"))), 30.0)
    return a.select("area_id", first_x.alias("x_from"), last_x.alias("x_to"), first_y.alias("y_from"), last_y.alias("y_to"), meets.alias("meets"), geo.zoom_for_step(geo.grid_step(size)).alias("zoom"),
                    *r6(step=geo.grid_step(size), area=geo.ring_area(F.col("ring")) * 1e6, perimeter=geo.ring_perimeter(F.col("ring")) * 1e3, compact=geo.compactness(F.col("ring")), along=along, across=across))


QUERIES = {f.__name__: f for f in (mercator_xy, tile_keys, local_frames, bearings, camera_spacing, lidar_density, rotations, terrain_codes, grid_choices)}

_X, _Y = "radians(lng) * 6378137", "6378137 * ln(tan(pi() / 4 + radians(greatest(-85.05112878, least(85.05112878, lat))) / 2))"
_W = "(2 * pi() * 6378137)"
_CAMERAS = ", ".join(f"('{k}', {f!r}::DOUBLE, {sx!r}::DOUBLE, {sy!r}::DOUBLE, {w}, {h})" for k, f, sx, sy, w, h, _ in sensors.CAMERAS)


def _turn(v: str, axis: str, angle: str) -> str:
    """Rodrigues' formula on three-element lists."""
    dot = f"list_dot_product({v}, {axis})"
    cross = f"[{axis}[2]*{v}[3] - {axis}[3]*{v}[2], {axis}[3]*{v}[1] - {axis}[1]*{v}[3], {axis}[1]*{v}[2] - {axis}[2]*{v}[1]]"
    return "[" + ", ".join(f"{v}[{i}]*cos(radians({angle})) + {cross}[{i}]*sin(radians({angle})) + {axis}[{i}]*{dot}*(1 - cos(radians({angle})))" for i in (1, 2, 3)) + "]"


ORACLE = {
    "mercator_xy": with_tables(f"SELECT event_id, round({_X}, 6) AS x, round({_Y}, 6) AS y, round(degrees(({_X}) / 6378137), 6) AS lng_back, round(degrees(2 * atan(exp(({_Y}) / 6378137)) - pi() / 2), 6) AS lat_back FROM poses", "poses"),
    "tile_keys": with_tables(
        f"""WITH t AS (SELECT *, floor((lng + 180) / 360 * 16384)::BIGINT AS tx, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384)::BIGINT AS ty, {_X} AS mx, {_Y} AS my, {_W} / 16384 AS side FROM poses),
        b AS (SELECT *, tx * side - {_W} / 2 AS min_x, {_W} / 2 - (ty + 1) * side AS min_y, (tx + 1) * side - {_W} / 2 AS max_x, {_W} / 2 - ty * side AS max_y FROM t),
        c AS (SELECT *, (mx - min_x) / (side / 512) - 0.5 AS pc, (max_y - my) / (side / 512) - 0.5 AS pr FROM b)
        SELECT event_id, '14/' || tx || '/' || ty AS key, ((tx - 9000) % 16384 + 16384) % 16384 AS wrapped_x, greatest(0, least(16383, ty + 12000)) AS held_y, round(pc, 3) AS pixel_col, round(pr, 3) AS pixel_row,
        round(min_x, 6) AS min_x, round(min_y, 6) AS min_y, round(max_x, 6) AS max_x, round(max_y, 6) AS max_y, round(min_x + (floor(pc) + 0.5) * side / 512, 6) AS centre_x, round(max_y - (floor(pr) + 0.5) * side / 512, 6) AS centre_y,
        round(degrees(min_x / 6378137), 6) AS corner_lng, round(degrees(2 * atan(exp(max_y / 6378137)) - pi() / 2), 6) AS corner_lat FROM c""",
        "poses",
    ),
    "local_frames": with_tables(
        """WITH f AS (SELECT *, radians(lng - 8.55::DOUBLE) * cos(radians(47.304::DOUBLE)) * 6378137 AS e, radians(lat - 47.304::DOUBLE) * 6378137 AS n, 250 / 6371000::DOUBLE AS d, radians(alt) AS b, radians(lat) AS phi FROM poses),
        g AS (SELECT *, asin(sin(phi) * cos(d) + cos(phi) * sin(d) * cos(b)) AS phi2, pow(sin(radians(47.304::DOUBLE - lat) / 2), 2) + cos(phi) * cos(radians(47.304::DOUBLE)) * pow(sin(radians(8.55::DOUBLE - lng) / 2), 2) AS h,
              degrees(atan2(sin(radians(8.55::DOUBLE - lng)) * cos(radians(47.304::DOUBLE)), cos(phi) * sin(radians(47.304::DOUBLE)) - sin(phi) * cos(radians(47.304::DOUBLE)) * cos(radians(8.55::DOUBLE - lng)))) AS t FROM f)
        SELECT event_id, round(e, 6) AS east, round(n, 6) AS north, round(e * sin(radians(37.5)) + n * cos(radians(37.5)), 6) AS along, round(e * cos(radians(37.5)) - n * sin(radians(37.5)), 6) AS cross,
        round(lng + degrees(atan2(sin(b) * sin(d) * cos(phi), cos(d) - sin(phi) * sin(phi2))), 6) AS to_lng, round(degrees(phi2), 6) AS to_lat,
        round(CASE WHEN lng = 8.55 AND lat = 47.304 THEN 0 WHEN t < 0 THEN t + 360 ELSE t END, 6) AS bearing, round(2 * 6371000::DOUBLE * asin(sqrt(h)), 6) AS metres FROM g""",
        "poses",
    ),
    "bearings": with_tables(
        """WITH a AS (SELECT *, z * 3 - 4000 AS a, z * 11 AS b FROM cells), m AS (SELECT *, fmod(a, 180) AS a1, fmod(b, 180) AS b1, fmod(a, 360) AS a2, fmod(b, 360) AS b2 FROM a)
        SELECT cell, round(a1, 6) AS axis, round(least(abs(a1 - b1), 180 - abs(a1 - b1)), 6) AS axial, round(least(abs(a2 - b2), 360 - abs(a2 - b2)), 6) AS circular,
        round(CASE WHEN cell % 2 = 0 THEN fmod(90 - bearing, 360) ELSE bearing END, 6) AS turned, round(greatest(950, least(1050, z)), 6) AS held FROM m""",
        "cells",
    ),
    "camera_spacing": f"""WITH c(camera, f, sx, sy, w, h_px) AS (VALUES {_CAMERAS}), fl AS (SELECT s_suppkey AS flight, 60::DOUBLE + s_suppkey % 90 AS h, s_suppkey % 3 = 2 AS swap FROM supplier)
        SELECT flight, camera, round(greatest(sx, sy) * h / f, 6) AS gsd, round(w * sx * h / f * (1 - 0.7::DOUBLE), 6) AS side, round(h_px * sy * h / f * (1 - 0.7::DOUBLE), 6) AS side_turned, round(h_px * sy * h / f * 0.25, 6) AS forward, round(w * sx * h / f * 0.25, 6) AS forward_turned,
        round(greatest(1, CASE WHEN swap THEN h_px * sy ELSE w * sx END * h / f * (1 - 0.7::DOUBLE)), 6) AS spacing,
        CASE WHEN camera = 'SONY_RX1R2' THEN 35::DOUBLE ELSE 40 END AS radius, CASE WHEN camera = 'SONY_RX1R2' THEN 0.2::DOUBLE ELSE 0.3 END AS rate, 12::DOUBLE AS speed FROM fl, c""",
    "lidar_density": """WITH f AS (SELECT s_suppkey AS flight, 40::DOUBLE + s_suppkey % 90 AS h, (s_suppkey % 17)::DOUBLE AS v, (s_suppkey % 3 + 1) * 160000 AS rate, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey::DOUBLE END AS explicit FROM supplier),
        g AS (SELECT *, 2 * h * tan(pi() / 4) AS w, CASE WHEN v > 0 THEN rate / (v * 2 * h * tan(pi() / 4)) ELSE 0 END AS one, greatest(15, least(25, greatest(7, floor(2 * h * tan(pi() / 4) / 8 + 0.5))))::INTEGER AS n FROM f)
        SELECT flight, rate::BIGINT AS rate, (CASE WHEN n % 2 = 0 THEN n + 1 ELSE n END)::INTEGER AS beams, round(w, 6) AS swath, round(w * 0.7::DOUBLE, 6) AS spacing, round(one, 6) AS one_pass, round(one / 0.7::DOUBLE, 6) AS delivered, round(CASE WHEN explicit > 0 THEN explicit ELSE one / 0.7::DOUBLE END, 6) AS target,
        round(CASE WHEN v = 0 THEN 16 ELSE v END, 6) AS flown FROM g""",
    "rotations": with_tables(
        f"""WITH p AS (SELECT event_id, alt, event_id % 40 - 20::DOUBLE AS od, user_id % 30 - 15::DOUBLE AS pd, radians(event_id % 40 - 20) AS o, radians(user_id % 30 - 15) AS p, radians(event_id % 360) AS k FROM poses),
        r AS (SELECT *, cos(k)*cos(p) AS r11, cos(k)*sin(p)*sin(o) - sin(k)*cos(o) AS r12, cos(k)*sin(p)*cos(o) + sin(k)*sin(o) AS r13, sin(k)*cos(p) AS r21, sin(k)*sin(p)*sin(o) + cos(k)*cos(o) AS r22, sin(k)*sin(p)*cos(o) - cos(k)*sin(o) AS r23, -sin(p) AS r31, cos(p)*sin(o) AS r32, cos(p)*cos(o) AS r33 FROM p),
        q AS (SELECT *, r11*3 + r21*5 - r31*alt AS x, r12*3 + r22*5 - r32*alt AS y, r13*3 + r23*5 - r33*alt AS z FROM r),
        s AS (SELECT *, 3976 + 0.035 * (x / -z) / 4.88e-6 AS u, 2652 + 0.035 * (y / -z) / 4.88e-6 AS v FROM q),
        b0 AS (SELECT *, z < -1e-9 AND u >= 0 AND u < 7952 AND v >= 0 AND v < 5304 AS seen, [0.0::DOUBLE, 0, -1] AS dn, [0.0::DOUBLE, 1, 0] AS al, [1.0::DOUBLE, 0, 0] AS ac FROM s),
        b1 AS (SELECT *, {_turn("dn", "al", "od")} AS v1 FROM b0), b2 AS (SELECT *, {_turn("v1", "ac", "pd")} AS v2 FROM b1), b3 AS (SELECT *, {_turn("v2", "dn", "1")} AS v3 FROM b2), b4 AS (SELECT *, {_turn("v3", "ac", "2")} AS v4 FROM b3), b5 AS (SELECT *, {_turn("v4", "al", "3")} AS v5 FROM b4)
        SELECT event_id, seen, round(CASE WHEN seen THEN u END, 3) AS u, round(CASE WHEN seen THEN v END, 3) AS v, {", ".join(f"round(r{i}{j}, 6) AS r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))}, round(v5[1], 6) AS beam_x, round(v5[2], 6) AS beam_y, round(v5[3], 6) AS beam_z FROM b5""",
        "poses",
    ),
    "terrain_codes": with_tables(
        """WITH e AS (SELECT cell, z, round_even((z * 3.7::DOUBLE - 2500 + 10000) * 10, 0)::BIGINT AS v, greatest(0, least(1, (z - 900) / 1300)) AS t FROM cells)
        SELECT cell, round(z * 3.7::DOUBLE - 2500, 4) AS z, (v >> 16)::INTEGER AS red, ((v >> 8) & 255)::INTEGER AS green, (v & 255)::INTEGER AS blue, round(-10000 + v * 0.1::DOUBLE, 1) AS back,
        (CASE WHEN t < 0.5 THEN 0 WHEN t < 0.75 THEN floor(255 * (t - 0.5) / 0.25 + 0.5) ELSE 255 END)::INTEGER AS ramp_r, (CASE WHEN t < 0.25 THEN floor(255 * t / 0.25 + 0.5) WHEN t < 0.75 THEN 255 ELSE floor(255 * (1 - (t - 0.75) / 0.25) + 0.5) END)::INTEGER AS ramp_g,
        (CASE WHEN t < 0.25 THEN 255 WHEN t < 0.5 THEN floor(255 * (1 - (t - 0.25) / 0.25) + 0.5) ELSE 0 END)::INTEGER AS ramp_b FROM e""",
        "cells",
    ),
    "grid_choices": with_tables(
        f"""WITH b AS (SELECT *, {_X.replace("lng", "(lng - half)")} AS x0, {_X.replace("lng", "(lng + half)")} AS x1, {_Y.replace("lat", "lat - half")} AS y0, {_Y.replace("lat", "lat + half")} AS y1, {_W} / 32768 AS side FROM areas),
        s AS (SELECT *, greatest(24, least(120, sqrt(greatest(1, (x1 - x0) * (y1 - y0))) / 28)) AS step FROM b)
        SELECT area_id, floor((x0 + {_W} / 2) / side)::BIGINT AS x_from, floor((x1 + {_W} / 2) / side)::BIGINT AS x_to, floor(({_W} / 2 - y1) / side)::BIGINT AS y_from, floor(({_W} / 2 - y0) / side)::BIGINT AS y_to,
        lng - half < 8.52::DOUBLE AND lng + half > 8.51::DOUBLE AND lat - half < 47.301::DOUBLE AND lat + half > 47.2995::DOUBLE AS meets, CASE WHEN step <= 24 THEN 15 WHEN step <= 40 THEN 14 WHEN step <= 65 THEN 13 ELSE 12 END AS zoom,
        round(step, 6) AS step, round(4 * half * half * 1e6, 6) AS area, round(8 * half * 1e3, 6) AS perimeter, round(16 / (4 * pi()), 6) AS compact,
        round(greatest(1, 2 * half * 1e5 * (sin(radians(30)) + cos(radians(30)))), 6) AS along, round(greatest(1, 2 * half * 1e5 * (sin(radians(30)) + cos(radians(30)))), 6) AS across FROM s""",
        "areas",
    ),
}
