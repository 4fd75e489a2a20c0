"""Cameras and lidars: footprints, spacing, density, speeds and turns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .angles import clamp, num

#: Focal length and pixel sides in metres, width and height in pixels, and names in files.
CAMERAS = [
    ("SONY_RX1R2", 0.035, 4.88e-6, 4.88e-6, 7952, 5304, ["RX1RII 42MP", "RX1RII", "RX1R2", "SONY_RX1R2"]),
    ("SONY_RX1R3", 0.035, 35.7e-3 / 9504, 23.8e-3 / 6336, 9504, 6336, ["SURVEY61", "SURVEY61 v5", "SUR61", "RX1R3_v5", "RX1R3", "SONY_RX1R3"]),
    ("SONY_A6100_20MM", 0.020, 23.5e-3 / 6000, 15.6e-3 / 4000, 6000, 4000, ["SURVEY24", "A6100_v5", "SURVEY24 v5", "SUR24", "SONY_A6100_20MM"]),
    ("DJI_ZENMUSE_P1_24MM", 5626.690009970837 * 4.27246e-6, 4.27246e-6, 4.27246e-6, 8192, 5460, ["DJI Zenmuse P1 24mm", "Zenmuse P1 24mm", "P1 24mm", "ZENMUSE_P1_24MM"]),
    ("ILX_LR1_INSPECT_85MM", 0.085, 35.7e-3 / 9504, 23.8e-3 / 6336, 9504, 6336, ["INSPECT", "ILX-LR1 85mm", "ILX_LR1_INSPECT_85MM", "MAPSTARHighRes", "MAPSTARHighRes_v4", "MAPSTARHighRes_v5"]),
    ("MAP61_17MM", 0.017, 35.7e-3 / 9504, 23.8e-3 / 6336, 9504, 6336, ["MAP61", "MAP61 17mm", "MAP61_17MM", "MAPSTAROblique", "MAPSTAROblique_v4", "MAPSTAROblique_v5"]),
    ("RGB61_24MM", 0.024, 36.0e-3 / 9504, 24.0e-3 / 6336, 9504, 6336, ["RGB61", "RGB61 24mm", "RGB61_24MM", "RGB61_v4", "RGB61_v5"]),
]
#: Fixed values of the lidar: points a second of a full turn by return mode, mapping field of view, speed, range.
NATIVE_RATES = {"single": 640_000, "dual": 1_280_000, "triple": 1_920_000}
LIDAR_FOV, LIDAR_SPEED, LIDAR_RANGE, CAMERA_SPEED = 90.0, 16.0, 200.0, 12.0
#: Channel angles: from 19.5 degrees down in steps of 1.3.
CHANNELS = [round(19.5 - 1.3 * i, 1) for i in range(32)]


def cameras(spark: SparkSession) -> DataFrame:
    """The registry, in its order: seven rows, so any join with it is a broadcast of a known size."""
    rows = [(i, *c) for i, c in enumerate(CAMERAS)]
    return spark.createDataFrame(rows, "seq int, key string, f_m double, sx_m double, sy_m double, w_px int, h_px int, names array<string>")


def gsd(altitude: Column) -> Column:
    """Ground metres a pixel, by the larger side, of a camera whose columns f_m, sx_m, ... are in the row."""
    return F.greatest("sx_m", "sy_m") * altitude / F.col("f_m")


def _footprint(altitude: Column, overlap: Column | float, pixels: Column, side: Column) -> Column:
    return pixels * (side * altitude / F.col("f_m")) * (1 - num(overlap) / 100)


def line_spacing(altitude: Column, side_overlap: Column | float, rotated: Column) -> Column:
    """Metres between lines of a camera whose columns f_m, sx_m, ... are in the row."""
    return F.when(rotated, _footprint(altitude, side_overlap, F.col("h_px"), F.col("sy_m"))).otherwise(_footprint(altitude, side_overlap, F.col("w_px"), F.col("sx_m")))


def forward_spacing(altitude: Column, front_overlap: Column | float, rotated: Column) -> Column:
    return F.when(rotated, _footprint(altitude, front_overlap, F.col("w_px"), F.col("sx_m"))).otherwise(_footprint(altitude, front_overlap, F.col("h_px"), F.col("sy_m")))


def swath_width(altitude: Column, fov: Column | float = LIDAR_FOV) -> Column:
    return 2 * altitude * F.tan(F.radians(num(fov)) / 2)


def lidar_line_spacing(altitude: Column, side_overlap: Column | float, fov: Column | float = LIDAR_FOV) -> Column:
    return swath_width(altitude, fov) * (1 - num(side_overlap) / 100)


def spacing_for(payload: Column, altitude: Column, side_overlap: Column | float, yaw_offset: Column | float = 0.0, fov: Column | float = LIDAR_FOV) -> Column:
    """Metres between lines for either payload, 1 at least; a camera turned by 90 degrees swaps its sides."""
    rotated = F.rint(F.pmod(num(yaw_offset), F.lit(180.0))) == 90
    return F.greatest(F.lit(1.0), F.when(payload == "lidar", lidar_line_spacing(altitude, side_overlap, fov)).otherwise(line_spacing(altitude, side_overlap, rotated)))


def effective_rate(mode: Column, fov: Column | float = LIDAR_FOV) -> Column:
    """Points a second within the mapping field of view, halves rounded up."""
    native = F.when(mode == "dual", NATIVE_RATES["dual"]).when(mode == "triple", NATIVE_RATES["triple"]).otherwise(NATIVE_RATES["single"])
    return F.floor(native * num(fov) / 360 + 0.5)


def single_pass_density(mode: Column, altitude: Column, speed: Column | float = LIDAR_SPEED, fov: Column | float = LIDAR_FOV) -> Column:
    """Points a square metre of one pass; 0 without width or speed. The rate is that of the sensor's own field of view."""
    width = swath_width(altitude, fov)
    return F.when((width > 0) & (num(speed) > 0), effective_rate(mode) / (num(speed) * width)).otherwise(0.0)


def deliverable_density(mode: Column, altitude: Column, side_overlap: Column | float, speed: Column | float = LIDAR_SPEED, fov: Column | float = LIDAR_FOV) -> Column:
    left = 1 - num(side_overlap) / 100
    return F.when(left > 0, single_pass_density(mode, altitude, speed, fov) / F.when(left > 0, left)).otherwise(0.0)


def target_density(explicit: Column, mode: Column, altitude: Column, side_overlap: Column | float, speed: Column | float = LIDAR_SPEED) -> Column:
    """The asked-for density where it is positive, else what the plan delivers."""
    return F.when(explicit > 0, explicit).otherwise(deliverable_density(mode, altitude, side_overlap, speed))


def turn_model(keys: Column) -> Column:
    """struct<radius, rate> by what the sensor's keys contain."""
    key = F.lower(F.coalesce(keys, F.lit("")))
    has = lambda *words: F.greatest(*[key.contains(w) for w in words], F.lit(False))
    newer = has("v5", "survey61", "survey24", "a6100", "rx1r3", "zenmuse", "p1", "lidar") | ~has("v4", "rx1r2")
    return F.struct(F.when(newer, 40.0).otherwise(35.0).alias("radius"), F.when(newer, 0.3).otherwise(0.2).alias("rate"))


def cruise_speed(payload: Column, speed: Column) -> Column:
    return F.coalesce(speed, F.when(payload == "lidar", LIDAR_SPEED).otherwise(CAMERA_SPEED))


def azimuth_samples(fov: Column | float, swath: Column, pixel: Column | float) -> Column:
    """How many beams cross the field of view: one per two pixels of the swath or six degrees, 7 to 25, made odd."""
    by_width = F.floor(swath / F.greatest(F.lit(1.0), 2 * num(pixel)) + 0.5)
    wanted = clamp(F.greatest(by_width, F.floor(num(fov) / 6 + 0.5)).cast("double"), 7, 25).cast("int")
    return wanted + F.when(wanted % 2 == 0, 1).otherwise(0)


def turn_radius(spacing: Column, default: Column | float, distance: float = 80.0, side_offset: float = 70.0) -> Column:
    """The radius of turns between lines: half the turn's length, or less where lines are close; never under the default."""
    held = (F.greatest(num(side_offset) - spacing, F.lit(0.0)) / 2 + spacing) / 2
    return F.greatest(F.least(held, F.lit(distance / 2)), num(default))


def rotation(omega: Column, phi: Column, kappa: Column) -> dict[str, Column]:
    """The nine entries of Rz(kappa) Ry(phi) Rx(omega), by row and column."""
    o, p, k = F.radians(omega), F.radians(phi), F.radians(kappa)
    so, co, sp, cp, sk, ck = F.sin(o), F.cos(o), F.sin(p), F.cos(p), F.sin(k), F.cos(k)
    return {
        "r11": ck * cp, "r12": ck * sp * so - sk * co, "r13": ck * sp * co + sk * so,
        "r21": sk * cp, "r22": sk * sp * so + ck * co, "r23": sk * sp * co - ck * so,
        "r31": -sp, "r32": cp * so, "r33": cp * co,
    }


Vector = tuple[Column, Column, Column]


def rotate_around(v: Column, axis: Vector, angle: Column | float) -> Column:
    """Rodrigues' rotation of v, an array of three, about a unit axis; angles under 1e-9 degrees leave it."""
    t = F.radians(num(angle))
    c, s = F.cos(t), F.sin(t)

    def turn(v: Column) -> Column:
        x, y, z = (F.get(v, F.lit(i)) for i in range(3))
        dot = x * axis[0] + y * axis[1] + z * axis[2]
        cross = (axis[1] * z - axis[2] * y, axis[2] * x - axis[0] * z, axis[0] * y - axis[1] * x)
        turned = F.array(*[p * c + q * s + a * dot * (1 - c) for p, q, a in zip((x, y, z), cross, axis, strict=True)])
        return F.when(F.abs(num(angle)) < 1e-9, v).otherwise(turned)

    # Bound by a one-element array, so that a chain of turns names each result once.
    return F.get(F.transform(F.array(v), turn), F.lit(0))


def beam_direction(along: Vector, across: Vector, azimuth: Column, channel: Column, yaw: float = 0.0, pitch: float = 0.0, roll: float = 0.0) -> Column:
    """Array of three: straight down, turned by the azimuth about the flight axis, by the channel about the cross axis, then by the boresight angles."""
    down = (F.lit(0.0), F.lit(0.0), F.lit(-1.0))
    v = F.array(*down)
    for axis, angle in ((along, azimuth), (across, channel), (down, yaw), (across, pitch), (along, roll)):
        v = rotate_around(v, axis, angle)
    return v


def ray_pixel(point: Vector, sensor: Vector, r: dict[str, Column], f: Column, sx: Column, sy: Column, w: Column, h: Column) -> tuple[Column, Column, Column]:
    """(u, v, visible): the pixel under a world point, and whether it is before the camera and within the image."""
    d = [point[i] - sensor[i] for i in range(3)]
    x, y, z = (r[f"r1{i}"] * d[0] + r[f"r2{i}"] * d[1] + r[f"r3{i}"] * d[2] for i in (1, 2, 3))
    before = z < -1e-9
    u = w / 2 + f * (x / F.when(before, -z)) / sx
    v = h / 2 + f * (y / F.when(before, -z)) / sy
    return u, v, F.coalesce(before & (u >= 0) & (u < w) & (v >= 0) & (v < h), F.lit(False))
