"""Coordinates, tiles and local frames, as Column expressions. Positions are lng, lat in degrees or x, y in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import num

#: The sphere of the map projection and local frames; that of great circles; the projection's last latitude.
MAP_RADIUS, EARTH_RADIUS, MAX_LAT = 6_378_137.0, 6_371_000.0, 85.05112878
WORLD = 2 * math.pi * MAP_RADIUS


def mercator_x(lng: Column) -> Column:
    return F.radians(lng) * MAP_RADIUS


def mercator_y(lat: Column) -> Column:
    held = F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat))
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(held) / 2)) * MAP_RADIUS


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MAP_RADIUS), F.degrees(2 * F.atan(F.exp(y / MAP_RADIUS)) - math.pi / 2)


def tile_of(lng: Column, lat: Column, z: int) -> tuple[Column, Column]:
    """Column and row of the slippy-map tile; latitudes aren't held within the map."""
    n, rad = float(1 << z), F.radians(lat)
    y = (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n
    return F.floor((lng + 180) / 360 * n), F.floor(y)


def tile_bounds(z: int, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """(min x, min y, max x, max y) in metres."""
    side = WORLD / (1 << z)
    return x * side - WORLD / 2, WORLD / 2 - (y + 1) * side, (x + 1) * side - WORLD / 2, WORLD / 2 - y * side


def tile_corners(z: int, x: Column, y: Column) -> Column:
    """Array of (lng, lat): top left, top right, bottom right, bottom left."""
    min_x, min_y, max_x, max_y = tile_bounds(z, x, y)
    corner = lambda a, b: F.struct(*[c.alias(n) for c, n in zip(inverse_mercator(a, b), ("lng", "lat"), strict=True)])
    return F.array(corner(min_x, max_y), corner(max_x, max_y), corner(max_x, min_y), corner(min_x, min_y))


def tile_normal(z: int, x: Column, y: Column) -> tuple[Column, Column]:
    """x wraps around the world, y stays on it."""
    n = 1 << z
    return F.pmod(x, F.lit(n)), F.greatest(F.lit(0), F.least(F.lit(n - 1), y))


def tile_key(z: int, x: Column, y: Column) -> Column:
    return F.concat_ws("/", F.lit(str(z)), x.cast("string"), y.cast("string"))


def tile_range(z: int, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> tuple[Column, Column, Column, Column]:
    """First and last column, first and last row of the tiles that bounds in metres meet; held within the map."""
    side, last = WORLD / (1 << z), (1 << z) - 1
    hold = lambda v: F.greatest(F.lit(0), F.least(F.lit(last), F.floor(v)))
    return hold((min_x + WORLD / 2) / side), hold((max_x + WORLD / 2) / side), hold((WORLD / 2 - max_y) / side), hold((WORLD / 2 - min_y) / side)


def world_to_pixel(x: Column, y: Column, min_x: Column, max_y: Column, pixel: float) -> tuple[Column, Column]:
    """Column and row as fractions; whole numbers are pixel centres."""
    return (x - min_x) / pixel - 0.5, (max_y - y) / pixel - 0.5


def pixel_to_world(col: Column, row: Column, min_x: Column, max_y: Column, pixel: float) -> tuple[Column, Column]:
    return min_x + (col + 0.5) * pixel, max_y - (row + 0.5) * pixel


def local_xy(lng: Column, lat: Column, lng0: Column | float, lat0: Column | float) -> tuple[Column, Column]:
    """East and north in metres about a reference."""
    return F.radians(lng - num(lng0)) * F.cos(F.radians(num(lat0))) * MAP_RADIUS, F.radians(lat - num(lat0)) * MAP_RADIUS


def sweep_frame(east: Column, north: Column, bearing: Column | float) -> tuple[Column, Column]:
    """(along, cross) of a point for sweeps that run along the bearing; cross grows to their right."""
    b = F.radians(num(bearing))
    return east * F.sin(b) + north * F.cos(b), east * F.cos(b) - north * F.sin(b)


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def destination(lng: Column, lat: Column, bearing: Column, metres: Column | float) -> tuple[Column, Column]:
    """The point so many metres along a great circle; longitude in [-180, 180)."""
    d, b, phi = num(metres) / EARTH_RADIUS, F.radians(bearing), F.radians(lat)
    to = F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(b))
    turn = F.atan2(F.sin(b) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * F.sin(to))
    return F.pmod(F.degrees(F.radians(lng) + turn) + 540, F.lit(360.0)) - 180, F.degrees(to)


def initial_bearing(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Clockwise from north in [0, 360); 0 between equal points."""
    d, a, b = F.radians(lng2 - lng1), F.radians(lat1), F.radians(lat2)
    turn = F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    return F.when((lng1 == lng2) & (lat1 == lat2), 0.0).otherwise(F.pmod(F.degrees(turn), F.lit(360.0)))


def grid_step(area: Column) -> Column:
    """Metres between terrain samples for an area in square metres."""
    return F.greatest(F.lit(24.0), F.least(F.lit(120.0), F.sqrt(F.greatest(area, F.lit(1.0))) / 28))


def zoom_for_step(step: Column) -> Column:
    return F.when(step <= 24, 15).when(step <= 40, 14).when(step <= 65, 13).otherwise(12)


def boxes_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether the insides of two boxes (min x, min y, max x, max y) meet; touching isn't meeting."""
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


# Rings: arrays of struct<x, y>, closed or not.


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % n).alias("b")))


def in_ring(x: Column, y: Column, ring: Column, eps: float = 0.0) -> Column:
    """Even-odd rule. eps is added to the height of every edge, for rings that may have flat ones."""

    def cross(odd: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        rise = b["y"] - a["y"] + eps
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.when(rise != 0, rise) + a["x"]
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < at), ~odd).otherwise(odd)

    return F.aggregate(_edges(ring), F.lit(False), cross)


def ring_area(ring: Column) -> Column:
    """The area without regard to orientation, measured from the first point, which keeps small rings far out exact."""
    x, y = F.get(ring, F.lit(0))["x"], F.get(ring, F.lit(0))["y"]
    term = lambda p, q: (p["x"] - x) * (q["y"] - y) - (q["x"] - x) * (p["y"] - y)
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + term(e["a"], e["b"]))) / 2


def ring_perimeter(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def compactness(ring: Column) -> Column:
    """Perimeter squared over 4 pi area: 1 for a circle."""
    return F.pow(ring_perimeter(ring), F.lit(2)) / (4 * math.pi * ring_area(ring))


def extents(ring: Column, bearing: Column | float) -> tuple[Column, Column]:
    """Lengths of the ring along and across the bearing, 1 at least."""
    def span(axis: int) -> Column:
        values = F.transform(ring, lambda p: sweep_frame(p["x"], p["y"], bearing)[axis])
        return F.greatest(F.lit(1.0), F.array_max(values) - F.array_min(values))

    return span(0), span(1)


def clip_half_plane(ring: Column, bearing: Column | float, threshold: Column | float, keep_left: bool = True) -> Column:
    """The part of a convex ring (open, at least 3 points) whose cross distance is at most the threshold, or at least it."""
    b = F.radians(num(bearing))
    side = lambda p: (p["x"] * F.cos(b) - p["y"] * F.sin(b) - num(threshold)) * (1.0 if keep_left else -1.0)

    def step(e: Column) -> Column:
        p, q = e["a"], e["b"]
        t = side(p) / (side(p) - side(q))
        cut = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
        own = F.when(side(p) <= 0, F.array(p)).otherwise(F.slice(F.array(p), 1, 0))
        crosses = (side(p) < 0) & (side(q) > 0) | (side(p) > 0) & (side(q) < 0)
        return F.when(crosses, F.concat(own, F.array(cut))).otherwise(own)

    return F.flatten(F.transform(_edges(ring), step))
