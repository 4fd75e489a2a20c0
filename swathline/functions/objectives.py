"""Costs of flying a region at a heading and of partitions into regions, the planner's variant, as Column expressions.

The solver's variant (scores.py, operators.weighted.node_cost) has other constants; the two are never mixed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import axial_delta, clamp, num
from .geo import _edges

#: Least area, greatest aspect ratio, least convexity and preferred width in line spacings of a region.
LEAST_AREA, MOST_ASPECT, LEAST_CONVEXITY, WIDTH_SPACINGS = 4000.0, 10.0, 0.38, 2.5
#: Seconds between regions, the unit of time costs, and what a region that can't be flown costs more.
TRANSITION, TIME_UNIT, INVALID_COST = 35.0, 180.0, 50.0
#: Hard floor of mean lines, and divisor and weights of fallback plans.
HARD_LINE, FALLBACK_TIME, SOFT_TOTAL, SOFT_MOST = 20.0, 7500.0, 0.01, 0.002
#: Weights of a partition's signals by kind of sensor.
LIDAR_WEIGHTS = {"worst_hole": 4.8, "worst_low": 2.9, "worst_q10": 2.1, "worst_mean": 0.9, "hole": 4.2, "low": 2.4, "q10": 1.9, "q25": 1.2, "mean": 0.8, "time": 0.18, "regions": 0.035}
CAMERA_WEIGHTS = {"worst_q90": 2.6, "worst_mean": 2.0, "worst_max": 1.2, "q90": 1.0, "q75": 0.7, "mean": 0.4, "max": 0.25, "time": 0.35, "regions": 0.12}
#: Costs of the grades of a plane's fit.
GRADE_COST = {"excellent": 0.05, "good": 0.35, "fair": 1.1, "poor": 2.4}
#: Fixed values of a face of terrain: greatest aspect ratio and least convexity.
FACE_ASPECT, FACE_CONVEXITY = 8.0, 0.45


def _up(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def fit_grade(r2: Column, rmse: Column, samples: Column) -> Column:
    """How well a plane fits: excellent, good, fair or poor; under ten samples always poor."""
    step = lambda a, b: (r2 > a) & (rmse < b)
    return F.when(samples < 10, "poor").when(step(0.95, 2), "excellent").when(step(0.85, 5), "good").when(step(0.7, 10), "fair").otherwise("poor")


def regularization(area: Column, along: Column, across: Column, convexity: Column, perimeter: Column, spacing: Column, fragments: Column, fragment_share: Column, gaps: Column, transit: Column) -> Column:
    """struct<penalty, invalid> of a region's shape and flight: narrow, long, hollow, ragged, broken or small ones cost more."""
    aspect = F.greatest(along, across) / F.greatest(F.lit(1.0), F.least(along, across))
    compact = F.when(perimeter > 0, perimeter * perimeter / (4 * math.pi * F.greatest(F.lit(1.0), area))).otherwise(1.0)
    wanted = F.greatest(F.lit(45.0), WIDTH_SPACINGS * spacing)
    parts = [
        2.5 * _up(wanted - across) / wanted, 0.25 * _up(aspect - MOST_ASPECT), 4 * _up(LEAST_CONVEXITY - convexity), 0.18 * _up(compact - 3),
        0.65 * F.least(F.lit(2.5), fragment_share * 3.2 + fragments / 8), 0.9 * F.least(F.lit(3.0), gaps / F.greatest(F.lit(1.0), perimeter * 0.55, spacing * 8)),
        0.75 * F.least(F.lit(2.5), transit * 5.5), 2 * _up(LEAST_AREA - area) / LEAST_AREA,
    ]
    invalid = (area < LEAST_AREA / 2) | (convexity < LEAST_CONVEXITY / 2) | ((convexity < 0.58) & (transit > 0.18))
    return F.struct(sum(parts, F.lit(0.0)).alias("penalty"), invalid.alias("invalid"))


def orientation_cost(quality: Column, seconds: Column, penalty: Column, invalid: Column, tradeoff: float = 0.5) -> Column:
    """Quality against time, and the penalties of shape."""
    return tradeoff * quality + (1 - tradeoff) * seconds / TIME_UNIT + penalty + F.when(invalid, INVALID_COST).otherwise(0.0)


def mismatch(bearing: Column, conf: Column, heading: Column | float) -> tuple[Column, Column]:
    """The angle from a cell's preferred bearing, and the loss by it."""
    delta = axial_delta(bearing, heading)
    return delta, F.pow(F.sin(F.radians(delta)), F.lit(2)) * (0.35 + 0.65 * conf)


def cell_risk(bearing: Column, slope: Column, conf: Column, heading: Column | float, altitude: float, reach: float = 200.0, fov: float = 90.0) -> dict[str, Column]:
    """Loss, cross slope, density factor and risk of holes of flying a cell at a heading."""
    delta, loss = mismatch(bearing, conf, heading)
    steep = clamp(F.abs(F.sin(F.radians(delta))) * (slope / 0.12), 0, 1.8)
    lift = steep * (0.55 + 0.45 * conf)
    over = _up(F.hypot(altitude * (1 + 0.65 * lift), F.lit(altitude * math.tan(math.radians(fov) / 2))) / max(1.0, reach) - 1)
    return {"loss": loss, "steep": steep, "holes": clamp(2.8 * over + _up(loss + 0.45 * lift - 1.02), 0, 1), "dense": clamp(1 - 1.05 * loss - 0.42 * lift - 1.6 * over, 0, 1.15)}


def partition_cost(quality: Column, seconds: Column, penalty: Column, area: Column, tradeoff: float = 0.5) -> dict[str, Column]:
    """Aggregates over the regions of a partition: quality by area, time with transitions, and their cost."""
    q = F.sum(quality * area) / F.greatest(F.lit(1.0), F.sum(area))
    t = F.sum(seconds) + (F.count(F.lit(1)) - 1) * TRANSITION
    return {"quality": q, "seconds": t, "cost": tradeoff * q + (1 - tradeoff) * t / TIME_UNIT + F.sum(penalty)}


def breakdown(signals: Column, weights: dict[str, float]) -> Column:
    """struct<parts, total>: a map of signals times their weights; signals without a weight count nothing."""
    known = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
    parts = F.map_zip_with(known, signals, lambda _, w, s: F.coalesce(w * s, F.lit(0.0)))
    return F.struct(parts.alias("parts"), F.aggregate(F.map_values(parts), F.lit(0.0), lambda a, x: a + x).alias("total"))


def time_penalty(seconds: Column, fastest: Column) -> Column:
    return F.when(fastest > 0, _up(seconds / fastest - 1)).otherwise(0.0)


def practical_region(area: Column, convexity: Column, compactness: Column, invalid: Column, least: float = LEAST_AREA) -> Column:
    """Whether a region can stand in a partition; partitions of one region never do."""
    return (area >= least) & (convexity >= 0.7) & (compactness <= 5.25) & ~((convexity < 0.74) & (compactness > 4.25)) & ~invalid


def hard_and_soft(margins: Column, mean_line: Column) -> tuple[Column, Column]:
    """A region's failed gates (map of margins) as those that stay and those that a fallback may bend.

    Too little area, too few lines and a hollow shape stay; short lines stay only below a hard floor, by what they lack to it.
    """
    stays = lambda k: k.isin("invalid", "fraction", "lines", "convexity")
    floor = mean_line < HARD_LINE
    is_line = lambda k: k == "mean_line"
    hard = F.map_filter(margins, lambda k, _: stays(k) | (is_line(k) & floor))
    hard = F.transform_values(hard, lambda k, m: F.when(is_line(k), HARD_LINE - mean_line).otherwise(m))
    return hard, F.map_filter(margins, lambda k, _: ~stays(k) & ~(is_line(k) & floor))


def fallback_score(quality: Column, seconds: Column, base_quality: Column, base_seconds: Column, soft_total: Column, soft_most: Column) -> Column:
    """Of a plan that fails soft gates, against the plan without a split."""
    return quality + _up(quality - base_quality) + _up(seconds - base_seconds) / FALLBACK_TIME + SOFT_TOTAL * soft_total + SOFT_MOST * soft_most


def viable(covered: Column, overlap: Column) -> Column:
    return (covered >= 0.5) & (overlap <= 0.35)


def face_score(area: Column, along: Column, across: Column, convexity: Column, grade: Column, r2: Column, rmse: Column, spacing: Column, lines: Column, short_lines: Column, median: Column, fragments: Column, forced: bool = False) -> Column:
    """The cost of a face of terrain flown along its contour; null where it is too small, narrow, hollow or short."""
    width = F.greatest(F.lit(45.0), 2 * spacing) if forced else F.greatest(F.lit(60.0), 3 * spacing)
    short = F.greatest(F.lit(90.0), 4 * spacing) if forced else F.greatest(F.lit(120.0), 6 * spacing)
    a, b, c = (0.55, 0.3, 0.5) if forced else (0.75, 0.45, 0.7)
    good = (area >= LEAST_AREA) & (across >= a * width) & (lines > 0) & (median >= b * short) & (convexity >= c * FACE_CONVEXITY)
    grades = F.create_map(*[x for g, v in GRADE_COST.items() for x in (F.lit(g), F.lit(v))])
    terrain = F.coalesce(F.element_at(grades, grade), F.lit(GRADE_COST["poor"])) + clamp(rmse / 6, 0, 4) + clamp(3.5 * (1 - _up(r2)), 0, 4)
    flight = 4 * short_lines / F.greatest(F.lit(1), lines) + 4 * _up(short - median) / short + 0.9 * fragments + 0.08 * _up(lines - 14.0)
    aspect = F.greatest(along, across) / F.greatest(F.lit(1.0), F.least(along, across))
    shape = 6 * _up(width - across) / width + 0.45 * _up(aspect - FACE_ASPECT) + 5 * _up(FACE_CONVEXITY - convexity)
    return F.when(good, 1.7 * terrain + flight + shape)


def hull_area(ring: Column) -> Column:
    """The area of the convex hull of a ring's corners: sides are the pairs with no corner to their right or beyond them."""
    o = F.get(ring, F.lit(0))
    cross = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])

    def outside(p: Column, q: Column, r: Column) -> Column:
        dot = (r["x"] - p["x"]) * (q["x"] - p["x"]) + (r["y"] - p["y"]) * (q["y"] - p["y"])
        length = F.pow(q["x"] - p["x"], F.lit(2)) + F.pow(q["y"] - p["y"], F.lit(2))
        c = cross(p, q, r)
        return (c < 0) | ((c == 0) & ((dot < 0) | (dot > length)))

    corners = F.array_distinct(ring)
    side = lambda p, q: ((p["x"] != q["x"]) | (p["y"] != q["y"])) & ~F.exists(corners, lambda r: outside(p, q, r))
    of = lambda p: F.aggregate(corners, F.lit(0.0), lambda s, q: s + F.when(side(p, q), cross(o, p, q)).otherwise(0.0))
    return F.aggregate(F.transform(corners, of), F.lit(0.0), lambda s, x: s + x) / 2


def zoom_for_ring(ring: Column) -> Column:
    """The zoom of terrain for a ring in degrees, by its area on the sphere."""
    term = lambda e: F.radians(e["b"]["x"] - e["a"]["x"]) * (2 + F.sin(F.radians(e["a"]["y"])) + F.sin(F.radians(e["b"]["y"])))
    area = F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + term(e))) * 6_371_000.0**2 / 2
    return F.when((F.size(ring) < 3) | (area < 1e5), 15).when(area < 1e6, 14).when(area < 1e7, 13).otherwise(12)


def spacing_for_width(width: Column) -> Column:
    """Metres between lines for an area so wide across them: by steps, and 3 to 20 lines."""
    by_step = F.when(width < 200, 25.0).when(width < 500, 50.0).when(width < 1000, 100.0).when(width < 2000, 150.0).otherwise(200.0)
    lines = F.ceil(width / by_step)
    return F.when(lines < 3, width / 3).when(lines > 20, width / 20).otherwise(by_step)


def width_across(ring: Column, bearing: Column | float) -> Column:
    """How wide a ring in degrees is across a bearing, by distance and bearing of its corners from the middle of its box."""
    from .geo import haversine, initial_bearing

    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    cx, cy = (F.array_min(xs) + F.array_max(xs)) / 2, (F.array_min(ys) + F.array_max(ys)) / 2
    off = F.transform(ring, lambda p: haversine(cx, cy, p["x"], p["y"]) * F.cos(F.radians(initial_bearing(cx, cy, p["x"], p["y"]) - num(bearing) - 90)))
    return F.array_max(off) - F.array_min(off)


def box_entry(x: Column, y: Column, dx: Column, dy: Column, box: tuple, reach: float) -> tuple[Column, Column]:
    """(enter, leave): the distances along a ray at which it is inside a box, within reach; null if never."""
    enter, leave, missed = F.lit(0.0), F.lit(float(reach)), F.lit(False)
    for p, d, lo, hi in ((x, dx, box[0], box[2]), (y, dy, box[1], box[3])):
        still = F.abs(d) < 1e-9
        t0, t1 = (num(lo) - p) / F.when(~still, d), (num(hi) - p) / F.when(~still, d)
        enter = F.when(still, enter).otherwise(F.greatest(enter, F.least(t0, t1)))
        leave = F.when(still, leave).otherwise(F.least(leave, F.greatest(t0, t1)))
        missed = missed | (still & ((p < num(lo)) | (p > num(hi))))
    hit = ~missed & (leave >= enter)
    return F.when(hit, enter), F.when(hit, leave)


def pixel_index(size: int, x: Column, y: Column, min_x: Column, max_y: Column, pixel: Column | float) -> Column:
    """struct<row, col, index> of the pixel that holds a point; null outside."""
    row, col = F.floor((max_y - y) / num(pixel)), F.floor((x - min_x) / num(pixel))
    inside = (row >= 0) & (row < size) & (col >= 0) & (col < size)
    return F.when(inside, F.struct(row.alias("row"), col.alias("col"), (row * size + col).alias("index")))


def run_plan(wait: Column, auto: Column, imported: Column, ready: Column, polygons: Column, lines: Column, lidar: Column, poses: Column, retries: Column, reason: Column, limit: int = 15) -> Column:
    """struct<kind, retries, whole>: what a request for coverage does next: nothing, compute, or try again in 250 ms.

    whole: changed lines, spacing or altitude make the whole raster anew, in place of the one polygon that was asked for.
    """
    plan = lambda kind, n, whole=F.lit(False): F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("retries"), whole.alias("whole"))
    again = F.when(retries < limit, plan("retry", retries + 1)).otherwise(plan("noop", F.lit(0)))
    given = ~auto & (imported > 0)
    return (
        F.when(wait, plan("noop", retries)).when(given & ready, plan("compute", F.lit(0))).when(given, again).when(~auto, plan("noop", retries))
        .when(ready & ~polygons & (imported == 0), plan("noop", F.lit(0))).when(ready & polygons & lines & (poses == 0) & ~lidar, plan("noop", retries))
        .when(ready & polygons & lines, plan("compute", F.lit(0), F.coalesce(reason.isin("lines", "spacing", "alt"), F.lit(False)))).otherwise(again)
    )
