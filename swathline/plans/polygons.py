"""Queries of polygon algebra over rectangles derived from the bound tables, whose measures have closed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import ring_area
from ..operators import polygons
from ..sources.bindings import cells, table, with_tables


def _box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Six boxes a row, which overlap, touch or miss their neighbours."""
    n = F.col("s_suppkey")
    i = n % 6
    x0, y0 = i * 100.0 + F.when(i % 3 == 2, 30.0).otherwise(0.0), n % 4 * 10.0
    x1, y1 = x0 + 100 + F.when(n % 5 == 0, 40.0).otherwise(0.0), y0 + 80 + n % 3 * 20.0
    return table(spark, sf, "supplier").select(F.floor(n / 6).alias("line"), n.alias("box"), _box(x0, y0, x1, y1).alias("ring"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    b = _boxes(spark, sf)
    after = b.select("line", (F.col("box") - 1).alias("box"), F.col("ring").alias("b"))
    return b.withColumnRenamed("ring", "a").join(after, ["line", "box"])


def polygon_algebra(spark: SparkSession, sf: str) -> DataFrame:
    """Areas of the union, intersection and difference of neighbouring boxes, and of how many rings the union is."""
    found = polygons.algebra(_pairs(spark, sf), ["box"])
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return found.groupBy("box").agg(*[F.round(of(k, "area"), 4).alias(k) for k in ("union", "intersection", "difference")], of("union", "outers").alias("rings"), of("union", "holes").alias("holes"))


def shared_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("box", F.round(polygons.shared_boundary(F.col("a"), F.col("b")), 4).alias("metres"))


def merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Whether neighbouring boxes can become one area, and why not."""
    return polygons.merge_candidates(_pairs(spark, sf), ["box"]).select("box", F.round("overlap", 4).alias("overlap"), "reason")


def merge_states(spark: SparkSession, sf: str) -> DataFrame:
    """Selections of unit squares in a row, merged from the first; squares that aren't next to those merged so far are refused."""
    n = F.col("p_partkey")
    i = n % 20
    squares = table(spark, sf, "part").select(F.floor(n / 20).alias("line"), n.alias("square"), _box(i * 10.0, F.lit(0.0), i * 10.0 + 10, F.lit(10.0)).alias("ring"), ((i < 9) & (n % 7 != 0)).alias("selected"))
    return polygons.merged(squares, ["line"], "square").select("line", "merged", "refused", "eligible", F.round("area", 3).alias("area"), F.size("ring").alias("corners"))


def nearest_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The box of its row that every place is nearest to."""
    n = F.col("p_partkey")
    gaps = table(spark, sf, "part").select(F.floor(n / 20).alias("line"), n.alias("gap"), (n * 37 % 700).cast("double").alias("x"), (n * 13 % 150 - 20).cast("double").alias("y"))
    found = polygons.nearest_region(gaps, _boxes(spark, sf), ["line"], "gap", "box")
    return found.select("line", "gap", F.round("distance", 4).alias("distance"))


def simplified_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Squares with needless points on their sides, as a coverage: each is a square of four points again, with its area."""
    c = cells(spark, sf).filter("col < 19")
    x, y = F.col("col") * 10.0, F.col("row") * 10.0
    point = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    ring = F.array(*[point(dx, dy) for dx, dy in ((0, 0), (5, 0.3), (10, 0), (10, 5), (10, 10), (5, 10.3), (0, 10), (0, 5))])
    found = polygons.simplified(c.select(F.floor(F.col("row") / 8).alias("block"), "cell", ring.alias("ring")), ["block"], "cell", 1.0)
    return found.select("block", "cell", F.size("ring").alias("points"), F.round(ring_area(F.col("ring")), 4).alias("area"))


QUERIES = {f.__name__: f for f in (polygon_algebra, shared_boundaries, merge_candidates, merge_states, nearest_regions, simplified_coverage)}

_B = """b0 AS (SELECT s_suppkey // 6 AS line, s_suppkey AS box, s_suppkey % 6 * 100::DOUBLE + CASE WHEN s_suppkey % 6 % 3 = 2 THEN 30 ELSE 0 END AS x0, s_suppkey % 4 * 10::DOUBLE AS y0 FROM supplier), b AS (SELECT *, x0 + 100 + CASE WHEN box % 5 = 0 THEN 40 ELSE 0 END AS x1, y0 + 80 + box % 3 * 20 AS y1 FROM b0)"""
_P = f"""{_B}, p AS (SELECT a.box, a.x0 AS ax0, a.x1 AS ax1, a.y0 AS ay0, a.y1 AS ay1, c.x0 AS bx0, c.x1 AS bx1, c.y0 AS by0, c.y1 AS by1 FROM b a JOIN b c ON c.line = a.line AND c.box = a.box + 1),
m AS (SELECT *, greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) AS w, greatest(0, least(ay1, by1) - greatest(ay0, by0)) AS h, (ax1 - ax0) * (ay1 - ay0) AS a, (bx1 - bx0) * (by1 - by0) AS b FROM p)"""
_S = f"""{_P}, sa AS (SELECT box, unnest([{{'x': ax0, 'y': ay0, 'u': ax1, 'v': ay0}}, {{'x': ax1, 'y': ay0, 'u': ax1, 'v': ay1}}, {{'x': ax1, 'y': ay1, 'u': ax0, 'v': ay1}}, {{'x': ax0, 'y': ay1, 'u': ax0, 'v': ay0}}]) AS s FROM p),
sb AS (SELECT box, unnest([{{'x': bx0, 'y': by0, 'u': bx1, 'v': by0}}, {{'x': bx1, 'y': by0, 'u': bx1, 'v': by1}}, {{'x': bx1, 'y': by1, 'u': bx0, 'v': by1}}, {{'x': bx0, 'y': by1, 'u': bx0, 'v': by0}}]) AS t FROM p),
o AS (SELECT sa.box, s, CASE WHEN s.x = s.u AND t.x = t.u AND abs(s.x - t.x) <= 0.25 THEN greatest(0, least(greatest(s.y, s.v), greatest(t.y, t.v)) - greatest(least(s.y, s.v), least(t.y, t.v))) WHEN s.y = s.v AND t.y = t.v AND abs(s.y - t.y) <= 0.25 THEN greatest(0, least(greatest(s.x, s.u), greatest(t.x, t.u)) - greatest(least(s.x, s.u), least(t.x, t.u))) ELSE 0 END AS l FROM sa JOIN sb USING (box)),
g AS (SELECT box, sum(l) AS metres FROM (SELECT box, s, max(l) AS l FROM o GROUP BY ALL) GROUP BY box)"""
ORACLE = {
    "polygon_algebra": f"WITH {_P} SELECT box, round(a + b - w * h, 4) AS \"union\", round(w * h, 4) AS intersection, round(a - w * h, 4) AS difference, (CASE WHEN w * h > 0 OR (h > 0 AND ax1 = bx0) THEN 1 ELSE 2 END)::INTEGER AS rings, 0::INTEGER AS holes FROM m",
    "shared_boundaries": f"WITH {_S} SELECT box, round(metres, 4) AS metres FROM g",
    "merge_candidates": f"WITH {_S} SELECT box, round(w * h, 4) AS overlap, CASE WHEN metres < 1 THEN 'apart' WHEN w * h > 0.01 AND w * h / metres > 0.25 THEN 'overlapping' END AS reason FROM m JOIN g USING (box)",
    "merge_states": """WITH s AS (SELECT p_partkey // 20 AS line, p_partkey % 20 AS i, p_partkey % 20 < 9 AND p_partkey % 7 <> 0 AS picked FROM part), f AS (SELECT line, min(i) AS a FROM s WHERE picked GROUP BY line),
        e AS (SELECT f.line, a, coalesce(min(i) FILTER (i > a AND NOT picked), a + count(*) FILTER (i >= a)) AS b, count(*) FILTER (picked) AS n, bool_or(i = a - 1) AS before, max(i) AS top FROM f JOIN s USING (line) GROUP BY f.line, a), k AS (SELECT *, (SELECT count(*) FROM s WHERE s.line = e.line AND i = e.b) AS after FROM e)
        SELECT line, (b - a)::INTEGER AS merged, (n - (b - a))::INTEGER AS refused, (before::INTEGER + after)::INTEGER AS eligible, round((b - a) * 100::DOUBLE, 3) AS area, 4::INTEGER AS corners FROM k""",
    "nearest_regions": f"""WITH {_B}, g AS (SELECT p_partkey // 20 AS line, p_partkey AS gap, (p_partkey * 37 % 700)::DOUBLE AS x, (p_partkey * 13 % 150 - 20)::DOUBLE AS y FROM part),
        d AS (SELECT g.line, gap, CASE WHEN x > x0 AND x < x1 AND y > y0 AND y < y1 THEN least(x - x0, x1 - x, y - y0, y1 - y) ELSE sqrt(pow(greatest(x0 - x, x - x1, 0), 2) + pow(greatest(y0 - y, y - y1, 0), 2)) END AS d FROM g JOIN b USING (line)) SELECT line, gap, round(min(d), 4) AS distance FROM d GROUP BY line, gap""",
    "simplified_coverage": with_tables("SELECT row // 8 AS block, cell, 4::INTEGER AS points, 100::DOUBLE AS area FROM cells WHERE col < 19", "cells"),
}
