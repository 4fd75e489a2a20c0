"""Queries of flights over boxes and of bearing searches over regions, made of the bound tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bearings, flights, weighted
from ..sources.bindings import cells, table, with_tables


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Upright boxes, one a supplier: x from 0, and centres a kilometre apart."""
    n = F.col("s_suppkey")
    x, y, w, h = n * 1000.0, n % 17 * 300.0, 200.0 + n % 9 * 37, 150.0 + n % 7 * 51
    corner = lambda a, b: F.struct((x + a * w).alias("x"), (y + b * h).alias("y"))
    return table(spark, sf, "supplier").select(n.alias("area"), F.array(corner(-0.5, -0.5), corner(0.5, -0.5), corner(0.5, 0.5), corner(-0.5, 0.5)).alias("ring"))


def _ground(x: Column, y: Column) -> Column:
    return 400 + x / 50 + y / 20


def area_sweeps(spark: SparkSession, sf: str) -> DataFrame:
    """Northward sweeps of every box, 40 m apart, in the order flown."""
    s = flights.sweeps(_boxes(spark, sf), ["area"], 0.0, 40.0)
    return s.select("area", "seq", "line", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


def _lifted(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    return flights.heights(flights.sweeps(_boxes(spark, sf), ["area"], 0.0, 40.0), ["area"], _ground, 110.0, 60.0, mode)


def sweep_heights(spark: SparkSession, sf: str) -> DataFrame:
    """The ground under every sweep and its turns, and the heights of both modes."""
    a = _lifted(spark, sf, "legacy").select("area", "seq", *[F.round(c, 4).alias(c) for c in ("low", "high", "z")])
    return a.join(_lifted(spark, sf, "min-clearance").select("area", "seq", F.round("z", 4).alias("z_clear")), ["area", "seq"])


def traversals(spark: SparkSession, sf: str) -> DataFrame:
    """Where every box's flight begins and ends, either way round, and the circles that lead in and out."""
    t = flights.traversals(_lifted(spark, sf, "legacy"), ["area"])
    both = t.join(flights.leads(t, ["area"], 50.0), ["area", "flip"])
    return both.select("area", "flip", *[F.round(c, 3).alias(c) for c in ("x1", "y1", "z1", "x2", "y2", "z2", "in_x", "in_y", "out_x", "out_y")])


def turn_points(spark: SparkSession, sf: str) -> DataFrame:
    t = flights.turn_points(flights.sweeps(_boxes(spark, sf), ["area"], 0.0, 40.0), ["area"], 0.0, 30.0)
    return t.select("area", "seq", *[F.round(f"{n}.{c}", 3).alias(f"{n}_{c}") for n in ("off", "loiter", "next") for c in "xy"])


def turn_previews(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as flown: how many of each box reach the next sweep, and how long they are at least and at most."""
    s = flights.sweeps(_boxes(spark, sf), ["area"], 0.0, 120.0)
    p = flights.turn_previews(flights.turn_points(s, ["area"], 0.0, 60.0), ["area"], 0.0, 60.0, 16.0)
    return p.groupBy("area").agg(F.count(F.lit(1)).alias("turns"), F.count(F.when(F.col("reached"), 1)).alias("reached"), F.round(F.min("metres"), 1).alias("least"), F.round(F.max("metres"), 1).alias("most"))


def area_ways(spark: SparkSession, sf: str) -> DataFrame:
    """Ways from every box to the next: at one height, at another, in steps, or straight."""
    n = F.col("s_suppkey")
    p = table(spark, sf, "supplier").select(n.alias("area"), (n * 10.0).alias("x1"), F.lit(0.0).alias("y1"), (450.0 + n % 60 * 5).alias("z1"), (n * 10.0 + n % 29 * 90).alias("x2"), (n % 5 * 100.0).alias("y2"), (460.0 + n % 43 * 6).alias("z2"))
    hills = lambda x, y: F.when(x <= 9500, 400 + 70 * F.sin(x / 300) + y / 20)
    w = flights.ways(p, ["area"], hills, 50.0, 120.0)
    return w.select("area", "strategy", *[F.round(c, 4).alias(c) for c in ("z", "metres", "worst")], F.round(F.when(F.col("strategy") != "stepped", F.col("seconds")), 4).alias("seconds"), F.round(F.when(F.col("strategy") != "stepped", F.col("cost")), 4).alias("cost"))


def _evaluate(spark: SparkSession, sf: str):
    c = cells(spark, sf).select("region", "bearing", "conf", (F.col("area") / 1000).alias("slope"), "area")

    def run(wanted: DataFrame) -> DataFrame:
        met = wanted.withColumnRenamed("bearing", "heading").join(c, "region")
        cost = weighted.node_cost(F.col("bearing"), F.col("slope"), F.col("conf"), F.col("heading"))["quality"]
        return met.groupBy("region", F.col("heading").alias("bearing")).agg(F.round(weighted.weighted_mean(cost, F.col("area")), 9).alias("cost"))

    return run


def bearing_search(spark: SparkSession, sf: str) -> DataFrame:
    """The best bearing of every region, from twelve to single degrees."""
    regions = cells(spark, sf).select("region").distinct()
    return bearings.search(regions, ["region"], _evaluate(spark, sf)).select("region", "bearing", F.round("cost", 6).alias("cost"))


def seeded_search(spark: SparkSession, sf: str) -> DataFrame:
    """The best bearing of every region near a seed."""
    regions = cells(spark, sf).groupBy("region").agg((F.min("cell") * 13 % 180).cast("double").alias("seed"))
    return bearings.search(regions, ["region"], _evaluate(spark, sf), seed="seed", offsets=(-30.0, -20.0, -10.0, 0.0, 10.0, 20.0, 30.0)).select("region", "bearing", F.round("cost", 6).alias("cost"))


def _circle(spark: SparkSession, sf: str, step: int) -> DataFrame:
    every = cells(spark, sf).select("region").distinct().select("region", F.explode(F.transform(F.sequence(F.lit(0), F.lit(179), F.lit(step)), lambda b: b.cast("double"))).alias("bearing"))
    return _evaluate(spark, sf)(every)


def surrogate_basins(spark: SparkSession, sf: str) -> DataFrame:
    found = bearings.basins(_circle(spark, sf, 5), ["region"], window=0.2)
    return found.select("region", F.array_join(F.transform("bearings", lambda b: b.cast("int").cast("string")), " ").alias("bearings"))


def hotspots(spark: SparkSession, sf: str) -> DataFrame:
    """Local minima over eighteen bearings of regions with enough poses."""
    c = _circle(spark, sf, 10).withColumn("poses", F.length("region") * 100 - 600)
    return bearings.hotspots(c, ["region"], "poses", enough=100).select("region", "bearing", F.round("cost", 6).alias("cost"))


def _faces(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return c.select(F.floor(F.col("row") / 5).alias("block"), "cell", "row", "col", (F.col("col") * 100.0).alias("x"), (F.col("row") * 100.0).alias("y"), "area", F.pmod(F.floor(F.col("col") / 7 + F.col("row") / 50) * 55.0 + F.col("cell") % 5, F.lit(180.0)).alias("bearing"))


def face_splits(spark: SparkSession, sf: str) -> DataFrame:
    return bearings.face_splits(_faces(spark, sf), ["block"]).select("block", F.round("gain", 6).alias("gain"))


def face_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Areas cut into faces, and how many are left when those that are as good as one are joined."""
    leaves = bearings.face_partition(_faces(spark, sf), ["block"])
    t = F.radians(2 * F.col("bearing"))
    sums = leaves.groupBy("block", "leaf").agg(F.sum("area").alias("area"), F.sum(F.cos(t) * F.col("area")).alias("c"), F.sum(F.sin(t) * F.col("area")).alias("s"), F.count(F.lit(1)).alias("n"))
    side = lambda dr, dc: leaves.select("block", "row", "col", F.col("leaf").alias("left")).join(leaves.select("block", (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("leaf").alias("right")), ["block", "row", "col"])
    borders = side(0, 1).unionByName(side(1, 0)).filter("left <> right").select("block", "left", "right").distinct()
    merged = bearings.merge_leaves(sums.drop("n"), borders, ["block"])
    return merged.join(sums.select("block", "leaf", "n"), ["block", "leaf"]).groupBy("block").agg(F.count(F.lit(1)).alias("leaves"), F.countDistinct("merged").alias("faces"), F.sum("n").alias("cells"))


def sampled_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The older way of lines over every box: samples on lines across its circle, the first and last inside."""
    from ..operators.generators import clipped_lines

    return clipped_lines(_boxes(spark, sf), ["area"], 0.0, 41.0).select("area", "line", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


QUERIES = {f.__name__: f for f in (area_sweeps, sweep_heights, traversals, turn_points, turn_previews, area_ways, bearing_search, seeded_search, surrogate_basins, hotspots, face_splits, face_partition, sampled_lines)}

_BOX = "b AS (SELECT s_suppkey AS area, s_suppkey * 1000::DOUBLE AS x, s_suppkey % 17 * 300::DOUBLE AS y, 200::DOUBLE + s_suppkey % 9 * 37 AS w, 150::DOUBLE + s_suppkey % 7 * 51 AS h FROM supplier)"
_SWEEPS = f"""{_BOX}, l AS (SELECT *, unnest(range(ceil(-w / 80)::BIGINT, ceil(w / 80)::BIGINT)) AS line FROM b), k AS (SELECT *, (row_number() OVER (PARTITION BY area ORDER BY line) - 1)::INTEGER AS seq FROM l),
s AS (SELECT area, seq, line, x + line * 40 AS x1, CASE WHEN seq % 2 = 0 THEN y - h / 2 ELSE y + h / 2 END AS y1, x + line * 40 AS x2, CASE WHEN seq % 2 = 0 THEN y + h / 2 ELSE y - h / 2 END AS y2 FROM k)"""
_LIFT = f"""{_SWEEPS}, g AS (SELECT *, 400 + x1 / 50 + least(y1, y2) / 20 AS low, 400 + x1 / 50 + greatest(y1, y2) / 20 AS own, 400 + x1 / 50 + y1 / 20 AS g1, 400 + x2 / 50 + y2 / 20 AS g2 FROM s), u AS (SELECT *, greatest(own, coalesce(lag(g2) OVER q, own), coalesce(lead(g1) OVER q, own)) AS high FROM g WINDOW q AS (PARTITION BY area ORDER BY seq))"""
_COST = """r AS (SELECT c.region, h.range::DOUBLE AS bearing, c.area, c.conf, c.area / 1000 AS slope, radians(least(abs(c.bearing - h.range), 180 - abs(c.bearing - h.range))) AS d FROM cells c, range(180) h), q AS (SELECT *, pow(sin(d), 2) * (0.35 + 0.65 * conf) AS m, greatest(0, least(1.8, sin(d) * slope / 0.12)) AS x FROM r),
cost AS (SELECT region, bearing, round(sum((1.35 * m + 0.35 * x + 1.05 * greatest(0, least(1, greatest(0, m - 0.3) * 1.8 + greatest(0, x - 1) * 0.5))) * area) / sum(area), 9) AS cost FROM q GROUP BY region, bearing)"""


def _walk(start: str) -> str:
    return f"""WITH RECURSIVE {_COST}, f AS ({start}), walk(region, deg, cost, step, n) AS (SELECT region, bearing, cost, 8::DOUBLE, 0 FROM f UNION ALL
      SELECT region, CASE WHEN go THEN nb ELSE deg END, CASE WHEN go THEN nc ELSE cost END, CASE WHEN go AND n < 11 THEN step ELSE step / 2 END, CASE WHEN go AND n < 11 THEN n + 1 ELSE 0 END FROM (
        SELECT w.region, w.deg, w.cost, w.step, w.n, CASE WHEN a.cost < b.cost OR (a.cost = b.cost AND a.bearing < b.bearing) THEN a.bearing ELSE b.bearing END AS nb, least(a.cost, b.cost) AS nc, w.cost - least(a.cost, b.cost) > 1e-4 AS go
        FROM walk w JOIN cost a ON a.region = w.region AND a.bearing = fmod(w.deg - w.step + 180, 180::DOUBLE) JOIN cost b ON b.region = w.region AND b.bearing = fmod(w.deg + w.step, 180::DOUBLE) WHERE w.step >= 1) z)
    SELECT region, deg AS bearing, round(cost, 6) AS cost FROM walk WHERE step < 1"""


def _split_cte() -> str:
    mixed = "sqrt(pow({0}, 2) + pow({1}, 2))"
    return f"""WITH f AS (SELECT row // 5 AS block, cell, col * 100::DOUBLE AS x, row * 100::DOUBLE AS y, area, fmod(floor(col / 7::DOUBLE + row / 50::DOUBLE) * 55 + cell % 5, 180::DOUBLE) AS bearing FROM cells), a AS (SELECT *, unnest(range(0, 180, 15)) AS angle FROM f),
    p AS (SELECT *, x * cos(radians(angle)) - y * sin(radians(angle)) AS p, cos(radians(2 * bearing)) * area AS c, sin(radians(2 * bearing)) * area AS s FROM a), w AS (SELECT *, min(p) OVER q AS lo, max(p) OVER q AS hi FROM p WINDOW q AS (PARTITION BY block, angle)),
    u AS (SELECT w.*, f.fr, p <= (lo + hi) / 2 + fr * (hi - lo) / 2 AS l FROM w, (VALUES (-0.35::DOUBLE), (-0.18), (0), (0.18), (0.35)) f(fr)),
    g AS (SELECT block, angle, fr, coalesce(sum(area) FILTER (l), 0) AS la, coalesce(sum(area) FILTER (NOT l), 0) AS ra, {mixed.format("coalesce(sum(c) FILTER (l), 0)", "coalesce(sum(s) FILTER (l), 0)")} AS lr, {mixed.format("coalesce(sum(c) FILTER (NOT l), 0)", "coalesce(sum(s) FILTER (NOT l), 0)")} AS rr, {mixed.format("sum(c)", "sum(s)")} AS wr FROM u GROUP BY ALL)
    SELECT block, round(max(round((lr + rr - wr) / (2 * (la + ra)) - 0.02, 9)), 6) AS gain FROM g WHERE least(la, ra) >= 0.1 * (la + ra) GROUP BY block"""


ORACLE = {
    "area_sweeps": f"WITH {_SWEEPS} SELECT area, seq, line, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM s",
    "sweep_heights": f"WITH {_LIFT} SELECT area, seq, round(low, 4) AS low, round(high, 4) AS high, round(high + 110, 4) AS z, round(greatest(low + 110, high + 80), 4) AS z_clear FROM u",
    "traversals": f"""WITH {_LIFT}, e AS (SELECT area, arg_min(x1, seq) AS ax, arg_min(y1, seq) AS ay, arg_min(high, seq) + 110 AS az, arg_max(x2, seq) AS bx, arg_max(y2, seq) AS by_, arg_max(high, seq) + 110 AS bz FROM u GROUP BY area),
        t AS (SELECT area, 0::INTEGER AS flip, ax AS x1, ay AS y1, az AS z1, bx AS x2, by_ AS y2, bz AS z2 FROM e UNION ALL SELECT area, 1, bx, by_, bz, ax, ay, az FROM e), n AS (SELECT *, greatest(1e-9, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) AS n FROM t)
        SELECT area, flip, round(x1, 3) AS x1, round(y1, 3) AS y1, round(z1, 3) AS z1, round(x2, 3) AS x2, round(y2, 3) AS y2, round(z2, 3) AS z2, round(x1 + (y2 - y1) / n * 50, 3) AS in_x, round(y1 - (x2 - x1) / n * 50, 3) AS in_y, round(x2 + (y2 - y1) / n * 50, 3) AS out_x, round(y2 - (x2 - x1) / n * 50, 3) AS out_y FROM n""",
    "turn_points": f"WITH {_SWEEPS}, n AS (SELECT *, lead(x1) OVER q AS nx, lead(y1) OVER q AS ny FROM s WINDOW q AS (PARTITION BY area ORDER BY seq)) SELECT area, seq, round(x2, 3) AS off_x, round(y2 + sign(y2 - y1) * 80, 3) AS off_y, round(x2 + 30, 3) AS loiter_x, round(y2 + sign(y2 - y1) * 80, 3) AS loiter_y, round(nx, 3) AS next_x, round(ny, 3) AS next_y FROM n WHERE nx IS NOT NULL",
    "area_ways": """WITH p AS (SELECT s_suppkey AS area, s_suppkey * 10::DOUBLE AS x1, 450::DOUBLE + s_suppkey % 60 * 5 AS z1, s_suppkey * 10::DOUBLE + s_suppkey % 29 * 90 AS x2, s_suppkey % 5 * 100::DOUBLE AS y2, 460::DOUBLE + s_suppkey % 43 * 6 AS z2 FROM supplier), l AS (SELECT *, sqrt(pow(x2 - x1, 2) + y2 * y2) AS m FROM p), n AS (SELECT *, greatest(2, ceil(m / 30)::BIGINT + 1) AS n FROM l),
        k AS (SELECT *, unnest(range(n)) AS i FROM n), g AS (SELECT *, CASE WHEN x1 + (x2 - x1) * (i / (n - 1)::DOUBLE) <= 9500 THEN 400 + 70 * sin((x1 + (x2 - x1) * (i / (n - 1)::DOUBLE)) / 300) + y2 * (i / (n - 1)::DOUBLE) / 20 END AS g FROM k), d AS (SELECT *, abs(g - lag(g) OVER (PARTITION BY area ORDER BY i)) AS dg FROM g),
        f AS (SELECT area, any_value(m) AS m, any_value(z1) AS z1, any_value(z2) AS z2, greatest(any_value(z1), any_value(z2)) AS own, max(g) + 49.5 AS lo, min(g) + 120.5 AS hi, bool_and(g IS NOT NULL) AS known, max(dg) AS dg FROM d GROUP BY area),
        s AS (SELECT *, CASE WHEN NOT known THEN 'direct' WHEN own >= lo AND own <= hi THEN 'level' WHEN lo <= hi THEN 'adjusted' WHEN dg <= 70 THEN 'stepped' ELSE 'direct' END AS s FROM f), z AS (SELECT *, CASE WHEN s = 'adjusted' THEN greatest(lo, least(hi, own)) ELSE own END AS z FROM s),
        c AS (SELECT *, greatest(0, z - z1) + greatest(0, z2 - z) AS up, greatest(0, z1 - z) + greatest(0, z - z2) AS down FROM z)
        SELECT area, s AS strategy, round(z, 4) AS z, round(m, 4) AS metres, round(CASE WHEN s = 'stepped' THEN 0 WHEN known THEN greatest(0, lo - z, z - hi) END, 4) AS worst, round(CASE WHEN s <> 'stepped' THEN greatest(m / 16, up / 4, down / 3) END, 4) AS seconds, round(CASE WHEN s <> 'stepped' THEN m / 16 + 2.5 * up / 4 + 0.6 * down / 3 END, 4) AS cost FROM c""",
    "bearing_search": with_tables(_walk("SELECT region, min_by(bearing, (cost, bearing)) AS bearing, min(cost) AS cost FROM cost WHERE bearing % 15 = 0 GROUP BY region"), "cells"),
    "seeded_search": with_tables(_walk("SELECT cost.region, min_by(bearing, (cost, bearing)) AS bearing, min(cost) AS cost FROM cost JOIN (SELECT region, min(cell) * 13 % 180 AS seed FROM cells GROUP BY region) s ON s.region = cost.region JOIN range(-30, 31, 10) o ON bearing = (seed + o.range + 180) % 180 GROUP BY cost.region"), "cells"),
    "surrogate_basins": with_tables(
        f"""WITH {_COST}, c AS (SELECT region, bearing, cost FROM cost WHERE bearing % 5 = 0), a AS (SELECT region, min_by(bearing, (cost, bearing)) AS b1, min(cost) * (1 + 0.2::DOUBLE) AS top FROM c GROUP BY region),
        d AS (SELECT a.region, any_value(b1) AS b1, any_value(top) AS top, min_by(c.bearing, (c.cost, c.bearing)) AS b2 FROM a LEFT JOIN c ON c.region = a.region AND c.cost <= top AND least(abs(c.bearing - b1), 180 - abs(c.bearing - b1)) >= 30 GROUP BY a.region),
        e AS (SELECT d.region, any_value(b1) AS b1, any_value(b2) AS b2, min_by(c.bearing, (c.cost, c.bearing)) AS b3 FROM d LEFT JOIN c ON c.region = d.region AND c.cost <= top AND least(abs(c.bearing - b1), 180 - abs(c.bearing - b1)) >= 30 AND least(abs(c.bearing - b2), 180 - abs(c.bearing - b2)) >= 30 GROUP BY d.region)
        SELECT region, concat_ws(' ', b1::INTEGER, b2::INTEGER, b3::INTEGER) AS bearings FROM e""",
        "cells",
    ),
    "hotspots": with_tables(f"WITH {_COST}, c AS (SELECT region, bearing, cost FROM cost WHERE bearing % 10 = 0 AND length(region) * 100 - 600 > 100) SELECT c.region, c.bearing, round(c.cost, 6) AS cost FROM c JOIN c b ON b.region = c.region AND b.bearing = (c.bearing + 170) % 180 JOIN c a ON a.region = c.region AND a.bearing = (c.bearing + 10) % 180 WHERE c.cost <= b.cost AND c.cost < a.cost", "cells"),
    "face_splits": with_tables(_split_cte(), "cells"),
    "sampled_lines": f"""WITH {_BOX}, r AS (SELECT *, sqrt(w * w + h * h) / 2 AS r FROM b), l AS (SELECT *, unnest(range(-ceil(r / 41)::BIGINT, ceil(r / 41)::BIGINT + 1))::INTEGER AS line FROM r), k AS (SELECT area, line, w, h, r * (2 * unnest(range(65)) / 64::DOUBLE - 1) AS a FROM l)
        SELECT area, line, round(min(a), 4) AS lo, round(max(a), 4) AS hi FROM k WHERE abs(line * 41) < w / 2 AND abs(a) < h / 2 GROUP BY area, line""",
}
