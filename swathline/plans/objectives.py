"""Queries of the planner's costs and choices over regions and rings derived from the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import objectives as obj
from ..functions import scores
from ..operators import choices, weighted
from ..sources.bindings import areas, cells, poses, table, with_tables


def _figures(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    share = lambda a, b, top: (n * a % b) / b * top
    return table(spark, sf, "part").select(
        n.alias("region"), F.floor(n / 3).alias("plan"), (1500.0 + n * 37 % 9000).alias("area"), (F.col("p_retailprice") / 1000).alias("quality"), (0.15 + share(17, 89, 0.85)).alias("convexity"), (1 + share(31, 97, 7.0)).alias("compactness"), share(13, 83, 0.4).alias("fragment_share"), (n % 6).alias("fragments"),
        share(11, 79, 0.6).alias("transit"), (60.0 + n * 7 % 400).alias("along"), (30.0 + n * 3 % 140).alias("across"), (200.0 + n % 700).alias("perimeter"), (8.0 + n % 31).alias("spacing"), (n * 5 % 240).cast("double").alias("gaps"), (100.0 + n % 999).alias("seconds"), (n % 23).alias("lines"), (n % 5).alias("short_lines"), (15.0 + n * 11 % 300).alias("median"),
        share(19, 101, 1.0).alias("r2"), share(23, 61, 14.0).alias("rmse"), (n % 40).alias("samples"),
    )


_F = """WITH f AS (SELECT p_partkey AS region, p_partkey // 3 AS plan, 1500::DOUBLE + p_partkey * 37 % 9000 AS area, p_retailprice / 1000 AS quality, 0.15::DOUBLE + (p_partkey * 17 % 89) / 89::DOUBLE * 0.85 AS convexity, 1::DOUBLE + (p_partkey * 31 % 97) / 97::DOUBLE * 7 AS compactness, (p_partkey * 13 % 83) / 83::DOUBLE * 0.4 AS fragment_share, (p_partkey % 6)::DOUBLE AS fragments,
(p_partkey * 11 % 79) / 79::DOUBLE * 0.6 AS transit, 60::DOUBLE + p_partkey * 7 % 400 AS along, 30::DOUBLE + p_partkey * 3 % 140 AS across, 200::DOUBLE + p_partkey % 700 AS perimeter, 8::DOUBLE + p_partkey % 31 AS spacing, (p_partkey * 5 % 240)::DOUBLE AS gaps, 100::DOUBLE + p_partkey % 999 AS seconds, (p_partkey % 23)::DOUBLE AS lines, (p_partkey % 5)::DOUBLE AS short_lines, 15::DOUBLE + p_partkey * 11 % 300 AS median,
(p_partkey * 19 % 101) / 101::DOUBLE AS r2, (p_partkey * 23 % 61) / 61::DOUBLE * 14 AS rmse, p_partkey % 40 AS samples FROM part),
g AS (SELECT *, greatest(along, across) / greatest(1, least(along, across)) AS aspect, greatest(45, 2.5 * spacing) AS wanted,
 CASE WHEN samples < 10 THEN 'poor' WHEN r2 > 0.95 AND rmse < 2 THEN 'excellent' WHEN r2 > 0.85 AND rmse < 5 THEN 'good' WHEN r2 > 0.7 AND rmse < 10 THEN 'fair' ELSE 'poor' END AS grade FROM f),
h AS (SELECT *, 2.5 * greatest(0, wanted - across) / wanted + 0.25 * greatest(0, aspect - 10) + 4 * greatest(0, 0.38 - convexity) + 0.18 * greatest(0, perimeter * perimeter / (4 * pi() * greatest(1, area)) - 3) + 0.65 * least(2.5, fragment_share * 3.2 + fragments / 8)
 + 0.9 * least(3, gaps / greatest(1, perimeter * 0.55, spacing * 8)) + 0.75 * least(2.5, transit * 5.5) + 2 * greatest(0, 4000 - area) / 4000 AS penalty, area < 2000 OR convexity < 0.19 OR (convexity < 0.58 AND transit > 0.18) AS invalid FROM g)"""


def _shape(f: DataFrame) -> DataFrame:
    r = obj.regularization(*[F.col(c) for c in ("area", "along", "across", "convexity", "perimeter", "spacing", "fragments", "fragment_share", "gaps", "transit")])
    return f.withColumn("shape", r).select("*", "shape.*").drop("shape")


def orientation_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Penalty and cost of every region, and its place among its plan's orientations."""
    f = _shape(_figures(spark, sf)).withColumn("cost", F.round(obj.orientation_cost(F.col("quality"), F.col("seconds"), F.col("penalty"), F.col("invalid")), 6))
    return choices.ranked_orientations(f, ["plan"], "region", "cost").select("plan", "region", F.round("penalty", 6).alias("penalty"), "invalid", "cost", "place")


def partition_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Partitions from their regions, and whether they are practical."""
    f = _shape(_figures(spark, sf))
    c = obj.partition_cost(F.col("quality"), F.col("seconds"), F.col("penalty"), F.col("area"))
    fine = obj.practical_region(F.col("area"), F.col("convexity"), F.col("compactness"), F.col("invalid"))
    n = F.count(F.lit(1))
    return f.groupBy("plan").agg(n.alias("regions"), *[F.round(v, 5).alias(k) for k, v in c.items()], ((n > 1) & F.bool_and(fine)).alias("practical"))


def fit_grades(spark: SparkSession, sf: str) -> DataFrame:
    return _figures(spark, sf).select("region", obj.fit_grade(F.col("r2"), F.col("rmse"), F.col("samples")).alias("grade"))


def face_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Faces of terrain, in the usual and the forced way."""
    f = _figures(spark, sf).withColumn("grade", obj.fit_grade(F.col("r2"), F.col("rmse"), F.col("samples")))
    args = [F.col(c) for c in ("area", "along", "across", "convexity", "grade", "r2", "rmse", "spacing", "lines", "short_lines", "median", "fragments")]
    return f.select("region", F.round(obj.face_score(*args), 6).alias("score"), F.round(obj.face_score(*args, forced=True), 6).alias("forced"))


def fallback_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Of every plan the gates its regions fail, hard and soft, and the six best plans of each thousand that fail none of the hard ones."""
    r = _figures(spark, sf).withColumns({"short": F.col("fragment_share"), "fragments": F.col("fragment_share"), "mean_line": F.col("median")})
    r = r.withColumn("margins", scores.gate_margins(9000.0, True))
    hard, soft = obj.hard_and_soft(F.col("margins"), F.col("mean_line"))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
    r = r.withColumns({"hard": F.size(hard), "soft": total(soft), "soft_most": F.coalesce(F.array_max(F.map_values(soft)), F.lit(0.0))})
    plans = r.groupBy("plan").agg(F.sum("hard").alias("hard"), F.sum("soft").alias("soft_total"), F.max("soft_most").alias("soft_most"), F.avg("quality").alias("quality"), F.sum("seconds").alias("seconds"))
    plans = plans.withColumn("score", F.round(obj.fallback_score(F.col("quality"), F.col("seconds"), F.lit(1.2), F.lit(900.0), F.col("soft_total"), F.col("soft_most")), 5))
    plans = plans.withColumn("family", F.floor(F.col("plan") / 100))
    return choices.fallbacks(plans.filter("hard <= 2"), ["family"], "plan", most=6).select("family", "place", "plan", "hard", F.round("soft_total", 4).alias("soft_total"), "score")


def score_breakdowns(spark: SparkSession, sf: str) -> DataFrame:
    """Partitions scored for either sensor: their worst region, the whole, time against the fastest, and the number of regions."""
    f = _figures(spark, sf).withColumns({"hole": F.col("fragment_share"), "low": F.col("transit"), "q10": F.col("r2"), "mean": F.col("convexity"), "q90": F.col("rmse"), "gsd": F.col("compactness"), "most": F.col("gaps") / 10})
    p = f.groupBy("plan").agg(*[F.max(c).alias(f"w_{c}") for c in ("hole", "low", "q10", "mean", "q90", "gsd", "most")], *[F.avg(c).alias(c) for c in ("hole", "low", "q10", "mean", "q90", "gsd", "most")], F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("n"))
    time, extra = obj.time_penalty(F.col("seconds"), F.lit(800.0)), (F.col("n") - 1).cast("double")
    signals = lambda **k: F.create_map(*[x for n, c in k.items() for x in (F.lit(n), F.col(c) if isinstance(c, str) else c)])
    lidar = obj.breakdown(signals(worst_hole="w_hole", worst_low="w_low", worst_q10="w_q10", worst_mean="w_mean", hole="hole", low="low", q10="q10", q25="q10", mean="mean", time=time, regions=extra), obj.LIDAR_WEIGHTS)
    camera = obj.breakdown(signals(worst_q90="w_q90", worst_mean="w_gsd", worst_max="w_most", q90="q90", q75="q90", mean="gsd", max="most", time=time, regions=extra), obj.CAMERA_WEIGHTS)
    return p.select("plan", F.round(lidar["total"], 5).alias("lidar"), F.round(camera["total"], 5).alias("camera"), F.round(lidar["parts"]["worst_hole"], 6).alias("worst_hole"))


def exact_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The best plan of each family by exact score; a later one has to be better by a nanounit."""
    f = _figures(spark, sf).withColumns({"family": F.floor(F.col("region") / 50), "score": F.round(F.col("quality") + F.col("transit"), 3)})
    return choices.best_by(f, ["family"], "region", "score").select("family", "region", "score")


def guidance_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted quality of every region at 30 degrees, for both kinds of sensor, from its cells and the lift of its lines."""
    c = cells(spark, sf).withColumns({"x": F.col("col") * 100.0, "y": F.col("row") * 100.0})
    q = choices.guidance_quality(c, ["region"], heading=30.0, spacing=137.0, altitude=110.0, relief=(12.0, 30.0, 55.0), short=0.1)
    return q.select("region", *[F.round(n, 5).alias(n) for n in ("mismatch", "p90_mismatch", "camera", "lidar", "holes")])


def region_node_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Cost of every region at 60 degrees from its cells, the planner's variant."""
    q = choices.region_node_cost(cells(spark, sf).withColumn("slope", F.col("area") / 1000), ["region"], heading=60.0, altitude=150.0)
    return q.select("region", *[F.round(n, 5).alias(n) for n in ("camera", "camera_low", "lidar", "lidar_holes", "lidar_low")])


def ring_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Zoom, width and spacing of every area, and the convexity of a bent ring about its centre."""
    a = areas(spark, sf)
    width = obj.width_across(F.col("ring"), 30.0)
    r, dent = F.col("half") * 100000, F.col("area_id") % 9 / 10
    corner = lambda x, y: F.struct((x * r).alias("x"), (y * r).alias("y"))
    bent = F.array(corner(F.lit(-1.0), F.lit(-1.0)), corner(F.lit(0.0), -1 + dent), corner(F.lit(1.0), F.lit(-1.0)), corner(F.lit(1.0), F.lit(1.0)), corner(F.lit(-1.0), F.lit(1.0)))
    from ..functions.geo import ring_area

    return a.select("area_id", obj.zoom_for_ring(F.col("ring")).alias("zoom"), F.round(width, 3).alias("width"), F.round(obj.spacing_for_width(width), 3).alias("spacing"), F.round(ring_area(bent) / obj.hull_area(bent), 6).alias("convexity"))


def ray_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Where a ray from every pose is within a box, and the pixel under it."""
    x, y, t = F.col("event_id") % 700 - 100.0, F.col("user_id") * 3 % 700 - 100.0, F.radians((F.col("event_id") % 24) * 15.0)
    dx, dy = F.round(F.sin(t), 12), F.round(F.cos(t), 12)
    enter, leave = obj.box_entry(x, y, dx, dy, (0.0, 0.0, 512.0, 512.0), 300.0)
    at = obj.pixel_index(64, x, y, F.lit(0.0), F.lit(512.0), 8.0)
    return poses(spark, sf).select("event_id", F.round(enter, 6).alias("enter"), F.round(leave, 6).alias("leave"), at["index"].alias("pixel"))


def run_plans(spark: SparkSession, sf: str) -> DataFrame:
    n, u = F.col("event_id"), F.col("user_id")
    flag = lambda k: F.floor(n / k) % 2 == 0
    p = obj.run_plan(u % 11 == 0, flag(1), n % 3, flag(2), flag(4), flag(8), u % 2 == 0, n % 5 - 1, n % 18, F.when(u % 3 == 0, "spacing").when(u % 3 == 1, "manual"))
    return table(spark, sf, "events").select(n.alias("event_id"), p.alias("p")).select("event_id", "p.*")


def cut_bonus(spark: SparkSession, sf: str) -> DataFrame:
    """How much a cut through the middle of every region at 20 degrees follows a break of the terrain."""
    c = cells(spark, sf).select("region", (F.col("col") * 100.0).alias("x"), (F.col("row") * 100.0).alias("y"), (F.col("area") / 500).alias("slope"), (F.col("conf") * 30).alias("strength"), "bearing")
    return choices.cut_bonus(c, ["region"], cut=20.0, offset=150.0, step=100.0).select("region", F.round("bonus", 6).alias("bonus"))


def coverage_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each area's cells that its regions cover, and that they cover more than once; and whether that is viable."""
    c = cells(spark, sf)
    claims = c.select("region", F.explode(F.array(F.col("cell"), F.col("cell") + 3, F.col("cell") + F.col("row") % 4)).alias("cell")).distinct().withColumn("area", F.col("cell") % 7).filter("cell % 5 <> 0")
    parents = c.select((F.col("cell") % 7).alias("area"), "cell")
    return choices.coverage(parents, claims, ["area"], "cell").select("area", F.round("covered", 6).alias("covered"), F.round("overlap", 6).alias("overlap"), "viable")


def request_problems(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with requests, and the defaults of the others."""
    from ..functions.requests import validated

    n = F.col("p_partkey")
    pick = lambda k, *names: F.get(F.array(*[F.lit(x) for x in names]), (n % k).cast("int"))
    corner = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    r = table(spark, sf, "part").select(n.alias("request"), F.array_repeat(corner, (n % 5).cast("int")).alias("ring"), pick(4, "camera", "lidar", "radar", None).alias("payload"), (n % 9 - 1).cast("double").alias("altitude"), pick(6, 70.0, None, 96.0, 0.0, -1.0, 95.0).alias("front"), pick(2, None, 30.0).alias("side"), (n % 7 - 1).cast("double").alias("clearance"), pick(3, 0.5, None, 1.5).alias("tradeoff"), pick(5, "legacy", "min-clearance", None, "terrain", "legacy").alias("mode"), pick(7, "blended", None, "mapbox", "blended", "lidar", None, "blended").alias("source"), pick(8, "d1", " ", None, "d2", "", "d3", "d4", None).alias("dataset"))
    return validated(r).select("request", F.array_join("problems", " ").alias("problems"), "front", "mode", "source")


def plan_names(spark: SparkSession, sf: str) -> DataFrame:
    """How many different names the plans' figures have: as many as there are different figures."""
    f = _figures(spark, sf).select((F.col("region") % 7).alias("a"), (F.col("region") % 3).alias("b"))
    return f.withColumn("name", scores.signature("a", "b")).groupBy("a", "b").agg(F.countDistinct("name").alias("names"), F.min(F.length("name")).alias("digits"))


QUERIES = {f.__name__: f for f in (orientation_costs, partition_costs, fit_grades, face_scores, fallback_plans, score_breakdowns, exact_rerank, guidance_quality, region_node_cost, ring_figures, ray_entries, run_plans, cut_bonus, coverage_ratios, request_problems, plan_names)}

_TERRAIN = "CASE grade WHEN 'excellent' THEN 0.05 WHEN 'good' THEN 0.35 WHEN 'fair' THEN 1.1 ELSE 2.4 END + least(4, rmse / 6) + least(4, 3.5 * (1 - r2))"


def _face(w: str, s: str, a: float, b: float, c: float) -> str:
    return f"""CASE WHEN area >= 4000 AND across >= {a} * {w} AND lines > 0 AND median >= {b} * {s} AND convexity >= {c} * 0.45 THEN 1.7 * ({_TERRAIN}) + 4 * short_lines / greatest(1, lines) + 4 * greatest(0, {s} - median) / {s} + 0.9 * fragments + 0.08 * greatest(0, lines - 14)
    + 6 * greatest(0, {w} - across) / {w} + 0.45 * greatest(0, aspect - 8) + 5 * greatest(0, 0.45 - convexity) END"""


_LOSS = "pow(sin(radians({d})), 2) * (0.35 + 0.65 * conf)"
_DELTA = "least(abs(bearing - {h}), 180 - abs(bearing - {h}))"
ORACLE = {
    "orientation_costs": _F + ", c AS (SELECT *, round(0.5 * quality + 0.5 * seconds / 180 + penalty + CASE WHEN invalid THEN 50 ELSE 0 END, 6) AS cost FROM h) SELECT plan, region, round(penalty, 6) AS penalty, invalid, cost, row_number() OVER (PARTITION BY plan ORDER BY cost, region)::INTEGER AS place FROM c",
    "partition_costs": _F
    + """, p AS (SELECT plan, count(*) AS n, sum(quality * area) / greatest(1, sum(area)) AS q, sum(seconds) + (count(*) - 1) * 35 AS t, sum(penalty) AS pen, bool_and(area >= 4000 AND convexity >= 0.7 AND compactness <= 5.25 AND NOT (convexity < 0.74 AND compactness > 4.25) AND NOT invalid) AS fine FROM h GROUP BY plan)
    SELECT plan, n AS regions, round(q, 5) AS quality, round(t, 5) AS seconds, round(0.5 * q + 0.5 * t / 180 + pen, 5) AS cost, n > 1 AND fine AS practical FROM p""",
    "fit_grades": _F + " SELECT region, grade FROM g",
    "face_scores": _F + f" SELECT region, round({_face('greatest(60, 3 * spacing)', 'greatest(120, 6 * spacing)', 0.75, 0.45, 0.7)}, 6) AS score, round({_face('greatest(45, 2 * spacing)', 'greatest(90, 4 * spacing)', 0.55, 0.3, 0.5)}, 6) AS forced FROM h",
    "fallback_plans": _F
    + """, m AS (SELECT *, greatest(0, least(1, 1 - 0.65 * fragment_share - 0.85 * transit - 0.45 * fragment_share)) AS capt, greatest(10, 0.4 * greatest(1, along, across)) AS need FROM f),
    s AS (SELECT *, greatest(0, need - median) AS miss, (0.14 - area / 9000 > 0)::INTEGER + (lines < 1)::INTEGER + (convexity < 0.64)::INTEGER AS hard, greatest(0, compactness - 6.25) AS s1, greatest(0, 0.22 - capt) AS s2, greatest(0, transit - 0.55) AS s3 FROM m),
    l AS (SELECT *, miss > 0 AND (miss > greatest(12, least(30, need * 0.08)) OR hard > 0 OR s1 + s2 + s3 > 0) AS late FROM s),
    k AS (SELECT *, hard + (late AND median < 20)::INTEGER AS h, s1 + s2 + s3 + CASE WHEN late AND median >= 20 THEN miss ELSE 0 END AS soft, greatest(s1, s2, s3, CASE WHEN late AND median >= 20 THEN miss ELSE 0 END) AS most FROM l),
    p AS (SELECT plan, sum(h)::BIGINT AS hard, sum(soft) AS soft, max(most) AS most, avg(quality) AS q, sum(seconds) AS t FROM k GROUP BY plan),
    z AS (SELECT plan, plan // 100 AS family, hard, soft, round(q + greatest(0, q - 1.2) + greatest(0, t - 900) / 7500 + 0.01 * soft + 0.002 * most, 5) AS score FROM p WHERE hard <= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score, plan)::INTEGER AS place FROM z) SELECT family, place, plan, hard, round(soft, 4) AS soft_total, score FROM r WHERE place <= 6""",
    "score_breakdowns": _F
    + """, p AS (SELECT plan, max(fragment_share) AS wh, max(transit) AS wl, max(r2) AS w10, max(convexity) AS wm, max(rmse) AS w90, max(compactness) AS wg, max(gaps / 10) AS wx, avg(fragment_share) AS h, avg(transit) AS l, avg(r2) AS q10, avg(convexity) AS m, avg(rmse) AS q90, avg(compactness) AS g, avg(gaps / 10) AS x, greatest(0, sum(seconds) / 800 - 1) AS t, count(*) - 1 AS n FROM f GROUP BY plan)
    SELECT plan, round(4.8 * wh + 2.9 * wl + 2.1 * w10 + 0.9 * wm + 4.2 * h + 2.4 * l + 1.9 * q10 + 1.2 * q10 + 0.8 * m + 0.18 * t + 0.035 * n, 5) AS lidar, round(2.6 * w90 + 2 * wg + 1.2 * wx + q90 + 0.7 * q90 + 0.4 * g + 0.25 * x + 0.35 * t + 0.12 * n, 5) AS camera, round(4.8 * wh, 6) AS worst_hole FROM p""",
    "exact_rerank": _F + ", s AS (SELECT region // 50 AS family, region, round(quality + transit, 3) AS score FROM f) SELECT family, min_by(region, (score, region)) AS region, min(score) AS score FROM s GROUP BY family",
    "guidance_quality": with_tables(
        """WITH m AS (SELECT region, sum(area * col * 100) / sum(area) AS cx, sum(area * row * 100) / sum(area) AS cy FROM cells GROUP BY region),
        l AS (SELECT c.*, round_even(((col * 100 - cx) * sin(radians(120)) + (row * 100 - cy) * cos(radians(120))) / 137, 0) AS line FROM cells c JOIN m USING (region)),
        t AS (SELECT *, greatest(0, max(z) OVER (PARTITION BY region, line) - z) AS lift, greatest(1e-6, area * (0.35 + 0.65 * conf)) AS lw, greatest(1e-6, area * (0.25 + 0.75 * conf)) AS w, """ + _DELTA.format(h=30) + """ AS d FROM l),
        t2 AS (SELECT *, """ + _LOSS.format(d="d") + """ AS loss FROM t),
        u AS (SELECT *, sum(lw) OVER (PARTITION BY region ORDER BY lift) AS lrun, sum(lw) OVER (PARTITION BY region) AS lall, sum(w) OVER (PARTITION BY region ORDER BY d) AS drun, sum(w) OVER (PARTITION BY region ORDER BY loss) AS srun, sum(w) OVER (PARTITION BY region) AS wall FROM t2),
        a AS (SELECT region, sum(d * w) / sum(w) AS mis, min(CASE WHEN drun >= 0.9::DOUBLE * wall THEN d END) AS p90, sum(loss * w) / sum(w) AS ml, min(CASE WHEN srun >= 0.9::DOUBLE * wall THEN loss END) AS pl, sum(CASE WHEN loss > 0.35 THEN area ELSE 0 END) / greatest(1, sum(area)) AS bu, sum(CASE WHEN 1 - 1.9 * loss - 0.75 * 0.5 < 0.1 THEN area ELSE 0 END) / greatest(1, sum(area)) AS bh,
          sum(lift * lw) / sum(lw) / 110 AS mll, min(CASE WHEN lrun >= 0.9::DOUBLE * lall THEN lift END) / 110 AS pll, max(lift) AS xl, sum(CASE WHEN lift >= 13.2 THEN area ELSE 0 END) / sum(area) AS el, sum(CASE WHEN lift >= 30.8 THEN area ELSE 0 END) / sum(area) AS sv FROM u GROUP BY region),
        b AS (SELECT *, greatest(0, sqrt(pow(110 + pll * 110, 2) + pow(110 * tan(radians(45)), 2)) / 200 - 1) AS po, greatest(0, sqrt(pow(110 + xl, 2) + pow(110 * tan(radians(45)), 2)) / 200 - 1) AS xo, greatest(0, least(1, bu + 0.45 * el + 0.85 * sv)) AS cu, greatest(0, least(1, greatest(bu, bu * 0.75 + el * 0.85))) AS lu,
          greatest(0, least(1.25, 1 - 1.15 * ml - 0.45 * 12 / 110)) / pow(1 + mll, 1.7) AS md, greatest(0, least(1.15, 1 - 1.65 * pl - 0.65 * 0.5)) / pow(1 + pll, 2.1) AS pd FROM a),
        k AS (SELECT *, greatest(0, least(1, bh + greatest(0, least(1, el * (0.25 + 1.2 * po) + sv * (0.8 + 2.4 * xo))))) AS holes FROM b)
        SELECT region, round(mis, 5) AS mismatch, round(p90, 5) AS p90_mismatch, round(0.9 * (1.5 * ml + 0.55 * 12 / 110 + 0.95 * mll) + 1.7 * (2.1 * pl + 0.85 * 30 / 110 + 1.35 * pll) + 1.2 * cu + 0.35 * el + 0.9 * sv + 0.04, 5) AS camera,
        round(0.85 * greatest(0, 1 - md) + 1.95 * greatest(0, 1 - pd) + 1.65 * holes + 1.05 * lu + 0.5 * el + 1.15 * sv, 5) AS lidar, round(holes, 5) AS holes FROM k""",
        "cells",
    ),
    "region_node_cost": with_tables(
        "WITH d AS (SELECT region, conf, greatest(1e-6, area * (0.25 + 0.75 * conf)) AS w, area / 1000 AS slope, " + _DELTA.format(h=60) + " AS d FROM cells), l AS (SELECT *, " + _LOSS.format(d="d") + """ AS loss, greatest(0, least(1.8, sin(radians(d)) * slope / 0.12)) AS steep FROM d),
        o AS (SELECT *, steep * (0.55 + 0.45 * conf) AS lift, greatest(0, sqrt(pow(150 * (1 + 0.65 * steep * (0.55 + 0.45 * conf)), 2) + pow(150 * tan(radians(45)), 2)) / 200 - 1) AS o FROM l),
        r AS (SELECT *, greatest(0, least(1, 2.8 * o + greatest(0, loss + 0.45 * lift - 1.02))) AS holes, greatest(0, least(1.15, 1 - 1.05 * loss - 0.42 * lift - 1.6 * o)) AS dense FROM o),
        u AS (SELECT *, sum(w) OVER (PARTITION BY region ORDER BY loss) AS lrun, sum(w) OVER (PARTITION BY region ORDER BY dense) AS drun, sum(w) OVER (PARTITION BY region) AS wall FROM r),
        a AS (SELECT region, sum(loss * w) / sum(w) AS ml, min(CASE WHEN lrun >= 0.9::DOUBLE * wall THEN loss END) AS pl, sum(steep * w) / sum(w) AS ms, sum(CASE WHEN loss > 0.32 OR steep > 1.1 THEN w ELSE 0 END) / sum(w) AS cu, sum(dense * w) / sum(w) AS md, min(CASE WHEN drun >= 0.1::DOUBLE * wall THEN dense END) AS qd, sum(holes * w) / sum(w) AS h, sum(CASE WHEN dense < 0.7 OR holes > 0.35 THEN w ELSE 0 END) / sum(w) AS lo FROM u GROUP BY region)
        SELECT region, round(greatest(0, 1.35 * ml + 0.35 * ms) + 1.35 * greatest(0, 1.85 * pl + 0.55 * ms) + 1.05 * cu + 0.3 * ml, 5) AS camera, round(cu, 5) AS camera_low, round(0.85 * greatest(0, 1 - md) + 1.95 * greatest(0, 1 - qd) + 4.1 * h + 2.15 * lo + 0.35 * ml, 5) AS lidar, round(h, 5) AS lidar_holes, round(lo, 5) AS lidar_low FROM a""",
        "cells",
    ),
    "ring_figures": with_tables(
        """WITH p AS (SELECT area_id, half, lng, lat, lng + dx * half AS x, lat + dy * half AS y FROM areas, (VALUES (-1, -1), (1, -1), (1, 1), (-1, 1)) t(dx, dy)),
        v AS (SELECT *, radians(x - lng) AS dl, radians(y) AS f2, radians(lat) AS f1 FROM p), o AS (SELECT *, pow(sin((f2 - f1) / 2), 2) + cos(f1) * cos(f2) * pow(sin(dl / 2), 2) AS h, degrees(atan2(sin(dl) * cos(f2), cos(f1) * sin(f2) - sin(f1) * cos(f2) * cos(dl))) AS b FROM v),
        w AS (SELECT area_id, any_value(half) AS half, any_value(lat) AS lat, max(2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)) * cos(radians(b - 120))) - min(2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)) * cos(radians(b - 120))) AS width FROM o GROUP BY area_id),
        a AS (SELECT *, radians(2 * half) * 2 * (sin(radians(lat + half)) - sin(radians(lat - half))) * 6371000::DOUBLE * 6371000 / 2 AS area, CASE WHEN width < 200 THEN 25 WHEN width < 500 THEN 50 WHEN width < 1000 THEN 100 WHEN width < 2000 THEN 150 ELSE 200 END AS step FROM w)
        SELECT area_id, CASE WHEN area < 1e5 THEN 15 WHEN area < 1e6 THEN 14 WHEN area < 1e7 THEN 13 ELSE 12 END AS zoom, round(width, 3) AS width, round(CASE WHEN ceil(width / step) < 3 THEN width / 3 WHEN ceil(width / step) > 20 THEN width / 20 ELSE step END, 3) AS spacing, round((4 - (area_id % 9) / 10::DOUBLE) / 4, 6) AS convexity FROM a""",
        "areas",
    ),
    "ray_entries": with_tables(
        """WITH r AS (SELECT event_id, event_id % 700 - 100::DOUBLE AS x, user_id * 3 % 700 - 100::DOUBLE AS y, round(sin(radians((event_id % 24) * 15::DOUBLE)), 12) AS dx, round(cos(radians((event_id % 24) * 15::DOUBLE)), 12) AS dy FROM poses),
        t AS (SELECT *, CASE WHEN abs(dx) < 1e-9 THEN CASE WHEN x BETWEEN 0 AND 512 THEN 0 ELSE 1e9 END ELSE least(-x / dx, (512 - x) / dx) END AS x0, CASE WHEN abs(dx) < 1e-9 THEN 1e9 ELSE greatest(-x / dx, (512 - x) / dx) END AS x1, CASE WHEN abs(dy) < 1e-9 THEN CASE WHEN y BETWEEN 0 AND 512 THEN 0 ELSE 1e9 END ELSE least(-y / dy, (512 - y) / dy) END AS y0, CASE WHEN abs(dy) < 1e-9 THEN 1e9 ELSE greatest(-y / dy, (512 - y) / dy) END AS y1 FROM r),
        e AS (SELECT *, greatest(0, x0, y0) AS a, least(300, x1, y1) AS b FROM t)
        SELECT event_id, round(CASE WHEN b >= a THEN a END, 6) AS enter, round(CASE WHEN b >= a THEN b END, 6) AS leave, CASE WHEN x >= 0 AND x < 512 AND y > 0 AND y <= 512 THEN floor((512 - y) / 8)::BIGINT * 64 + floor(x / 8)::BIGINT END AS pixel FROM e""",
        "poses",
    ),
    "run_plans": """WITH e AS (SELECT event_id, user_id % 11 = 0 AS wait, event_id % 2 = 0 AS auto, event_id % 3 AS imported, event_id // 2 % 2 = 0 AS ready, event_id // 4 % 2 = 0 AS polys, event_id // 8 % 2 = 0 AS lines, user_id % 2 = 0 AS lidar, event_id % 5 - 1 AS poses, event_id % 18 AS n, user_id % 3 = 0 AS whole FROM events),
        s AS (SELECT *, CASE WHEN wait THEN 'hold' WHEN NOT auto AND imported > 0 THEN CASE WHEN ready THEN 'go' ELSE 'again' END WHEN NOT auto THEN 'hold' WHEN ready AND NOT polys AND imported = 0 THEN 'drop' WHEN ready AND polys AND lines THEN CASE WHEN poses = 0 AND NOT lidar THEN 'hold' ELSE 'full' END ELSE 'again' END AS s FROM e)
        SELECT event_id, CASE WHEN s IN ('go', 'full') THEN 'compute' WHEN s = 'again' AND n < 15 THEN 'retry' ELSE 'noop' END AS kind, CASE WHEN s = 'hold' THEN n WHEN s = 'again' AND n < 15 THEN n + 1 ELSE 0 END AS retries, s = 'full' AND whole AS whole FROM s""",
    "cut_bonus": with_tables(
        """WITH m AS (SELECT region, avg(col * 100) AS cx, avg(row * 100) AS cy FROM cells GROUP BY region), s AS (SELECT c.region, (col * 100 - cx) * sin(radians(110)) + (row * 100 - cy) * cos(radians(110)) - 150 AS d, area / 500 AS slope, conf * 30 AS st, bearing FROM cells c JOIN m USING (region)),
        w AS (SELECT *, 1 - abs(d) / 240 AS p, (1 - abs(d) / 240) * greatest(0.05, slope) * greatest(0.1, st / 12) AS w FROM s WHERE abs(d) <= 240),
        g AS (SELECT region, count(*) FILTER (d >= 0) AS nl, count(*) FILTER (d < 0) AS nr, fmod(degrees(atan2(sum(sin(radians(2 * bearing)) * w) FILTER (d >= 0), sum(cos(radians(2 * bearing)) * w) FILTER (d >= 0))) / 2 + 180, 180::DOUBLE) AS l, fmod(degrees(atan2(sum(sin(radians(2 * bearing)) * w) FILTER (d < 0), sum(cos(radians(2 * bearing)) * w) FILTER (d < 0))) / 2 + 180, 180::DOUBLE) AS r, sum(st * p) / sum(p) AS br FROM w GROUP BY region)
        SELECT m.region, round(CASE WHEN nl >= 3 AND nr >= 3 THEN least(1, least(nl, nr) / 8::DOUBLE) * least(4, least(abs(l - r), 180 - abs(l - r)) / 18) * least(2.5, br / 10) ELSE 0 END, 6) AS bonus FROM m LEFT JOIN g USING (region)""",
        "cells",
    ),
    "plan_names": "SELECT p_partkey % 7 AS a, p_partkey % 3 AS b, 1::BIGINT AS names, 16::INTEGER AS digits FROM part GROUP BY ALL",
    "request_problems": """WITH r AS (SELECT p_partkey AS request, p_partkey % 5 AS corners, ['camera', 'lidar', 'radar', NULL][p_partkey % 4 + 1] AS payload, p_partkey % 9 - 1 AS altitude, [70::DOUBLE, NULL, 96, 0, -1, 95][p_partkey % 6 + 1] AS front, p_partkey % 7 - 1 AS clearance, [0.5::DOUBLE, NULL, 1.5][p_partkey % 3 + 1] AS tradeoff,
        ['legacy', 'min-clearance', NULL, 'terrain', 'legacy'][p_partkey % 5 + 1] AS mode, ['blended', NULL, 'mapbox', 'blended', 'lidar', NULL, 'blended'][p_partkey % 7 + 1] AS source, ['d1', ' ', NULL, 'd2', '', 'd3', 'd4', NULL][p_partkey % 8 + 1] AS dataset FROM part)
        SELECT request, concat_ws(' ', CASE WHEN corners < 3 THEN 'ring' END, CASE WHEN payload IS NULL OR payload = 'radar' THEN 'payload' END, CASE WHEN altitude <= 0 THEN 'altitude' END, CASE WHEN front > 95 OR front < 0 THEN 'front' END, CASE WHEN clearance < 0 THEN 'clearance' END, CASE WHEN tradeoff > 1 THEN 'tradeoff' END,
        CASE WHEN mode = 'terrain' THEN 'mode' END, CASE WHEN source = 'lidar' THEN 'source' END, CASE WHEN source = 'blended' AND coalesce(trim(dataset), '') = '' THEN 'dataset' END) AS problems, coalesce(front, 70) AS front, coalesce(mode, 'legacy') AS mode, coalesce(source, 'mapbox') AS source FROM r""",
    "coverage_ratios": with_tables(
        """WITH k AS (SELECT DISTINCT region, unnest([cell, cell + 3, cell + row % 4]) AS cell FROM cells), k2 AS (SELECT cell % 7 AS area, region, cell FROM k WHERE cell % 5 <> 0), p AS (SELECT cell % 7 AS area, cell FROM cells),
        n AS (SELECT area, cell, count(*) AS n FROM k2 GROUP BY ALL), s AS (SELECT area, sum(n - 1) AS over FROM n GROUP BY area), c AS (SELECT p.area, count(*) AS whole, count(n.cell) AS covered FROM p LEFT JOIN n ON n.cell = p.cell AND n.area = p.area GROUP BY p.area)
        SELECT c.area, round(covered / whole::DOUBLE, 6) AS covered, round(coalesce(over, 0) / whole::DOUBLE, 6) AS overlap, covered / whole::DOUBLE >= 0.5 AND coalesce(over, 0) / whole::DOUBLE <= 0.35 AS viable FROM c LEFT JOIN s USING (area)""",
        "cells",
    ),
}
