"""Queries of searches over plans, cells and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import neighbours, search, weighted
from ..sources.bindings import cells, plans, table, with_tables


def skyline(spark: SparkSession, sf: str) -> DataFrame:
    return search.skyline(plans(spark, sf), ["bucket"], "time", "quality").select("bucket", "plan", "time", F.round("quality", 2).alias("quality"))


def frontier_thinning(spark: SparkSession, sf: str) -> DataFrame:
    return search.thin(plans(spark, sf), ["bucket"], "kind", "time", "quality").select("bucket", "kind", "plan", "time", F.round("quality", 2).alias("quality"))


def best_bearing(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest of twelve headings for every region, ties to the smaller."""
    c = cells(spark, sf).select("*", F.explode(F.sequence(F.lit(0), F.lit(165), F.lit(15))).alias("heading"))
    cost = weighted.node_cost(F.col("bearing"), F.col("area") / 1000, F.col("conf"), F.col("heading").cast("double"))["quality"]
    costs = c.groupBy("region", "heading").agg(F.round(weighted.weighted_mean(cost, F.col("area")), 6).alias("cost"))
    return search.best(costs, ["region"], "cost", "heading").select("region", "heading", "cost")


def plan_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Plans of a group as regions of one."""
    p = plans(spark, sf).withColumn("area", 1.0 + F.col("plan") % 50)
    return search.roll_up(p, ["bucket", "kind"]).select("bucket", "kind", "regions", *[F.round(c, 4).alias(c) for c in ("quality", "time", "largest", "smallest")])


def quantile_split(spark: SparkSession, sf: str) -> DataFrame:
    """Regions cut at a third of their weight across a direction of 30 degrees: parts on either side."""
    c = cells(spark, sf).withColumn("along", F.round(F.col("col") * 0.5 + F.col("row") * 0.8660254037844386, 6))
    s = search.split_at(c, ["region"], "along", "area", 0.33)
    return s.groupBy("region", "left").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 3).alias("area"))


def cell_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected parts of the cells of equal size class."""
    c = cells(spark, sf).withColumn("class", F.floor((F.col("row") * 7 + F.col("col") * F.col("col") * 3) % 5 / 2))
    e = neighbours.edges(c)
    k = c.select("cell", "class")
    same = e.join(k.select(F.col("cell").alias("a"), F.col("class").alias("ca")), "a").join(k.select(F.col("cell").alias("b"), F.col("class").alias("cb")), "b").filter("ca = cb")
    found = search.components(c.select(F.col("cell").alias("node")), same)
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("cells"))


def ranked_timings(spark: SparkSession, sf: str) -> DataFrame:
    """The three longest kinds of work of every vehicle, with their shares."""
    spent = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("ms"))
    return search.ranked(spent, ["user_id"], "event_type", "ms", 3).select("user_id", "place", "event_type", "rounded", F.round("share", 6).alias("share"))


def plan_combinations(spark: SparkSession, sf: str) -> DataFrame:
    """Frontiers of both halves of each split, combined."""
    p = plans(spark, sf).withColumns({"regions": F.col("plan") % 5 + 1, "area": 1.0 + F.col("plan") % 50, "half": F.floor(F.col("plan") / 2) % 2})
    front = search.thin(p, ["bucket", "half"], "regions", "time", "quality", 2, 6)
    both = search.combined(front.filter("half = 0"), front.filter("half = 1"), ["bucket"])
    return both.select("bucket", "plan", "r_plan", "regions", "area", F.round("quality", 4).alias("quality"), "time")


QUERIES = {f.__name__: f for f in (ranked_timings, plan_combinations, skyline, frontier_thinning, best_bearing, plan_rollup, quantile_split, cell_components)}

ORACLE = {
    "ranked_timings": "WITH s AS (SELECT user_id, event_type, round(sum(value), 4) AS ms FROM events GROUP BY ALL), r AS (SELECT user_id, event_type, floor(ms + 0.5)::BIGINT AS rounded, ms / sum(ms) OVER (PARTITION BY user_id) AS share FROM s WHERE ms > 0) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rounded DESC, event_type)::INTEGER AS place, event_type, rounded, round(share, 6) AS share FROM r QUALIFY place <= 3",
    "plan_combinations": with_tables(
        """WITH p AS (SELECT *, plan % 5 + 1 AS regions, 1::DOUBLE + plan % 50 AS area, plan // 2 % 2 AS half FROM plans), r AS (SELECT *, row_number() OVER (PARTITION BY bucket, half, regions ORDER BY quality, time, plan) AS q, row_number() OVER (PARTITION BY bucket, half, regions ORDER BY time, quality, plan) AS t FROM p),
        f AS (SELECT * FROM r WHERE q <= 2 OR t = 1 QUALIFY row_number() OVER (PARTITION BY bucket, half ORDER BY quality, time, plan) <= 6)
        SELECT a.bucket, a.plan, b.plan AS r_plan, a.regions + b.regions AS regions, a.area + b.area AS area, round((a.quality * a.area + b.quality * b.area) / (a.area + b.area) + 0.02, 4) AS quality, a.time + b.time + 45::DOUBLE AS time FROM f a JOIN f b ON a.bucket = b.bucket AND a.half = 0 AND b.half = 1 AND a.regions + b.regions <= 8""",
        "plans",
    ),
    "skyline": with_tables("SELECT p.bucket, p.plan, p.time, round(p.quality, 2) AS quality FROM plans p WHERE NOT EXISTS (SELECT 1 FROM plans o WHERE o.bucket = p.bucket AND o.time <= p.time AND o.quality <= p.quality AND (o.time < p.time OR o.quality < p.quality))", "plans"),
    "frontier_thinning": with_tables(
        "WITH r AS (SELECT *, row_number() OVER (PARTITION BY bucket, kind ORDER BY quality, time, plan) AS q, row_number() OVER (PARTITION BY bucket, kind ORDER BY time, quality, plan) AS t FROM plans), s AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY quality, time, plan) AS n FROM r WHERE q <= 5 OR t = 1) SELECT bucket, kind, plan, time, round(quality, 2) AS quality FROM s WHERE n <= 20",
        "plans",
    ),
    "best_bearing": with_tables(
        """WITH h AS (SELECT region, area, conf, area / 1000 AS slope, range::INTEGER AS heading, radians(least(abs(bearing - range), 180 - abs(bearing - range))) AS d FROM cells, range(0, 180, 15)), m AS (SELECT *, pow(sin(d), 2) * (0.35 + 0.65 * conf) AS m, least(1.8, sin(d) * slope / 0.12) AS x FROM h),
        c AS (SELECT region, heading, round(sum(area * (1.35 * m + 0.35 * x + 1.05 * least(1, greatest(0, m - 0.3) * 1.8 + greatest(0, x - 1) * 0.5))) / sum(area), 6) AS cost FROM m GROUP BY ALL) SELECT DISTINCT ON (region) region, heading, cost FROM c ORDER BY region, cost, heading""",
        "cells",
    ),
    "plan_rollup": with_tables("WITH p AS (SELECT *, 1::DOUBLE + plan % 50 AS a FROM plans) SELECT bucket, kind, count(*) AS regions, round(sum(a * quality) / sum(a) + 0.02::DOUBLE * (count(*) - 1), 4) AS quality, round(sum(time) + 45::DOUBLE * (count(*) - 1), 4) AS time, round(max(a) / sum(a), 4) AS largest, round(min(a) / sum(a), 4) AS smallest FROM p GROUP BY ALL", "plans"),
    "quantile_split": with_tables(
        """WITH c AS (SELECT region, area, round(col * 0.5::DOUBLE + row * 0.8660254037844386::DOUBLE, 6) AS u FROM cells), r AS (SELECT *, sum(area) OVER (PARTITION BY region ORDER BY u) AS run, sum(area) OVER (PARTITION BY region) AS total FROM c),
        k AS (SELECT region, min(CASE WHEN run >= 0.33::DOUBLE * total THEN u END) AS cut FROM r GROUP BY region) SELECT region, u <= cut AS "left", count(*) AS n, round(sum(area), 3) AS area FROM c JOIN k USING (region) GROUP BY ALL""",
        "cells",
    ),
    "cell_components": "WITH RECURSIVE " + with_tables(
        """WITH c AS (SELECT cell, row, col, (row * 7 + col * col * 3) % 5 // 2 AS class FROM cells), e AS (SELECT a.cell AS a, b.cell AS b FROM c a JOIN c b ON a.class = b.class AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
        walk(node, root) AS (SELECT cell, cell FROM c UNION SELECT e.b, walk.root FROM walk JOIN e ON e.a = walk.node WHERE e.b > walk.root), least_root AS (SELECT node, min(root) AS component FROM walk GROUP BY node) SELECT component, count(*) AS cells FROM least_root GROUP BY component""",
        "cells",
    )[5:],
}
