"""Queries of scores and gates over regions derived from the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..sources.bindings import table


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    share = lambda a, b, top: (n * a % b) / b * top
    return table(spark, sf, "part").select(
        n.alias("region"), F.floor(n / 3).alias("plan"), (1000.0 + n * 37 % 800).alias("area"), (F.col("p_retailprice") / 1000).alias("quality"), (1 + share(31, 97, 7.0)).alias("compactness"), (0.5 + share(17, 89, 0.5)).alias("convexity"),
        share(13, 83, 0.4).alias("fragments"), share(11, 79, 0.6).alias("transit"), share(7, 73, 0.5).alias("short"), (n % 9).alias("lines"), (20 + share(5, 71, 90.0)).alias("mean_line"), (60.0 + n % 120).alias("along"), (50.0 + n % 140).alias("across"), (400.0 + n % 999).alias("seconds"),
    )


def region_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _regions(spark, sf).select("region", F.round(scores.region_score(), 6).alias("score"), F.round(scores.capture(), 6).alias("capture"), F.round(scores.exact_cost(F.col("quality"), F.col("seconds")), 6).alias("cost"))


def region_gates(spark: SparkSession, sf: str) -> DataFrame:
    """What every region fails by, under both kinds of gates."""
    r = _regions(spark, sf).select("region", scores.gate_margins(5000.0, False).alias("basic"), scores.gate_margins(5000.0, True).alias("practical"))
    total = lambda m: F.round(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x), 5)
    return r.select("region", F.size("basic").alias("basic_failures"), total("basic").alias("basic_margin"), F.size("practical").alias("practical_failures"), total("practical").alias("practical_margin"))


def plan_gates(spark: SparkSession, sf: str) -> DataFrame:
    return scores.plan_gates(_regions(spark, sf), ["plan"]).select("plan", "regions", *[F.round(c, 5).alias(c) for c in ("largest", "smallest", "convexity")], "passes")


QUERIES = {f.__name__: f for f in (region_scores, region_gates, plan_gates)}

_R = """WITH r AS (SELECT p_partkey AS region, p_partkey // 3 AS plan, 1000::DOUBLE + p_partkey * 37 % 800 AS area, p_retailprice / 1000 AS quality, 1 + (p_partkey * 31 % 97) / 97::DOUBLE * 7 AS comp, 0.5::DOUBLE + (p_partkey * 17 % 89) / 89::DOUBLE * 0.5 AS conv,
(p_partkey * 13 % 83) / 83::DOUBLE * 0.4 AS frag, (p_partkey * 11 % 79) / 79::DOUBLE * 0.6 AS transit, (p_partkey * 7 % 73) / 73::DOUBLE * 0.5 AS short, (p_partkey % 9)::DOUBLE AS lines, 20 + (p_partkey * 5 % 71) / 71::DOUBLE * 90 AS mean_line,
greatest(1, 60 + p_partkey % 120, 50 + p_partkey % 140)::DOUBLE AS span, 400::DOUBLE + p_partkey % 999 AS seconds FROM part), c AS (SELECT *, greatest(0, least(1, 1 - 0.65 * frag - 0.85 * transit - 0.45 * short)) AS capt FROM r)"""


def _gate(k: int, whole: str) -> str:
    m = [f"{scores.LEAST_CHILD} - area / {whole}", "1 - lines", f"{scores.CONVEXITY[k]} - conv", f"comp - {scores.COMPACTNESS[k]}", f"{scores.CAPTURE[k]} - capt"] + ([f"transit - {scores.TRANSIT[k]}"] if k else [])
    count, total = " + ".join(f"({x} > 0)::INTEGER" for x in m), " + ".join(f"greatest(0::DOUBLE, {x})" for x in m)
    least = f"greatest({scores.LINE_FLOOR[k]}, {scores.SCALE[k]} * span)"
    miss = f"greatest(0::DOUBLE, {least} - mean_line)"
    late = f"{miss} > 0 AND ({miss} > greatest(12, least(30, {least} * {scores.NEAR_MISS[k]})) OR ({count}) > 0)"
    return f"({count}) + ({late})::INTEGER AS n{k}, ({total}) + CASE WHEN {late} THEN {miss} ELSE 0 END AS m{k}"


ORACLE = {
    "region_scores": _R + " SELECT region, round(quality + 0.06 * greatest(0, comp - 3.4) + 0.35 * greatest(0, 0.75 - conv) + 0.18 * frag + 0.28 * transit + 0.12 * short + seconds / 55000, 6) AS score, round(capt, 6) AS capture, round(0.9 * quality + 0.1 * seconds / 180, 6) AS cost FROM c",
    "region_gates": _R + f", g AS (SELECT region, {_gate(0, '5000::DOUBLE')}, {_gate(1, '5000::DOUBLE')} FROM c) SELECT region, n0 AS basic_failures, round(m0, 5) AS basic_margin, n1 AS practical_failures, round(m1, 5) AS practical_margin FROM g",
    "plan_gates": _R
    + f""", w AS (SELECT *, sum(area) OVER (PARTITION BY plan) AS whole FROM c), g AS (SELECT *, {_gate(1, "whole")} FROM w),
    p AS (SELECT plan, count(*) AS regions, max(area) / any_value(whole) AS largest, min(area) / any_value(whole) AS smallest, sum(area * conv) / sum(area) AS convexity, bool_and(n1 = 0) AS good FROM g GROUP BY plan)
    SELECT plan, regions, round(largest, 5) AS largest, round(smallest, 5) AS smallest, round(convexity, 5) AS convexity, regions > 1 AND 1 - largest >= 0.22 AND smallest >= 0.14 AND convexity >= 0.65 AND (regions <> 2 OR largest <= 0.88) AND good AS passes FROM p""",
}
