"""Queries of aggregating operators over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angles, sensors
from ..operators import histograms as hist
from ..operators import weighted
from ..sources.bindings import cells, points, poses, rounded, table, with_tables

CELL = 25.0


def _r(*names: str, places: int = 4) -> list:
    return [F.round(n, places).alias(n) for n in names]


def density_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Points a square metre by cell of 25 m, over each class: cells, extrema, mean and 90th percentile."""
    grid = points(spark, sf).groupBy("class", F.floor(F.col("x") / CELL).alias("cx"), F.floor(F.col("y") / CELL).alias("cy")).agg((F.count(F.lit(1)) / (CELL * CELL)).alias("density"))
    figures = grid.groupBy("class").agg(F.count(F.lit(1)).alias("cells"), F.min("density").alias("least"), F.max("density").alias("most"), F.avg("density").alias("mean"), F.percentile("density", 0.9).alias("p90"))
    return figures.select("class", "cells", *_r("least", "most", "mean", "p90", places=6))


def weighted_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted mean and quantiles of distances by class."""
    p = points(spark, sf)
    means = p.groupBy("class").agg(weighted.weighted_mean(F.col("x"), F.col("w")).alias("mean"))
    quantiles = weighted.weighted_quantiles(p, ["class"], "x", "w", {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return means.join(quantiles, "class").select("class", *_r("mean", "q10", "q50", "q90"))


def circular_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Mean axis and direction, dispersion, median and principal axis of cells by region."""
    c = cells(spark, sf).withColumn("heading", F.pmod(F.col("z") * 13, F.lit(360.0)))
    figures = c.groupBy("region").agg(angles.axial_mean(F.col("bearing"), F.col("area")).alias("axis"), angles.circular_mean(F.col("heading"), F.col("area")).alias("direction"), angles.circular_dispersion(F.col("heading")).alias("dispersion"),
                                      weighted.principal_axis(F.col("col") * 1.0, F.col("row") * 1.0, F.col("area")).alias("spread"))
    return figures.select("region", *_r("axis", "direction", "dispersion", "spread"))


def circular_medians(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).withColumn("heading", F.round(F.pmod(F.col("z") * 13, F.lit(360.0)), 3))
    return c.groupBy("row").agg(F.round(angles.circular_median(F.collect_list("heading")), 3).alias("median"))


def heading_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence by 15-degree bin of bearings and whether a bin is a peak around the half circle."""
    bins = cells(spark, sf).groupBy((F.floor(F.col("bearing") / 15) % 12).cast("int").alias("bin")).agg(F.sum(F.greatest(F.lit(1e-6), F.col("conf"))).alias("weight"))
    all_bins = spark.range(12).select(F.col("id").cast("int").alias("bin")).join(bins, "bin", "left").select("bin", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    laid = all_bins.agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "weight"))), lambda b: b["weight"]).alias("w"))  # twelve rows
    around = lambda k: F.get(F.col("w"), F.pmod(F.col("bin") + k, F.lit(12)))
    rows = laid.select("w", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("bin"))
    peak = (around(0) >= around(-1)) & (around(0) >= around(1)) & (around(0) > 0)
    return rows.select("bin", F.round(around(0), 4).alias("weight"), peak.alias("peak"), (F.col("bin") * 15.0 + 7.5).alias("angle"))


def _stats(spark: SparkSession, sf: str, density: bool) -> DataFrame:
    p = points(spark, sf).withColumn("tile", F.floor(F.col("y") / 100)).withColumn("value", F.col("d") * 100 * F.col("x") if density else F.col("x") / 1000 + F.col("d"))
    return hist.value_stats(p.withColumn("area", F.col("w") * 0.0137), ["class", "tile"], "value", "area", density)


def _flat(stats: DataFrame, *keys: str) -> DataFrame:
    cells = F.transform("histogram", lambda b: F.concat_ws(":", rounded(b["bin"], 3).cast("decimal(20,3)").cast("string"), b["count"].cast("string"), rounded(b["area"], 2).cast("decimal(20,2)").cast("string")))
    return stats.select(*keys, *[rounded(F.col(n), 3).alias(n) for n in ("min", "max", "mean", "area")], "count", F.array_join(cells, " ").alias("histogram"))


def resolution_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_stats(spark, sf, False), "class", "tile")


def density_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_stats(spark, sf, True), "class", "tile")


def histogram_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of a class as one, with its scores for both kinds of sensor."""
    return _flat(hist.merge_stats(_stats(spark, sf, True), ["class"]), "class")


def histogram_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = _stats(spark, sf, False).withColumn("edges", hist.bin_edges(F.col("histogram"), F.col("min"), F.col("max")))
    area, edges, target = hist.total_area(F.col("area"), F.col("histogram")), F.col("edges"), F.lit(1.5)
    lidar, camera = hist.lidar_score(F.lit(8.0), edges, area, F.col("mean")), hist.camera_score(target, edges, area, F.col("mean"), F.col("max"))
    return s.select("class", "tile", F.round(hist.area_below(edges, target), 3).alias("below"), F.round(hist.quantile(edges, area, 0.1), 4).alias("q10"), F.round(hist.quantile(edges, area, 0.9), 4).alias("q90"), F.round(lidar["total"], 4).alias("lidar"), F.round(camera["total"], 4).alias("camera"))


def line_lift(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).withColumns({"x": F.col("col") * 100.0, "y": F.col("row") * 100.0})
    lifted = weighted.line_lift(c, ["region"], bearing=30.0, spacing=137.0, altitude=110.0)
    return lifted.select("region", "lines", *_r("mean_lift", "max_lift", "elevated", "severe", "p90_lift"))


def plane_fit(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).withColumns({"x": F.col("col") * 100.0, "y": (F.col("row") % 20) * 100.0})
    return weighted.plane_fit(c, ["region"]).select("region", "samples", *_r("a", "b", "r2", places=5), *_r("rmse", "contour", places=3))


def slope_features(spark: SparkSession, sf: str) -> DataFrame:
    """Gradients from neighbouring cells, one-sided at the rim; slope, aspect, bearing."""
    from ..operators.neighbours import grid_features

    return grid_features(cells(spark, sf), 100.0).select("cell", *_r("slope", "aspect", "preferred", places=5), *_r("strength", "sure", places=3))


def region_objective(spark: SparkSession, sf: str) -> DataFrame:
    """Mean cost of each region at twelve headings for both kinds of sensor: one join with the headings, one shuffle by region and heading."""
    headings = F.explode(F.sequence(F.lit(0), F.lit(165), F.lit(15))).alias("heading")
    c = cells(spark, sf).select("*", headings).withColumn("slope", F.col("area") / 1000)
    for kind in ("camera", "lidar"):
        c = c.withColumn(kind, weighted.node_cost(F.col("bearing"), F.col("slope"), F.col("conf"), F.col("heading").cast("double"), kind, altitude=150.0))
    w = F.greatest(F.lit(1e-6), F.col("area") * (0.35 + 0.65 * F.col("conf")))
    mean = lambda c: F.round(weighted.weighted_mean(F.col(c), w), 5)
    return c.groupBy("region", "heading").agg(mean("camera.quality").alias("camera"), mean("camera.low").alias("camera_low"), mean("lidar.quality").alias("lidar"), mean("lidar.holes").alias("lidar_holes"), mean("lidar.coverage").alias("lidar_coverage"))


def camera_by_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Resolution statistics by camera over the altitudes of poses."""
    c = poses(spark, sf).crossJoin(F.broadcast(sensors.cameras(spark))).withColumn("gsd", sensors.gsd(F.col("alt")) * 100)
    return c.groupBy(F.col("key").alias("camera")).agg(F.count(F.lit(1)).alias("poses"), F.round(F.min("gsd"), 5).alias("best"), F.round(F.max("gsd"), 5).alias("worst"), F.round(F.avg("gsd"), 5).alias("mean"))


def coverage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and areas by class and tile, by class, and over all."""
    p = points(spark, sf).withColumn("tile", F.floor(F.col("y") / 100))
    sums = p.rollup("class", "tile").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 2).alias("area"), F.round(F.min("x"), 3).alias("least"), F.round(F.max("x"), 3).alias("most"), F.grouping_id().alias("level"))
    return sums.withColumns({"class": F.coalesce("class", F.lit("all")), "tile": F.coalesce("tile", F.lit(-1).cast("long"))})


def downsample(spark: SparkSession, sf: str) -> DataFrame:
    """One level down of the masked raster of cells: means of the valid ones of two by two."""
    from ..operators.raster import downsample as down

    c = cells(spark, sf).select("row", "col", "z", (F.col("cell") % 7 != 0).alias("valid"))
    return down(c, 100, 20).select("row", "col", F.round("z", 5).alias("z"), "valid")


QUERIES = {f.__name__: f for f in (density_grid, weighted_figures, circular_figures, circular_medians, heading_histogram, resolution_histogram, density_histogram, histogram_merge, histogram_scores, line_lift, plane_fit, slope_features, region_objective, camera_by_payload, coverage_rollup, downsample)}


def _stat_ctes(density: bool) -> str:
    value = "d * 100 * x" if density else "x / 1000 + d"
    mean = "sum(v * a) / sum(a)" if density else "avg(v)"
    n = "CASE WHEN zeros THEN 19 ELSE 20 END" if density else "CASE WHEN (mx - least) / 20 < 0.01 THEN greatest(1, floor((mx - least) / 0.01)) ELSE 20 END"
    return f"""WITH r AS (SELECT class, floor(y / 100)::BIGINT AS tile, {value} AS v, w * 0.0137::DOUBLE AS a FROM points WHERE {"true" if density else f"{value} > 0"}),
    s AS (SELECT class, tile, min(v) AS mn, max(v) AS mx, {mean} AS mean, count(*) AS n, sum(a) AS area, min(CASE WHEN v > 0 THEN v END) AS least, bool_or(v = 0) AS zeros FROM r GROUP BY ALL),
    s2 AS (SELECT *, CASE WHEN mx > least THEN {n} ELSE 1 END AS k FROM s), s3 AS (SELECT *, CASE WHEN mx > least THEN (mx - least) / k END AS width FROM s2),
    b AS (SELECT class, tile, CASE WHEN v = 0 THEN 0 WHEN width IS NULL THEN least ELSE least + (least(floor((v - least) / width), k - 1) + 0.5) * width END AS bin, count(*) AS n, sum(a) AS a FROM r JOIN s3 USING (class, tile) GROUP BY ALL)"""


_TEXT = "string_agg(round(bin, 3)::DECIMAL(20,3) || ':' || n || ':' || round(a, 2)::DECIMAL(20,2), ' ' ORDER BY bin)"
_FLAT = f", h AS (SELECT class, tile, {_TEXT} AS histogram FROM b GROUP BY ALL) SELECT class, tile, round(mn, 3) AS min, round(mx, 3) AS max, round(mean, 3) AS mean, round(area, 3) AS area, s3.n AS count, histogram FROM s3 JOIN h USING (class, tile)"
_AXIAL = "pow(sin(radians({d})), 2)"

ORACLE = {
    "density_grid": with_tables(
        "WITH g AS (SELECT class, floor(x / 25) AS cx, floor(y / 25) AS cy, count(*) / 625::DOUBLE AS density FROM points GROUP BY ALL) SELECT class, count(*) AS cells, round(min(density), 6) AS least, round(max(density), 6) AS most, round(avg(density), 6) AS mean, round(quantile_cont(density, 0.9), 6) AS p90 FROM g GROUP BY class",
        "points",
    ),
    "weighted_figures": with_tables(
        """WITH c AS (SELECT class, x, w, sum(w) OVER (PARTITION BY class ORDER BY x) AS run, sum(w) OVER (PARTITION BY class) AS total FROM points WHERE w > 0)
        SELECT class, round(sum(x * w) / sum(w), 4) AS mean, round(min(CASE WHEN run >= 0.1::DOUBLE * total THEN x END), 4) AS q10, round(min(CASE WHEN run >= 0.5::DOUBLE * total THEN x END), 4) AS q50, round(min(CASE WHEN run >= 0.9::DOUBLE * total THEN x END), 4) AS q90 FROM c GROUP BY class""",
        "points",
    ),
    "circular_figures": with_tables(
        """WITH c AS (SELECT *, fmod(z * 13, 360::DOUBLE) AS heading FROM cells),
        m AS (SELECT region, sum(area) AS w, sum(area * col) / sum(area) AS mx, sum(area * row) / sum(area) AS my FROM c GROUP BY region),
        k AS (SELECT region, sum(area * (col - mx) * (col - mx)) AS xx, sum(area * (row - my) * (row - my)) AS yy, sum(area * (col - mx) * (row - my)) AS xy FROM c JOIN m USING (region) GROUP BY region)
        SELECT region, round(fmod(degrees(atan2(sum(sin(radians(2 * bearing)) * area), sum(cos(radians(2 * bearing)) * area))) / 2 + 180, 180::DOUBLE), 4) AS axis, round(fmod(degrees(atan2(sum(sin(radians(heading)) * area), sum(cos(radians(heading)) * area))) + 360, 360::DOUBLE), 4) AS direction,
        round(1 - sqrt(pow(avg(sin(radians(heading))), 2) + pow(avg(cos(radians(heading))), 2)), 4) AS dispersion, round(fmod(degrees(atan2(2 * any_value(xy), any_value(yy) - any_value(xx))) / 2 + 180, 180::DOUBLE), 4) AS spread FROM c JOIN k USING (region) GROUP BY region""",
        "cells",
    ),
    "circular_medians": with_tables(
        """WITH c AS (SELECT row, round(fmod(z * 13, 360::DOUBLE), 3) AS a FROM cells), o AS (SELECT row, a, row_number() OVER (PARTITION BY row ORDER BY a) - 1 AS i, count(*) OVER (PARTITION BY row) AS n FROM c),
        d AS (SELECT * FROM o UNION ALL SELECT row, a + 360, i + n, n FROM o), s AS (SELECT p.row, p.i, any_value(p.n) AS n, max(q.a) - any_value(p.a) AS span FROM o p JOIN d q ON p.row = q.row AND q.i >= p.i AND q.i < p.i + p.n AND q.a - p.a <= 180 GROUP BY ALL),
        f AS (SELECT row, arg_min(i + n // 2, span * 1000000 + i * 1e-7) AS at FROM s GROUP BY row) SELECT f.row, round(fmod(d.a, 360), 3) AS median FROM f JOIN d ON f.row = d.row AND f.at = d.i""",
        "cells",
    ),
    "heading_histogram": with_tables(
        """WITH b AS (SELECT (floor(bearing / 15)::BIGINT % 12)::INTEGER AS bin, sum(greatest(1e-6, conf)) AS w FROM cells GROUP BY 1), a AS (SELECT range::INTEGER AS bin, coalesce(w, 0) AS w FROM range(12) LEFT JOIN b ON b.bin = range)
        SELECT a.bin, round(a.w, 4) AS weight, a.w >= p.w AND a.w >= n.w AND a.w > 0 AS peak, a.bin * 15::DOUBLE + 7.5 AS angle FROM a JOIN a p ON p.bin = (a.bin + 11) % 12 JOIN a n ON n.bin = (a.bin + 1) % 12""",
        "cells",
    ),
    "resolution_histogram": with_tables(_stat_ctes(False) + _FLAT, "points"),
    "density_histogram": with_tables(_stat_ctes(True) + _FLAT, "points"),
    "histogram_merge": with_tables(
        _stat_ctes(True)
        + f""", g AS (SELECT class, tile FROM s3 WHERE mx > 0), o AS (SELECT class, coalesce(sum(CASE WHEN bin = 0 AND a > 0 THEN a END), 0) AS zero, min(CASE WHEN bin > 0 THEN bin END) AS lb FROM b JOIN g USING (class, tile) GROUP BY class),
        m AS (SELECT class, min(mn) AS mn, max(mx) AS mx, sum(mean * area) / sum(area) AS mean, sum(n)::BIGINT AS n, sum(area) AS area FROM s3 WHERE mx > 0 GROUP BY class),
        q AS (SELECT *, CASE WHEN zero > 0 AND mn = 0 THEN lb ELSE mn END AS st, CASE WHEN zero > 0 AND mn = 0 THEN 19 ELSE 20 END AS k, zero > 0 AND mn = 0 AS z FROM m JOIN o USING (class)),
        pl AS (SELECT class, CASE WHEN z AND bin = 0 THEN 0 ELSE st + (greatest(0, least(floor((bin - st) / ((mx - st) / k)), k - 1)) + 0.5) * (mx - st) / k END AS bin, sum(b.n)::BIGINT AS n, sum(a) AS a FROM b JOIN g USING (class, tile) JOIN q USING (class) GROUP BY ALL),
        c AS (SELECT *, sum(a) OVER (PARTITION BY class ORDER BY bin) AS up, sum(a) OVER (PARTITION BY class ORDER BY bin DESC) AS down, sum(a) OVER (PARTITION BY class) AS total FROM pl),
        t AS (SELECT class, min(CASE WHEN up >= 4046.8564224 THEN bin END) AS lo, max(CASE WHEN down >= 4046.8564224 THEN bin END) AS hi, any_value(total) AS total, {_TEXT} AS histogram FROM c GROUP BY class)
        SELECT class, round(CASE WHEN total > 2 * 4046.8564224 AND hi > lo THEN lo ELSE mn END, 3) AS min, round(CASE WHEN total > 2 * 4046.8564224 AND hi > lo THEN hi ELSE mx END, 3) AS max, round(mean, 3) AS mean, round(area, 3) AS area, n AS count, histogram FROM q JOIN t USING (class)""",
        "points",
    ),
    "histogram_scores": with_tables(
        _stat_ctes(False)
        + """, e0 AS (SELECT class, tile, bin, a, lag(bin) OVER w AS p, lead(bin) OVER w AS f, sum(a) OVER (PARTITION BY class, tile ORDER BY bin) AS run, row_number() OVER (PARTITION BY class, tile ORDER BY bin DESC) = 1 AS final FROM b WHERE a > 0 WINDOW w AS (PARTITION BY class, tile ORDER BY bin)),
        e AS (SELECT e0.*, mn, mx, mean, area, CASE WHEN p IS NULL AND f IS NULL THEN least(mn, bin) WHEN p IS NULL THEN bin - (f - bin) / 2 ELSE (p + bin) / 2 END AS lo, CASE WHEN p IS NULL AND f IS NULL THEN CASE WHEN greatest(mx, bin) > least(mn, bin) THEN greatest(mx, bin) ELSE least(mn, bin) + 1 END WHEN f IS NULL THEN bin + (bin - p) / 2 ELSE (f + bin) / 2 END AS hi FROM e0 JOIN s3 USING (class, tile)),
        q AS (SELECT class, tile, t.q, min_by(lo + (hi - lo) * greatest(0, least(1, (t.q * area - (run - a)) / a)), bin) AS v FROM e, (VALUES (0.1::DOUBLE), (0.25), (0.75), (0.9)) t(q) WHERE t.q * area <= run OR final GROUP BY ALL),
        ab AS (SELECT class, tile, t.x, sum(a * greatest(0, least(1, (t.x - lo) / (hi - lo)))) AS v FROM e, (VALUES (1.5::DOUBLE), (5), (5.6)) t(x) GROUP BY ALL),
        j AS (SELECT s3.class, s3.tile, mean, mx, greatest(1, area) AS whole, max(CASE WHEN q = 0.1 THEN q.v END) AS q10, max(CASE WHEN q = 0.25 THEN q.v END) AS q25, max(CASE WHEN q = 0.75 THEN q.v END) AS q75, max(CASE WHEN q = 0.9 THEN q.v END) AS q90, max(CASE WHEN x = 1.5 THEN ab.v END) AS b15, max(CASE WHEN x = 5 THEN ab.v END) AS b5, max(CASE WHEN x = 5.6 THEN ab.v END) AS b56
              FROM s3 JOIN q USING (class, tile) JOIN ab USING (class, tile) GROUP BY ALL)
        SELECT class, tile, round(b15, 3) AS below, round(q10, 4) AS q10, round(q90, 4) AS q90, round(4.2 * b5 / whole + 2.4 * b56 / whole + 1.9 * greatest(0, 1 - q10 / 8) + 1.2 * greatest(0, 1 - q25 / 8) + 0.8 * greatest(0, 1 - mean / 8), 4) AS lidar,
        round(1.85 * greatest(0, q90 / 1.5 - 1) + 1.25 * greatest(0, whole - b15) / whole + 0.95 * greatest(0, mean / 1.5 - 1) + 0.55 * greatest(0, q75 / 1.5 - 1) + 0.2 * greatest(0, mx / 1.5 - 1), 4) AS camera FROM j""",
        "points",
    ),
    "line_lift": with_tables(
        """WITH m AS (SELECT region, sum(area * col * 100) / sum(area) AS cx, sum(area * row * 100) / sum(area) AS cy FROM cells GROUP BY region),
        l AS (SELECT c.*, round_even(((col * 100 - cx) * sin(radians(120)) + (row * 100 - cy) * cos(radians(120))) / 137, 0) AS line FROM cells c JOIN m USING (region)),
        t AS (SELECT *, greatest(0, max(z) OVER (PARTITION BY region, line) - z) AS lift, greatest(1e-6, area * (0.35 + 0.65 * conf)) AS w FROM l),
        u AS (SELECT *, sum(w) OVER (PARTITION BY region ORDER BY lift) AS run, sum(w) OVER (PARTITION BY region) AS total FROM t)
        SELECT region, count(DISTINCT line) AS lines, round(sum(lift * w) / sum(w), 4) AS mean_lift, round(max(lift), 4) AS max_lift, round(sum(CASE WHEN lift >= 13.2 THEN area ELSE 0 END) / sum(area), 4) AS elevated, round(sum(CASE WHEN lift >= 30.8 THEN area ELSE 0 END) / sum(area), 4) AS severe, round(min(CASE WHEN run >= 0.9::DOUBLE * total THEN lift END), 4) AS p90_lift FROM u GROUP BY region""",
        "cells",
    ),
    "plane_fit": with_tables(
        """WITH d AS (SELECT region, col * 100 - avg(col * 100) OVER g AS x, (row % 20) * 100 - avg((row % 20) * 100) OVER g AS y, z - avg(z) OVER g AS z, count(*) OVER g AS n FROM cells WINDOW g AS (PARTITION BY region)),
        """
        + ", ".join(
            f"""f{k} AS (SELECT region, (xz * yy - xy * yz) / (xx * yy - xy * xy) AS a, (xx * yz - xy * xz) / (xx * yy - xy * xy) AS b FROM (SELECT region, sum(w*x*x) AS xx, sum(w*y*y) AS yy, sum(w*x*y) AS xy, sum(w*x*z) AS xz, sum(w*y*z) AS yz
            FROM (SELECT *, CASE WHEN abs({r}) < 5 THEN 1 ELSE 5 / abs({r}) END AS w FROM d {j}) GROUP BY region))"""
            for k, r, j in ((1, "z", ""), (2, "z - a * x - b * y", "JOIN f1 USING (region)"), (3, "z - a * x - b * y", "JOIN f2 USING (region)"))
        )
        + """ SELECT region, any_value(n) AS samples, round(any_value(a), 5) AS a, round(any_value(b), 5) AS b, round(1 - sum(pow(z - a * x - b * y, 2)) / sum(z * z), 5) AS r2, round(sqrt(avg(pow(z - a * x - b * y, 2))), 3) AS rmse, round(fmod(degrees(atan2(any_value(a), any_value(b))) + 90, 180::DOUBLE), 3) AS contour FROM d JOIN f3 USING (region) WHERE n >= 6 GROUP BY region""",
        "cells",
    ),
    "slope_features": with_tables(
        """WITH g AS (SELECT c.cell, c.row, c.col, coalesce((e.z - w.z) / 200, (e.z - c.z) / 100, (c.z - w.z) / 100) AS gx, coalesce((n.z - s.z) / 200, (n.z - c.z) / 100, (c.z - s.z) / 100) AS gy FROM cells c
          LEFT JOIN cells e ON e.row = c.row AND e.col = c.col + 1 LEFT JOIN cells w ON w.row = c.row AND w.col = c.col - 1 LEFT JOIN cells n ON n.row = c.row + 1 AND n.col = c.col LEFT JOIN cells s ON s.row = c.row - 1 AND s.col = c.col),
        f0 AS (SELECT *, sqrt(gx * gx + gy * gy) AS slope FROM g WHERE gx IS NOT NULL AND gy IS NOT NULL), f1 AS (SELECT *, CASE WHEN slope <= 1e-6 THEN 0 ELSE fmod(degrees(atan2(gx, gy)) + 360, 360::DOUBLE) END AS aspect FROM f0),
        f AS (SELECT *, CASE WHEN slope <= 1e-6 THEN 0 ELSE fmod(aspect + 90, 180::DOUBLE) END AS pref FROM f1),
        b AS (SELECT a.cell, avg(least(abs(a.aspect - o.aspect), 360 - abs(a.aspect - o.aspect))) AS da, avg(least(abs(a.pref - o.pref), 180 - abs(a.pref - o.pref))) AS dp, avg(abs(a.slope - o.slope)) AS ds FROM f a JOIN f o ON (o.row = a.row AND abs(o.col - a.col) = 1) OR (o.col = a.col AND abs(o.row - a.row) = 1) GROUP BY a.cell),
        k AS (SELECT f.*, coalesce((0.65 * da + 0.35 * dp + 70 * ds) * greatest(0.3, least(1.8, slope / 0.18)), 0) AS br FROM f LEFT JOIN b USING (cell))
        SELECT cell, round(slope, 5) AS slope, round(aspect, 5) AS aspect, round(pref, 5) AS preferred, round(br, 3) AS strength, round(greatest(0, least(1, slope / 0.12)) * greatest(0.15, least(1, 1 - br / 65)), 3) AS sure FROM k""",
        "cells",
    ),
    "region_objective": with_tables(
        """WITH h AS (SELECT c.*, range AS heading, area / 1000 AS slope, radians(least(abs(bearing - range), 180 - abs(bearing - range))) AS d, greatest(1e-6, area * (0.35 + 0.65 * conf)) AS w FROM cells c, range(0, 180, 15)),
        m AS (SELECT *, pow(sin(d), 2) * (0.35 + 0.65 * conf) AS m, greatest(0, least(1.8, sin(d) * slope / 0.12)) AS x FROM h), l AS (SELECT *, x * (0.55 + 0.45 * conf) AS lift, greatest(0, least(1, greatest(0, m - 0.3) * 1.8 + greatest(0, x - 1) * 0.5)) AS u FROM m),
        o AS (SELECT *, greatest(0, sqrt(pow(150 * (1 + 0.65 * lift), 2) + pow(150 * tan(radians(45)), 2)) / 200 - 1) AS o FROM l), q AS (SELECT *, greatest(0, least(1, o * 1.25 + greatest(0, m + 0.35 * lift - 1.1))) AS holes, greatest(0, least(1.15, 1 - 1.05 * m - 0.42 * lift - 1.6 * o)) AS dense FROM o),
        z AS (SELECT *, 1.35 * m + 0.35 * x + 1.05 * u AS cam, 0.85 * greatest(0, 1 - dense) + 2.2 * holes + 1.75 * greatest(0, least(1, (1 - dense) * 0.75 + holes * 0.9)) + 0.35 * m AS lid FROM q)
        SELECT region, heading::INTEGER AS heading, round(sum(cam * w) / sum(w), 5) AS camera, round(sum(u * w) / sum(w), 5) AS camera_low, round(sum(lid * w) / sum(w), 5) AS lidar, round(sum(holes * w) / sum(w), 5) AS lidar_holes, round(sum(dense * 100 * w) / sum(w), 5) AS lidar_coverage FROM z GROUP BY ALL""",
        "cells",
    ),
    "camera_by_payload": with_tables(
        "WITH c(camera, f, s) AS (VALUES " + ", ".join(f"('{k}', {f!r}::DOUBLE, {max(sx, sy)!r}::DOUBLE)" for k, f, sx, sy, *_ in sensors.CAMERAS) + ") SELECT camera, count(*) AS poses, round(min(s * alt / f * 100), 5) AS best, round(max(s * alt / f * 100), 5) AS worst, round(avg(s * alt / f * 100), 5) AS mean FROM poses, c GROUP BY camera",
        "poses",
    ),
    "coverage_rollup": with_tables("WITH p AS (SELECT *, floor(y / 100)::BIGINT AS tile FROM points) SELECT coalesce(class, 'all') AS class, coalesce(tile, -1) AS tile, count(*) AS n, round(sum(w), 2) AS area, round(min(x), 3) AS least, round(max(x), 3) AS most, grouping_id(p.class, p.tile) AS level FROM p GROUP BY ROLLUP (p.class, p.tile)", "points"),
    "downsample": with_tables(
        "WITH r AS (SELECT row, col, z, cell % 7 <> 0 AS valid FROM cells) SELECT row // 2 AS row, col // 2 AS col, round(avg(CASE WHEN valid THEN z END), 5) AS z, bool_or(valid) AS valid FROM r GROUP BY row // 2, col // 2", "cells"
    ),
}
