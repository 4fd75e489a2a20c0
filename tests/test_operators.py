"""Closed forms, brute force and round trips of operators that SQL can't express or doesn't cover."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from swathline.functions import geo, sensors
from swathline.operators import generators, raster, search, spatial, weighted
from swathline.sources import documents as docs
from swathline.streaming import poses as streams


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_lidar_density_of_the_data_sheet(spark):
    r = one(spark, d=sensors.single_pass_density(F.lit("single"), F.lit(66.0), 12.0), none=sensors.single_pass_density(F.lit("single"), F.lit(66.0), 0.0))
    assert round(r.d, 1) == 101.0 and r.none == 0
    assert sensors.CHANNELS[0] == 19.5 and sensors.CHANNELS[-1] == -20.8 and len(sensors.CHANNELS) == 32


def test_planar_fit(spark):
    pts = [(1, float(x), float(y), 0.3 * x + 0.1 * y + 7) for x in range(6) for y in range(6)]
    r = weighted.plane_fit(spark.createDataFrame(pts, "k int, x double, y double, z double"), ["k"]).first()
    assert (round(r.a, 9), round(r.b, 9), round(r.r2, 9)) == (0.3, 0.1, 1.0)
    assert round(r.contour, 6) == round((math.degrees(math.atan2(0.3, 0.1)) + 90) % 180, 6)


def test_quantile_is_a_value(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 3.0), (1, 10.0, 1.0), (1, float("nan"), 5.0), (1, 4.0, 0.0)], "k int, v double, w double")
    r = weighted.weighted_quantiles(df, ["k"], "v", "w", {"q": 0.5, "top": 1.0}).first()
    assert (r.q, r.top) == (2.0, 10.0)


def test_concave_sweeps(spark):
    """A U of 100 with a notch of 40 in the middle of its top."""
    u = [(0, 0), (100, 0), (100, 100), (70, 100), (70, 60), (30, 60), (30, 100), (0, 100)]
    ring = spark.createDataFrame([(1, [(float(x), float(y)) for x, y in u])], "k int, ring array<struct<x:double,y:double>>")
    lines = generators.sweep_lines(ring, ["k"], 90.0, 10.0).collect()
    by_line = {}
    for r in lines:
        by_line.setdefault(r.line, []).append(round(r.hi - r.lo, 6))
    assert sorted(map(sorted, by_line.values())) == [[30.0, 30.0]] * 4 + [[100.0]] * 6


def test_grid_area_is_the_ring_s(spark):
    ring = spark.createDataFrame([(1, [(5.0, 0.0), (90.0, 20.0), (60.0, 95.0), (10.0, 70.0)])], "k int, ring array<struct<x:double,y:double>>")
    got = generators.grid_cells(ring, ["k"], 9.0, least=0.0).agg(F.sum("area")).first()[0]
    assert got == pytest.approx(ring.select(geo.ring_area(F.col("ring"))).first()[0])


def test_flat_ground_under_nadir_poses(spark):
    h = 100.0
    pixels = spark.createDataFrame([(i, float(x), 0.0, 0.0, 0.0, 0.0, 1.0) for i, x in enumerate((0, 20, 54, 56, 200))], "pixel long, x double, y double, z double, nx double, ny double, nz double")
    pose = spark.createDataFrame([(1, 0, 0.0, 0.0, h, 0.0)], "pose long, camera int, x double, y double, z double, ground double").withColumns(sensors.rotation(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    got = {r.pixel: r for r in spatial.visible(pixels, pose, sensors.cameras(spark), 30.0).collect()}
    assert set(got) == {0, 1, 2}  # half a footprint is 55.4 m
    assert got[0].gsd == pytest.approx(h * 4.88e-6 / 0.035) and got[2].gsd == pytest.approx(got[0].gsd)


def test_order_of_areas_against_brute_force():
    import numpy as np

    from swathline.operators import sequences

    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 5):
        cost, start, end = rng.random((2 * n, 2 * n)), rng.random(2 * n), rng.random(2 * n)
        paths = [[2 * a + f for a, f in zip(o, fs, strict=True)] for o in itertools.permutations(range(n)) for fs in itertools.product((0, 1), repeat=n)]
        total = lambda p: start[p[0]] + sum(cost[a, b] for a, b in itertools.pairwise(p)) + end[p[-1]]  # noqa: B023, E731
        found, path = sequences.cheapest_path(cost, start, end)
        assert found == pytest.approx(min(map(total, paths))) == pytest.approx(total(path))
        good, path = sequences.good_path(cost, start, end)
        assert good == pytest.approx(total(path)) and good >= found - 1e-9 and sorted(s // 2 for s in path) == list(range(n))


def test_orders_are_exact_up_to_seventeen_areas(spark):
    """Areas on a line: the way from one end to the other, whichever way round, though they come in no order."""
    from swathline.operators import sequences

    rows = [(1, i, 0.0, (i * 7 % 17) * 1000.0, 0.0) for i in range(17)]
    areas = spark.createDataFrame(rows, "mission long, area long, half double, x double, z double")
    links = sequences.connections(areas, ["mission"], "area", 10.0, 4.0, 3.0)
    ends = areas.select("mission", "area", F.explode(F.array(F.lit(0), F.lit(1))).alias("flip"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"))
    got = sequences.sequence(links, ends, ["mission"], "area").orderBy("place").collect()
    places = [r.area * 7 % 17 for r in got]
    assert got[0].cost == pytest.approx(1600.0) and places in (list(range(17)), list(range(16, -1, -1)))


def test_bearing_search_and_picks():
    found = search.fine_search(lambda bs: {b: abs((b - 37 + 90) % 180 - 90) for b in bs}, [float(b) for b in range(0, 180, 15)])
    assert found == (37.0, 0.0)
    assert search.apart([(10, 1.0), (175, 1.1), (60, 1.2), (95, 1.3)], 30.0, 3) == [10, 60, 95]


def test_components_on_a_path(spark):
    nodes = spark.range(200).select(F.col("id").alias("node"))
    edges = spark.range(150).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.component for r in search.components(nodes, edges).collect()}
    assert got == {n: 0 if n <= 150 else n for n in range(200)}


def test_pyramid(spark):
    r = spark.range(5 * 3).select(F.floor(F.col("id") / 3).alias("row"), (F.col("id") % 3).alias("col"), (F.col("id") * 1.0).alias("z"), (F.col("id") != 4).alias("valid"))
    levels = raster.pyramid(r, 5, 3, least=1, last=1).groupBy("level").agg(F.count("*").alias("n"), F.min("row")).collect()
    assert {x.level: x.n for x in levels} == {0: 15, 1: 6, 2: 2}
    assert raster.downsample(r, 5, 3).filter("row = 0 AND col = 0").first().z == pytest.approx((0 + 1 + 3) / 3)


def test_documents(spark):
    kml = """<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates> 8.5,47.3,0 8.6,47.3,0
    8.6,47.4,0 </coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark><Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>1,2 3,4</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"""
    rings = docs.read_kml(spark.createDataFrame([("a", kml)], "file string, text string")).collect()
    assert [[(p.x, p.y) for p in r.ring] for r in rings] == [[(8.5, 47.3), (8.6, 47.3), (8.6, 47.4), (8.5, 47.3)]]
    poses = '{"captures": [{"id": "1", "coordinates": [47.3, 8.5, 500], "crs": "EPSG:4326", "orientation": [1, 2, 3], "time": "2024-01-02T03:04:05Z"}, {"id": "2", "coordinates": [1, 2, 3], "crs": "EPSG:2056"}, {"id": "3"}]}'
    got = docs.read_poses(spark.createDataFrame([("a", poses), ("b", "no json")], "file string, text string")).collect()
    assert [(r.id, r.lng, r.lat, r.yaw) for r in got] == [("1", 8.5, 47.3, 1.0)]
    tags = '{"flights": [{"kind": "raw", "geotag": [{"coordinate": ["1", "2", "3"]}]}, {"kind": "ProcessedForward", "geotag": [{"coordinate": ["47.3", "8.5", "x"], "omega": "3.141592653589793", "phi": "0", "kappa": "0"}]}]}'
    r = docs.read_geotags(spark.createDataFrame([("a", tags)], "file string, text string")).first()
    assert (r.lat, r.lng, r.alt, round(r.omega, 6)) == (47.3, 8.5, None, 180.0)
    assert '"FeatureCollection"' in docs.geojson(spark.createDataFrame([("a", 1, 8.5, 47.3, 1.0)], "file string, id int, lng double, lat double, alt double"), ("file",), "id").first().text


def test_id_lists(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, app=docs.append_ids(a("a", "b"), a("b", "c")), rem=docs.remove_ids(a("a", "b", "c"), a("b")), rep=docs.replace_ids(a("a", "b", "c", "d"), a("b", "d"), a("x", "y")), end=docs.replace_ids(a("a"), a("z"), a("x")))
    assert (r.app, r.rem, r.rep, r.end) == (["a", "b", "c"], ["a", "c"], ["a", "x", "y", "c"], ["a", "x"])


def test_stream_of_poses(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02d}:00:00", i % 2, 10.0 * i) for i, h in enumerate((1, 1, 2, 2, 9, 9, 23))]
    table = spark.createDataFrame(rows, "event_id long, t string, user_id long, alt double").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "alt")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    for name, make in (("w", lambda d: streams.windows(d, "4 hours")), ("s", lambda d: streams.sessions(d, "3 hours"))):
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(60)
        closed = {tuple(r) for r in spark.table(name).collect()}
        whole = {tuple(r) for r in make(table).collect()}
        assert closed and closed < whole  # what the watermark hasn't passed stays open


def test_lidar_over_flat_ground(spark):
    """A long strip over flat ground lays down rate over speed and swath; nothing beyond its swath."""
    from swathline.operators.lidar import density

    ground = spark.range(50 * 50).selectExpr("0L AS tile", "CAST(id DIV 50 AS INT) AS row", "CAST(id % 50 AS INT) AS col", "0D AS z")
    strips = spark.createDataFrame([(0, 1, 200.0, -200.0, 50.0, 200.0, 600.0, 50.0, 16.0, 160000.0)], "tile long, strip long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, speed double, rate double")
    got = density(ground, strips, 8.0, azimuths=181, reach=200.0).toPandas()
    middle = got[(got.row > 15) & (got.row < 35)]
    line = middle.groupby("row").density.sum() * 8  # points a metre along the strip
    assert line.mean() == pytest.approx(160000 / 16, rel=0.03)
    assert got.col.min() >= (200 - 56) // 8 and got.col.max() <= (200 + 56) // 8
    assert set(got.passes) == {1}


def test_quantile_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("b", 5.0, 0.0), ("c", float("nan"), 1.0), ("c", None, 1.0)], "k string, v double, w double")
    assert {r.k: r.q for r in weighted.weighted_quantiles(df, ["k"], "v", "w", {"q": 0.5}).collect()} == {"a": 2.0, "b": 0.0, "c": 0.0}


def test_updates_count_once(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x")], "id long, what string")
    assert streams.once(df, ["id"]).count() == 2
