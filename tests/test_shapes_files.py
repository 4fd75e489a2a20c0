"""Polygon algebra, file codecs, patches and partitions, turns: closed forms, round trips and small cases by hand."""

import io
import math
import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swathline.operators import atoms, bearings, flights, polygons, solver
from swathline.sources import documents, files


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_polygon_algebra_by_hand():
    both = lambda a, b, kind: sorted(round(polygons.signed_area(r), 6) for r in polygons.boolean([a], [b], kind))
    a = box(0, 0, 10, 10)
    assert both(a, box(5, 5, 15, 15), "union") == [175] and both(a, box(5, 5, 15, 15), "intersection") == [25] and both(a, box(5, 5, 15, 15), "difference") == [75]
    assert both(a, box(3, 3, 7, 7), "difference") == [-16, 100]  # a hole
    assert both(a, box(-5, 4, 15, 6), "difference") == [40, 40]  # cut in two
    assert both(a, box(10, 0, 20, 10), "union") == [200] and both(a, box(10, 0, 20, 10), "intersection") == []  # a common side
    assert both(a, box(10, 10, 20, 20), "union") == [100, 100]  # a common corner
    assert both(a, a, "union") == both(a, a, "intersection") == [100] and both(a, a, "difference") == []
    assert both(a, box(20, 20, 30, 30), "union") == [100, 100] and both(a, box(2, 0, 4, 10), "difference") == [20, 60]
    u = [(0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30)]
    assert both(u, box(5, 20, 25, 40), "intersection") == [50, 50] and both(u, box(0, 30, 30, 40), "union") == [-200, 1200]


def test_random_polygons_keep_their_areas():
    rng = np.random.default_rng(1)
    for _ in range(60):
        rings = []
        for _ in range(2):
            n = int(rng.integers(5, 12))  # no gap of half a turn, so that no sides cross
            t = (np.arange(n) + rng.uniform(0, 0.8, n)) / n * 2 * math.pi
            r = rng.uniform(2, 10, len(t))
            rings.append(list(zip((r * np.cos(t) + rng.uniform(-4, 4)).tolist(), (r * np.sin(t)).tolist(), strict=True)))
        size = {k: sum(map(polygons.signed_area, polygons.boolean([rings[0]], [rings[1]], k))) for k in ("union", "intersection", "difference")}
        a, b = (abs(polygons.signed_area(r)) for r in rings)
        assert size["union"] + size["intersection"] == pytest.approx(a + b, abs=1e-3) and size["difference"] + size["intersection"] == pytest.approx(a, abs=1e-3)


def test_coverages_stay_coverages():
    wavy = [(10 + (0.3 if i % 2 else -0.3) * (0 < i < 10), float(i)) for i in range(11)]
    left, right = [(0.0, 0.0), *wavy, (0.0, 10.0)], [(20.0, 10.0), *wavy[::-1], (20.0, 0.0)]
    a, b = polygons.simplify_rings([left, right], 1.0)
    assert len(a) == len(b) == 4 and abs(polygons.signed_area(a)) + abs(polygons.signed_area(b)) == pytest.approx(200)
    assert len(polygons.simplify_rings([left, right], 0.1)[0]) == len(left)


def test_empty_and_null_rings(spark):
    point = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(1, box(0.0, 0.0, 1.0, 1.0), None), (2, None, None), (3, [], box(0.0, 0.0, 2.0, 1.0))], f"id long, a {point}, b {point}")
    got = {(r["id"], r.kind): r.area for r in polygons.algebra(df, ["id"]).collect()}
    assert got[1, "union"] == got[1, "difference"] == 1 and got[1, "intersection"] == 0 and got[2, "union"] == 0 and got[3, "union"] == 2
    assert polygons.algebra(df.limit(0), ["id"]).count() == 0


def filtered_png(image, how):
    """A file whose rows are all filtered one way."""
    h, w, c = image.shape
    rows = []
    for r in range(h):
        line, above = image[r].astype(int), image[r - 1].astype(int) if r else np.zeros((w, c), int)
        left, corner = np.vstack([np.zeros((1, c), int), line[:-1]]), np.vstack([np.zeros((1, c), int), above[:-1]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        rows.append(bytes([how]) + ((line - [0, left, above, (left + above) // 2, paeth][how]) % 256).astype(np.uint8).tobytes())
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6, 1: 0}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("how", range(5))
def test_png_filters(how):
    rng = np.random.default_rng(how)
    for c in (1, 3, 4):
        image = rng.integers(0, 256, (7, 9, c)).astype(np.uint8)
        got = files.decode_png(filtered_png(image, how))
        assert (got[:, :, : max(c, 3)] == (np.repeat(image, 3, axis=2) if c == 1 else image)).all() and (c == 4 or (got[:, :, 3] == 255).all())
    image = rng.integers(0, 256, (5, 6, 4)).astype(np.uint8)
    assert (files.decode_png(files.encode_png(image)) == image).all()
    with pytest.raises(ValueError):
        files.decode_png(b"GIF89a")


def test_tiff_round_trip_and_refusals():
    z = np.arange(12.0).reshape(3, 4)
    z[1, 2], z[2, 0] = -9999, np.inf
    data = files.encode_tiff(z, 100.0, 900.0, 2.5, 32632, -9999.0)
    d = files.tiff_descriptor(data)
    assert (d["width"], d["height"], d["epsg"], d["nodata"], d["max_x"], d["min_y"]) == (4, 3, 32632, -9999.0, 110.0, 892.5)
    got, good = files.decode_tiff(data)
    assert (got[good] == z[good]).all() and good.sum() == 10 and not good[1, 2] and not good[2, 0]
    with pytest.raises(ValueError, match="georeference"):
        files.tiff_descriptor(data.replace(struct.pack("<HH", 33550, 12), struct.pack("<HH", 33551, 12)))
    with pytest.raises(ValueError, match="one band"):
        files.tiff_descriptor(data.replace(struct.pack("<HHIH", 277, 3, 1, 1), struct.pack("<HHIH", 277, 3, 1, 3)))
    with pytest.raises(ValueError, match="TIFF"):
        files.decode_tiff(b"PK\x03\x04")


def test_clouds_of_one_system(spark):
    one = lambda epsg: bytearray(files.encode_las(np.array([1.0, 2.5]), np.array([3.0, -4.25]), np.array([0.0, 9.99]), np.array([2, 31]), epsg=epsg))
    df = spark.createDataFrame([("a", one(32632)), ("b", one(32632))], "path string, content binary")
    assert files.las_crs(df) == "EPSG:32632"
    assert sorted((r.path, r.x, r.y, r.z, r["class"]) for r in files.read_las(df, ["path"]).collect())[:2] == [("a", 1.0, 3.0, 0.0, 2), ("a", 2.5, -4.25, 9.99, 31)]
    with pytest.raises(ValueError, match="different"):
        files.las_crs(df.unionByName(spark.createDataFrame([("c", one(2056))], df.schema)))


def test_archives_and_tile_folders(spark, tmp_path):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("readme.txt", "x"), z.writestr("sub/AREA.KML", "<kml/>")
    df = spark.createDataFrame([(1, bytearray(f.getvalue()))], "id long, content binary")
    assert files.read_kmz(df, ["id"]).first().text == "<kml/>"
    at = tmp_path / "14" / "8500"
    at.mkdir(parents=True)
    (at / "5700.png").write_bytes(files.encode_png(np.full((2, 2, 4), 7, np.uint8)))
    (tmp_path / "other.png").write_bytes(b"")
    tiles = files.scan_tiles(spark, str(tmp_path))
    assert [(r.z, r.x, r.y) for r in tiles.collect()] == [(14, 8500, 5700)] and files.read_png(tiles, ["z", "x", "y"]).count() == 4
    documents.write_artifacts(spark.createDataFrame([("r1", "grid", '{"a":1}'), ("r1", "plans", "[]")], "request_id string, name string, text string"), str(tmp_path / "debug"))
    assert sorted(r.name for r in spark.read.text(str(tmp_path / "debug")).collect()) == ["grid", "plans"]


def patches(spark, rows, cols, bearing):
    cells = [(1, r * cols + c, r, c, c * 100.0, r * 100.0, 10000.0, float(bearing(r, c)), 0.0, 0.1, 0.9, 1.0) for r in range(rows) for c in range(cols)]
    return spark.createDataFrame(cells, "zone int, cell long, row long, col long, x double, y double, area double, bearing double, aspect double, slope double, conf double, strength double")


def test_two_modes_become_two_patches_halves_and_regions(spark):
    c = patches(spark, 4, 8, lambda r, col: 0 if col < 4 else 90)
    got = {r.cell: r.atom for r in atoms.atoms(c, ["zone"]).collect()}
    assert set(got.values()) == {0, 4} and all((k % 8 >= 4) == (v == 4) for k, v in got.items())
    sides = {r.cell: r.side for r in atoms.halves(c, ["zone"]).collect()}
    assert len({sides[k] for k in sides if k % 8 < 4}) == len({sides[k] for k in sides if k % 8 >= 4}) == 1 and sides[0] != sides[7]
    levels = {r.level: r.cost for r in atoms.frontier(atoms.segmentation(c, ["zone"]), ["zone"]).collect()}
    assert set(levels) == {1, 2} and levels[2] < levels[1]


def test_like_cells_are_one_patch(spark):
    c = patches(spark, 3, 5, lambda r, col: 30)
    assert {r.atom for r in atoms.atoms(c, ["zone"]).collect()} == {0} and {r.level for r in atoms.segmentation(c, ["zone"]).collect()} == {1}


def test_partition_cuts_where_the_terrain_turns(spark):
    c = patches(spark, 10, 20, lambda r, col: 0 if col < 10 else 90)
    plans = solver.solved(c, ["zone"], step=100.0, spacing=60.0, depth=1)
    two = plans.filter("regions = 2").groupBy("plan", "region").agg(F.min("col").alias("lo"), F.max("col").alias("hi"), F.first("heading").alias("h"), F.first("quality").alias("q")) if "col" in plans.columns else plans.join(c.select("cell", "col"), "cell").filter("regions = 2").groupBy("plan", "region").agg(F.min("col").alias("lo"), F.max("col").alias("hi"), F.first("heading").alias("h"), F.first("quality").alias("q"))
    best = sorted(two.collect(), key=lambda r: (r.q, r.plan, r.region))[:2]
    assert [(r.lo, r.hi) for r in best] == [(0, 9), (10, 19)]
    assert min(best[0].h % 180, 180 - best[0].h % 180) < 10 and abs(best[1].h - 90) < 10
    assert plans.filter("regions = 1").count() == 200


def test_plans_on_a_frontier_beat_none_of_each_other():
    cells = pd.DataFrame([(r, c, c * 100.0, r * 100.0, 10000.0, (c // 3 * 40 + r // 3 * 25) % 180, 0.0, 0.1, 0.8, 2.0) for r in range(7) for c in range(9)], columns=["row", "col", "x", "y", "area", "bearing", "aspect", "slope", "conf", "strength"])
    area = solver.Area(cells, 100.0, 60.0, 12.0, 40.0)
    plans = area.solve(np.arange(len(cells)), 2)
    assert 1 <= len(plans) <= solver.MOST_STATES and any(len(p["regions"]) == 1 for p in plans)
    for p in plans:
        assert sorted(np.concatenate([r["cells"] for r in p["regions"]]).tolist()) == list(range(len(cells)))
        assert all(area.connected(r["cells"]) for r in p["regions"]) and len(p["regions"]) <= solver.MOST_REGIONS
    same = [p for p in plans if len(p["regions"]) > 1 and area.practical(p)]
    assert not any(a["quality"] < b["quality"] - 1e-6 and a["seconds"] < b["seconds"] - 1e-6 for a in same for b in same)


def test_rings_from_a_tree_of_cuts():
    tree = {"direction": 90.0, "at": -4.0, "left": {"direction": 0.0, "at": 3.0, "left": None, "right": None}, "right": None}
    rings = solver.reconstruct(box(0, 0, 10, 10), tree)
    assert sorted(round(abs(polygons.signed_area(r)), 6) for r in rings) == [18, 40, 42]
    assert solver.reconstruct(box(0, 0, 1, 1), None) == [box(0, 0, 1, 1)]
    assert solver.hull_area(np.array([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0)])) == 16


def test_a_turn_leads_to_the_next_sweep():
    path = flights.simulate_turn((0, 0), (0, 80), (60, 80), (120, 0), 0.0, 60.0, 16.0)
    assert path is not None and path[-1][:2] == (120, 0) and path[-1][2] > 20
    assert all(math.dist(a[:2], b[:2]) < 12 for a, b in zip(path, path[1:]))
    assert flights.simulate_turn((0, 0), (0, 80), (60, 80), (120, 0), 0.0, 60.0, 16.0, most=5.0) is None


def test_faces_and_their_merging(spark):
    c = patches(spark, 4, 12, lambda r, col: 0 if col < 6 else 80)
    leaves = bearings.face_partition(c, ["zone"])
    found = {frozenset(r.cells) for r in leaves.groupBy("leaf").agg(F.collect_list(F.col("col")).alias("cells")).collect()}
    assert found == {frozenset(range(6)), frozenset(range(6, 12))}
    t = F.radians(F.lit(2) * F.col("b"))
    rows = spark.createDataFrame([(1, "x", 4.0, 10.0), (1, "y", 4.0, 12.0), (1, "z", 4.0, 90.0)], "zone int, leaf string, area double, b double")
    sums = rows.select("zone", "leaf", "area", (F.cos(t) * F.col("area")).alias("c"), (F.sin(t) * F.col("area")).alias("s"))
    borders = spark.createDataFrame([(1, "x", "y"), (1, "y", "z")], "zone int, left string, right string")
    assert {r.leaf: r.merged for r in bearings.merge_leaves(sums, borders, ["zone"]).collect()} == {"x": "x", "y": "x", "z": "z"}


def test_runtime_binds_terrain_and_kernels(spark):
    from swathline.operators.runtime import Kernels, RegionRuntime, TableTerrain

    tiles = spark.range(9).selectExpr("id % 3 AS tx", "id div 3 AS ty", "id AS z")
    terrain = TableTerrain(tiles, 4)
    assert terrain.tiles(spark.createDataFrame([(1, 1), (7, 7)], "tx long, ty long")).count() == 1
    assert terrain.with_halo(spark.createDataFrame([(1, 1)], "tx long, ty long"), 1).count() == 9
    run = RegionRuntime(terrain, Kernels(spark, 30.0, 8.0))
    cost = lambda df: df.withColumn("cost", F.abs(F.col("bearing") - 37.0) / 90)
    assert run.optimise(spark.createDataFrame([(1,)], "r int"), ["r"], cost).first().bearing == 37.0
    best = run.rerank(spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0)], "r int, plan string, score double"), ["r"], "plan", "score")
    assert best.first().plan == "b"
