"""What the third round's findings showed, held."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from swathline.operators import solver
from swathline.plans import partitions


def _area(rows=2, cols=20):
    cells = pd.DataFrame([(r * cols + c, r, c) for r in range(rows) for c in range(cols)], columns=["cell", "row", "col"])
    n = cells["cell"]
    more = {"x": cells["col"] * 100.0, "y": cells["row"] * 100.0, "area": 10000.0, "bearing": (cells["col"] // 7 * 55.0 + n % 5) % 180, "aspect": (cells["col"] // 7 * 55.0 + 90) % 360, "slope": 0.05 + n % 4 * 0.02, "conf": 0.5 + n % 3 * 0.2, "strength": (n % 6).astype(float)}
    return solver.Area(cells.assign(**more), 100.0, 60.0, 12.0, 40.0)


def test_partition_plans_cut_as_deep_as_the_search_goes(spark, tmp_path):
    """An area of two rows has plans of over two regions, and one of the area as it is; every plan holds every cell."""
    rows = [(i, f"Brand#{i % 5}", 1 + i % 50, 900.0 + i / 10) for i in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = partitions.partition_plans(spark, str(tmp_path)).collect()
    assert max(r.regions for r in got) > 2 and min(r.regions for r in got) == 1 and {r.cells for r in got} == {40}


def test_a_full_frontier_keeps_the_unsplit_plan():
    """Of 43 plans that don't beat each other 20 are kept: the unsplit one, though it is the worst, and the practical ones before the others."""
    area = _area()
    plans = [{"regions": [0] * n, "quality": 0.1 + n / 10 - k / 1000, "seconds": 100.0 - n * 10 + k, "good": n > 4} for n in range(2, 9) for k in range(6)]
    area.practical = lambda p: p["good"]
    whole = {"regions": [0], "quality": 9.0, "seconds": 200.0, "good": False}
    kept = area.frontier([*plans, whole])
    assert len(kept) == solver.MOST_STATES and whole in kept and {len(p["regions"]) for p in kept if p["good"]} == {5, 6, 7, 8}


def test_hulls_of_cells_are_those_of_all_their_corners():
    """The ends of rows make the same hull as every corner; lines of all headings at once are those of a plain count."""
    area = _area(4, 9)
    for seed in range(60):
        own = np.flatnonzero(np.random.default_rng(seed).random(36) < 0.1 + seed / 80)
        if len(own):
            x, y = area.c["x"][own], area.c["y"][own]
            corners = np.concatenate([np.stack([x + dx, y + dy], axis=1) for dx in (-50.0, 50.0) for dy in (-50.0, 50.0)])
            assert solver.cells_hull_area(x.tolist(), y.tolist(), 50.0) == solver.hull_area(corners) > 0
            for r in area._flown(own, [0.0, 40.0, 90.0]):
                d = np.radians(r["heading"])
                along, across = x * np.sin(d) + y * np.cos(d), x * np.cos(d) - y * np.sin(d)
                line = np.rint((across - across.mean()) / 100.0)
                lengths = [np.ptp(along[line == n]) + 100.0 for n in np.unique(line)]
                lost = [min(1.0, max(0.0, 1 - (line == n).sum() / max(1, np.rint(w / 100.0)))) for n, w in zip(np.unique(line), lengths, strict=True)]
                assert np.isclose(r["mean_line"], np.mean(lengths)) and np.isclose(r["fragments"], np.mean(lost)) and np.isclose(r["short"], np.mean([w < 300 for w in lengths])) and r["lines"] == len(lengths) / 0.6
