"""Lidar coverage of terrain tiles: beams marched through a raster, tile by tile, as arrays.

Marching is sequential along a beam and independent across beams, so a tile's beams advance together. Strips come to the
tiles that they can reach by an equi-join (spatial.strips_to_tiles); a tile's raster and strips meet in one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.sensors import CHANNELS


def heights(dem: np.ndarray, x: np.ndarray, y: np.ndarray, pixel: float) -> np.ndarray:
    """Bilinear terrain under points in pixels' metres from the raster's south-west corner; NaN outside half a pixel."""
    rows, cols = dem.shape
    c, r = x / pixel - 0.5, y / pixel - 0.5
    inside = (c >= -0.5) & (c <= cols - 0.5) & (r >= -0.5) & (r <= rows - 0.5)
    c, r = np.clip(np.nan_to_num(c), 0, cols - 1), np.clip(np.nan_to_num(r), 0, rows - 1)
    c0, r0 = np.minimum(c.astype(int), max(0, cols - 2)), np.minimum(r.astype(int), max(0, rows - 2))
    c1, r1, fc, fr = np.minimum(c0 + 1, cols - 1), np.minimum(r0 + 1, rows - 1), c - c0, r - r0
    z = (dem[r0, c0] * (1 - fc) + dem[r0, c1] * fc) * (1 - fr) + (dem[r1, c0] * (1 - fc) + dem[r1, c1] * fc) * fr
    return np.where(inside, z, np.nan)


def march(dem: np.ndarray, pixel: float, start: np.ndarray, way: np.ndarray, reach: float) -> np.ndarray:
    """Distance along each beam (rows of start and unit way) to the first place at or under the terrain; NaN if none in reach.

    A beam that is already under the terrain where it enters the raster has hit it elsewhere.
    """
    above = lambda k, s: start[k, 2] + way[k, 2] * s - heights(dem, start[k, 0] + way[k, 0] * s, start[k, 1] + way[k, 1] * s, pixel)
    hit = np.full(len(start), np.nan)
    going = np.flatnonzero(way[:, 2] < -1e-6)
    seen = above(going, np.zeros(len(going))) > 0  # False outside the raster
    step, before = max(1.5, 0.75 * pixel), 0.0
    for s in [*np.arange(step, reach, step), reach]:
        if not len(going):
            break
        height = above(going, np.full(len(going), s))
        under = height <= 0
        found = going[under & seen]
        lo, hi = np.full(len(found), before), np.full(len(found), s)
        for _ in range(8):
            mid = (lo + hi) / 2
            low = above(found, mid) <= 0
            lo, hi = np.where(low, lo, mid), np.where(low, mid, hi)
        hit[found] = hi
        going, seen, before = going[~under], (height > 0)[~under], s
    return hit


def beams(strip: dict, azimuths: int, fov: float, spacing: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Starts and ways of a strip's beams, and the points that each stands for."""
    a, b = (np.array([strip[f"{c}{k}"] for c in "xyz"], float) for k in (1, 2))
    length = float(np.hypot(*(b - a)[:2]))
    n = max(1, int(np.ceil(length / spacing)))
    at = a + (b - a) * ((np.arange(n) + 0.5) / n)[:, None]
    along = np.array([*(b - a)[:2], 0.0]) / max(length, 1e-9)
    across = np.array([along[1], -along[0], 0.0])
    t, u = np.meshgrid(np.radians((np.arange(azimuths) / max(1, azimuths - 1) - 0.5) * fov), np.radians(np.array(CHANNELS)), indexing="ij")
    t, u = t.ravel(), u.ravel()
    side, down = np.sin(t)[:, None] * across, np.cos(t)[:, None] * np.array([0.0, 0.0, -1.0])
    way = (side + down) * np.cos(u)[:, None] + along * np.sin(u)[:, None]
    weight = strip["rate"] * (length / n) / strip["speed"] / len(way)
    return np.repeat(at, len(way), axis=0), np.tile(way, (n, 1)), weight


def density(raster: DataFrame, strips: DataFrame, pixel: float, azimuths: int = 15, fov: float = 90.0, reach: float = 200.0) -> DataFrame:
    """(tile, row, col, density, passes): points a square metre of every pixel that a beam hits, and the strips that do.

    raster: tile, row, col, z, rows counted northwards; strips: tile, strip, x1 ... z2 in metres from the tile's south-west
    corner, speed, rate. A tile's memory is its raster and the beams of one strip.
    """

    def scan(ground: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        out = {k: [] for k in ("tile", "row", "col", "density", "passes")}
        if len(ground) and len(lines):
            dem = np.full((int(ground["row"].max()) + 1, int(ground["col"].max()) + 1), np.nan)
            dem[ground["row"], ground["col"]] = ground["z"]
            sums, passes = np.zeros_like(dem), np.zeros(dem.shape, np.int64)
            for strip in lines.sort_values("strip").to_dict("records"):
                start, way, weight = beams(strip, azimuths, fov, max(strip["speed"] / 10, 0.75 * pixel))
                s = march(dem, pixel, start, way, reach)
                ok = np.flatnonzero(~np.isnan(s))
                x, y = start[ok, 0] + way[ok, 0] * s[ok], start[ok, 1] + way[ok, 1] * s[ok]
                c, r = np.floor(x / pixel).astype(int), np.floor(y / pixel).astype(int)
                inside = (c >= 0) & (r >= 0) & (r < dem.shape[0]) & (c < dem.shape[1])
                hits = np.zeros_like(sums)
                np.add.at(hits, (r[inside], c[inside]), weight / (pixel * pixel))
                sums += hits
                passes += hits > 0
            row, col = np.nonzero(passes)
            out = {"tile": [ground["tile"].iloc[0]] * len(row), "row": row, "col": col, "density": sums[row, col], "passes": passes[row, col]}
        return pd.DataFrame(out)

    return raster.groupBy("tile").cogroup(strips.groupBy("tile")).applyInPandas(scan, "tile long, row int, col int, density double, passes long")
