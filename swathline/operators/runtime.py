"""What a run over regions needs from outside, as protocols: terrain, tile kernels, costs; and a runtime that binds them to a session.

Anything with these methods will do: a table of tiles or a reader of files as terrain, these kernels or others. All of them take and give
DataFrames, so a run is planned as one job, and its concurrency is the session's.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.sensors import cameras
from . import bearings, choices, lidar, raster, spatial, terrain_tiles

#: The height of the ground under x, y as an expression; null where it isn't known.
TerrainQuery = Callable[[Column, Column], Column]


class TerrainProvider(Protocol):
    def tiles(self, wanted: DataFrame) -> DataFrame:
        """The wanted tiles (tx, ty) that there are, with their columns."""

    def with_halo(self, wanted: DataFrame, pad: int) -> DataFrame:
        """The wanted tiles beside those around them, as (x, y, dx, dy, columns)."""


class TileEvaluator(Protocol):
    def camera(self, pixels: DataFrame, poses: DataFrame) -> DataFrame:
        """(pixel, overlap, gsd)."""

    def lidar(self, ground: DataFrame, strips: DataFrame) -> DataFrame:
        """(tile, row, col, density, passes)."""


class TableTerrain:
    """Terrain from a table of tiles (tx, ty, columns) of one zoom."""

    def __init__(self, table: DataFrame, zoom: int):
        self.table, self.zoom = table, zoom

    def tiles(self, wanted: DataFrame) -> DataFrame:
        return wanted.select("tx", "ty").distinct().join(self.table, ["tx", "ty"])

    def with_halo(self, wanted: DataFrame, pad: int) -> DataFrame:
        own = self.table.withColumnRenamed("tx", "x").withColumnRenamed("ty", "y")
        near = raster.halo(own, self.zoom, pad)
        return near.join(wanted.selectExpr("tx AS x", "ty AS y").distinct(), ["x", "y"], "left_semi")

    def missing(self, boxes: DataFrame, step: float) -> DataFrame:
        return terrain_tiles.prefetch(boxes, self.table, self.zoom, step).filter("NOT there").select("tx", "ty")


class Kernels:
    """The kernels of this package."""

    def __init__(self, spark: SparkSession, size: float, pixel: float):
        self.spark, self.size, self.pixel = spark, size, pixel

    def camera(self, pixels: DataFrame, poses: DataFrame) -> DataFrame:
        return spatial.visible(pixels, poses, cameras(self.spark), self.size)

    def lidar(self, ground: DataFrame, strips: DataFrame) -> DataFrame:
        return lidar.density(ground, strips, self.pixel)


class RegionRuntime:
    """Optimises bearings, evaluates regions and ranks partitions over one terrain, with one evaluator."""

    def __init__(self, terrain: TerrainProvider, evaluator: TileEvaluator):
        self.terrain, self.evaluator = terrain, evaluator

    def optimise(self, regions: DataFrame, keys: list[str], evaluate: bearings.Evaluate, seed: str | None = None) -> DataFrame:
        """(keys, bearing, cost): the best bearing of every region, or near a seed."""
        return bearings.search(regions, keys, evaluate, seed=seed)

    def evaluate(self, pixels: DataFrame, poses: DataFrame, least: int = 3) -> DataFrame:
        """(pixel, overlap, gsd), pixels seen by fewer poses than wanted as not seen."""
        return spatial.at_least(self.evaluator.camera(pixels, poses), least)

    def rerank(self, solutions: DataFrame, keys: list[str], name: str, score: str) -> DataFrame:
        """The best of every group's solutions by their exact score."""
        return choices.best_by(solutions, keys, name, score)
