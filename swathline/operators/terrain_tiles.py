"""Tables of map tiles: which tiles a set of rings needs, which of them there are, and tiles with those around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .generators import tile_cover
from .raster import halo


def wanted(boxes: DataFrame, zoom: int, step: float) -> DataFrame:
    """(tx, ty): every tile, once, that boxes in metres need for terrain in steps of so many metres: 200 m around, or two steps."""
    pad = max(200.0, 2 * step)
    padded = boxes.select((F.col("min_x") - pad).alias("min_x"), (F.col("max_x") + pad).alias("max_x"), (F.col("min_y") - pad).alias("min_y"), (F.col("max_y") + pad).alias("max_y"))
    return tile_cover(padded, [], zoom).distinct()


def prefetch(boxes: DataFrame, tiles: DataFrame, zoom: int, step: float) -> DataFrame:
    """The wanted tiles with the columns of those that there are; `there` tells which, the others' columns are null."""
    keys = wanted(boxes, zoom, step)
    return keys.join(tiles.withColumn("there", F.lit(True)), ["tx", "ty"], "left").withColumn("there", F.coalesce("there", F.lit(False)))


def fetch(requests: DataFrame, tiles: DataFrame, zoom: int) -> DataFrame:
    """Requests (x, y) with their tiles: x wraps around the world, y is held on it; what there is no tile of is left out."""
    from ..functions.geo import tile_normal

    x, y = tile_normal(zoom, F.col("x"), F.col("y"))
    return requests.withColumns({"tx": x, "ty": y}).join(tiles, ["tx", "ty"])


def batch(requests: DataFrame, tiles: DataFrame, zoom: int, pad: int, keys: list[str]) -> DataFrame:
    """(keys, x, y, tiles, whole): for every request how many of the (2 pad + 1)^2 tiles around there are, and whether all are; pad 0 to 2.

    Tiles go once to each of their neighbours' places, so requests for the same tiles share them.
    """
    if not 0 <= pad <= 2:
        raise ValueError("pad is 0, 1 or 2")
    n = F.count(F.lit(1))
    around = halo(tiles.select(F.col("tx").alias("x"), F.col("ty").alias("y")).distinct(), zoom, pad).groupBy("x", "y").agg(n.alias("tiles"))
    return requests.join(around, ["x", "y"], "left").select(*keys, "x", "y", F.coalesce("tiles", F.lit(0)).alias("tiles"), (F.coalesce("tiles", F.lit(0)) == (2 * pad + 1) ** 2).alias("whole"))
