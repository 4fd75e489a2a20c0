"""Rasters as rows: masked downsampling, pyramids, sampling, smoothing, erosion, normals and halos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import num


def downsample(raster: DataFrame, rows: int, cols: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(row, col, z, valid) at half the size: means of valid cells of two by two; an odd rim is repeated outwards.

    Repeating a rim doubles its weight within its own block only, so the block's mean is that of its cells: the
    edge rows of an odd raster are alone in their blocks. One aggregation, with partial sums where the cells are.
    """
    block = [F.floor(F.col(c) / 2).alias(c) for c in ("row", "col")]
    return raster.groupBy(*keys, *block).agg(F.avg(F.when(F.col("valid"), F.col("z"))).alias("z"), F.max("valid").alias("valid"))


def pyramid(raster: DataFrame, rows: int, cols: int, least: int = 256, last: int = 64) -> DataFrame:
    """All levels: `level` 0 is the raster, each further one half the size while the smaller side is over `least` and any side over `last`."""
    out, level = raster.withColumn("level", F.lit(0)), 0
    while min(rows, cols) > least and max(rows, cols) > last:
        raster, rows, cols, level = downsample(raster, rows, cols), -(-rows // 2), -(-cols // 2), level + 1
        out = out.unionByName(raster.withColumn("level", F.lit(level)))
    return out


def sample_bilinear(points: DataFrame, raster: DataFrame, keys: list[str], col: Column, row: Column, size: int, name: str = "z") -> DataFrame:
    """points with the raster's value at fractional (col, row), clamped at the rim; null beyond half a pixel outside.

    The four neighbours come by one equi-join each on (keys, row, col), so both sides are dealt by those keys alone.
    """
    c0 = F.greatest(F.lit(0), F.least(F.lit(size - 2), F.floor(col)))
    r0 = F.greatest(F.lit(0), F.least(F.lit(size - 2), F.floor(row)))
    inside = (col >= -0.5) & (col <= size - 0.5) & (row >= -0.5) & (row <= size - 0.5)
    out = points.withColumns({"__c": c0, "__r": r0, "__fc": F.greatest(F.lit(0.0), F.least(F.lit(1.0), col - c0)), "__fr": F.greatest(F.lit(0.0), F.least(F.lit(1.0), row - r0)), "__in": inside})
    for k, (dr, dc) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        corner = raster.select(*keys, (F.col("row") - dr).alias("__r"), (F.col("col") - dc).alias("__c"), F.col("z").alias(f"__z{k}"))
        out = out.join(corner, [*keys, "__r", "__c"], "left")
    z = [F.col(f"__z{k}") for k in range(4)]
    top, low = z[0] + (z[1] - z[0]) * F.col("__fc"), z[2] + (z[3] - z[2]) * F.col("__fc")
    return out.select(*points.columns, F.when(F.col("__in"), top + (low - top) * F.col("__fr")).alias(name))


def _around(raster: DataFrame, keys: list[str], weigh) -> DataFrame:
    """Every cell beside each cell of the 3 by 3 block that it belongs to: an explosion of nine and one shuffle."""
    shift = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(weigh(r, c)).alias("weight")) for r in (-1, 0, 1) for c in (-1, 0, 1)]))
    spread = raster.withColumn("__s", shift)
    return spread.select(*keys, (F.col("row") + F.col("__s.dr")).alias("row"), (F.col("col") + F.col("__s.dc")).alias("col"), *[F.col(c).alias(f"of_{c}") for c in raster.columns if c not in (*keys, "row", "col")], F.col("__s.dr").alias("dr"), F.col("__s.dc").alias("dc"), F.col("__s.weight").alias("weight"))


def smooth(raster: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Values with weights 1-2-1 over positive neighbours, for display; cells at the border and those without value stay."""
    near = _around(raster.select(*keys, "row", "col", "v"), keys, lambda r, c: (2 - abs(r)) * (2 - abs(c)))
    good = F.col("of_v") > 0
    sums = near.groupBy(*keys, "row", "col").agg((F.sum(F.when(good, F.col("of_v") * F.col("weight"))) / F.sum(F.when(good, F.col("weight")))).alias("__s"), F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.col("of_v"))).alias("v"))
    rim = (F.col("row") <= 0) | (F.col("col") <= 0) | (F.col("row") >= size - 1) | (F.col("col") >= size - 1)
    return sums.filter(F.col("v").isNotNull()).select(*keys, "row", "col", F.when(rim | ~(F.col("v") > 0), F.col("v")).otherwise(F.col("__s")).alias("v"))


def erode(mask: DataFrame, keys: list[str], size: int, times: int = 1) -> DataFrame:
    """Cells of a mask (row, col) whose eight neighbours are in it too; the border never stays; so many times over."""
    for _ in range(times):
        near = _around(mask.select(*keys, "row", "col"), keys, lambda r, c: 1)
        inner = (F.col("row") > 0) & (F.col("col") > 0) & (F.col("row") < size - 1) & (F.col("col") < size - 1)
        mask = near.groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") == 9) & inner).drop("n")
    return mask


def normals(raster: DataFrame, keys: list[str], pixel: Column | float) -> DataFrame:
    """Unit normals from central differences, one-sided at the rim; rows count southwards, and so does ny."""
    near = _around(raster.select(*keys, "row", "col", "z"), keys, lambda r, c: 1)
    at = lambda r, c: F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col("of_z")))
    zs = near.groupBy(*keys, "row", "col").agg(at(0, 0).alias("z"), at(0, -1).alias("e"), at(0, 1).alias("w"), at(-1, 0).alias("s"), at(1, 0).alias("n")).filter("z IS NOT NULL")
    slope = lambda up, down: F.coalesce((F.col(up) - F.col(down)) / (2 * num(pixel)), (F.col(up) - F.col("z")) / num(pixel), (F.col("z") - F.col(down)) / num(pixel), F.lit(0.0))
    gx, gy = slope("e", "w"), slope("s", "n")
    length = F.sqrt(gx * gx + gy * gy + 1)
    return zs.select(*keys, "row", "col", (-gx / length).alias("nx"), (-gy / length).alias("ny"), (1 / length).alias("nz"))


def halo(tiles: DataFrame, zoom: int, pad: int) -> DataFrame:
    """(z, x, y, dx, dy, tile columns): each tile beside its neighbours up to `pad` away; x wraps, y is held at the poles."""
    n = 1 << zoom
    steps = F.sequence(F.lit(-pad), F.lit(pad))
    want = tiles.select("x", "y").select("x", "y", F.explode(steps).alias("dx")).select("x", "y", "dx", F.explode(steps).alias("dy"))
    want = want.withColumns({"nx": F.pmod(F.col("x") + F.col("dx"), F.lit(n)), "ny": F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col("y") + F.col("dy")))})
    given = tiles.select(F.col("x").alias("nx"), F.col("y").alias("ny"), *[c for c in tiles.columns if c not in ("x", "y")])
    return want.join(given, ["nx", "ny"])


def valid(z: Column, nodata: Column | float | None = None, alpha: Column | None = None) -> Column:
    """Whether a sample is a height: finite, not the file's no-data value, and not masked by an alpha of nothing."""
    good = z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf"))
    if nodata is not None:
        missing = num(nodata)
        good = good & ~F.coalesce(F.abs(z - missing) <= 1e-8 + 1e-5 * F.abs(missing), F.lit(False))
    return good if alpha is None else good & ~F.isnan(alpha) & (F.coalesce(alpha, F.lit(1.0)) > 0)


def overlay(base: DataFrame, over: DataFrame, keys: list[str], nodata: float | None = None, alpha: str | None = None) -> DataFrame:
    """The base raster with the values of another where that has a valid one."""
    good = valid(F.col("z"), nodata, F.col(alpha) if alpha else None)
    return base.join(over.filter(good).select(*keys, F.col("z").alias("__z")), keys, "left").withColumn("z", F.coalesce("__z", "z")).drop("__z")


def overlay_coded(base: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """A base raster of coded colours (r, g, b, a) with another's heights, coded too and opaque, where they are valid."""
    from ..functions.terrain import encode

    joined = base.join(over.filter(valid(F.col("z"))).select(*keys, F.col("z").alias("__z")), keys, "left")
    coded = [*encode(F.col("__z")), F.lit(255)]
    return joined.withColumns({c: F.when(F.col("__z").isNotNull(), v).otherwise(F.col(c)).cast("int") for c, v in zip("rgba", coded, strict=True)}).drop("__z")


def reproject(target: DataFrame, source: DataFrame, keys: list[str], col: Column, row: Column, width: int, height: int, scale: float = 1.0) -> DataFrame:
    """target with z of a source raster (keys, row, col, z, valid) at fractional (col, row): only where all four around are valid.

    Places outside the samples' centres, and next to one that isn't valid, have no value.
    """
    inside = (col >= 0) & (row >= 0) & (col <= max(width - 1, 0)) & (row <= max(height - 1, 0))
    c0, r0 = F.floor(col), F.floor(row)
    out = target.withColumns({"__in": inside, "__c0": c0, "__r0": r0, "__c1": F.least(c0 + 1, F.lit(width - 1)), "__r1": F.least(r0 + 1, F.lit(height - 1)), "__fc": col - c0, "__fr": row - r0})
    good = source.filter(F.col("valid") & valid(F.col("z")))
    for k, (r, c) in enumerate((("__r0", "__c0"), ("__r0", "__c1"), ("__r1", "__c0"), ("__r1", "__c1"))):
        out = out.join(good.select(*keys, F.col("row").alias(r), F.col("col").alias(c), F.col("z").alias(f"__z{k}")), [*keys, r, c], "left")
    z = [F.col(f"__z{k}") for k in range(4)]
    top, low = z[0] + (z[1] - z[0]) * F.col("__fc"), z[2] + (z[3] - z[2]) * F.col("__fc")
    return out.select(*target.columns, F.when(F.col("__in"), (top + (low - top) * F.col("__fr")) * scale).alias("z"))


def level_for(cols: Column, rows: Column, size: int, levels: int) -> Column:
    """The level of a pyramid to sample where a tile of `size` spans so many columns and rows of the raster."""
    over = F.greatest(cols / max(size, 1), rows / max(size, 1), F.lit(1.0))
    return F.least(F.lit(levels - 1), F.floor(F.log2(over))).cast("int")


def sample_tiles(points: DataFrame, tiles: DataFrame, zoom: int, size: int, nearest: bool = False) -> DataFrame:
    """points (x, y in metres) with the height of the map tile that holds them: bilinear between samples, or that of the pixel.

    tiles: tx, ty, row, col, z. Bilinear places run from the first sample to the last over the whole tile. A point
    without a tile has none. Metres are too coarse to place a point on an edge: within a billionth of the next tile, or of
    the next pixel, it is in that one.
    """
    from ..functions.geo import WORLD

    side, near = WORLD / (1 << zoom), 1e-9
    fx, fy = (F.col("x") + WORLD / 2) / side, (WORLD / 2 - F.col("y")) / side
    within = lambda f: F.greatest(f - F.floor(f + near), F.lit(0.0)) * (size - (0 if nearest else 1))
    placed = points.withColumns({"tx": F.floor(fx + near), "ty": F.floor(fy + near), "__px": within(fx), "__py": within(fy)})
    if nearest:
        at = placed.withColumns({"row": F.floor(F.col("__py") + near), "col": F.floor(F.col("__px") + near)})
        return at.join(tiles.select("tx", "ty", "row", "col", "z"), ["tx", "ty", "row", "col"], "left").select(*points.columns, "z")
    return sample_bilinear(placed, tiles, ["tx", "ty"], F.col("__px"), F.col("__py"), size).select(*points.columns, "z")


def horn(raster: DataFrame, keys: list[str], pixel: Column | float) -> DataFrame:
    """(keys, row, col, gx, gy) by Horn's kernel where all nine heights are known; rows count southwards, gy points north."""
    near = _around(raster.select(*keys, "row", "col", "z"), keys, lambda r, c: 1)
    # (dr, dc) leads from the neighbour to the cell, so the neighbour lies the other way.
    wx, wy = -F.col("dc") * (2 - F.abs(F.col("dr"))), F.col("dr") * (2 - F.abs(F.col("dc")))
    sums = near.filter("of_z IS NOT NULL").groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("of_z") * wx) / (8 * num(pixel))).alias("gx"), (F.sum(F.col("of_z") * wy) / (8 * num(pixel))).alias("gy"))
    return sums.filter("n = 9").drop("n")


def contour_direction(raster: DataFrame, keys: list[str], group: list[str], pixel: Column | float, least: int = 10) -> DataFrame:
    """(group, samples, contour, dispersion): the mean direction of contours of a group's steep pixels; null under `least` of them."""
    from ..functions.angles import circular_dispersion, circular_mean

    g = horn(raster, keys, pixel).filter(F.hypot("gx", "gy") >= 1e-6)
    theta = F.pmod(F.degrees(F.atan2(-F.col("gy"), F.col("gx"))), F.lit(360.0))
    f = g.withColumn("__t", theta).groupBy(*group).agg(F.count(F.lit(1)).alias("samples"), circular_mean(F.col("__t"), F.lit(1.0)).alias("contour"), circular_dispersion(F.col("__t")).alias("dispersion"))
    enough = F.col("samples") >= least
    return f.select(*group, "samples", F.when(enough, F.col("contour")).alias("contour"), F.when(enough, F.col("dispersion")).alias("dispersion"))


def heat_image(raster: DataFrame, value: str, kind: str, low: float, high: float) -> DataFrame:
    """raster with r, g, b, a: overlap (0 to high), resolution or density (low to high) as colours; what has no value is clear.

    Poor is warm: much overlap is warm too, a fine resolution cool, a dense cloud cool.
    """
    from ..functions.terrain import heat_colour

    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    shown = {"overlap": finite & (v != 0), "resolution": finite, "density": finite & (v > 0)}[kind]
    lo = max(0.0, low)
    part = (v - lo) / (max(lo + 1e-6, high) - lo)
    t = {"overlap": v / max(1.0, high), "resolution": part, "density": 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))}[kind]
    c = heat_colour(t)
    return raster.withColumns({k: F.when(shown, c[k]).otherwise(0).cast("int") for k in "rgb"} | {"a": F.when(shown, 200).otherwise(0)})


def ellipsoid_heights(raster: DataFrame, geoid: DataFrame, lng: Column, lat: Column, step: float) -> DataFrame:
    """raster with z above the ellipsoid: the geoid's undulation, bilinear in a table (row, col, z) of `step` degrees from (-180, 90), is added.

    The table is an input; where it has no value nothing is added.
    """
    cols, rows = int(round(360 / step)), int(round(180 / step)) + 1
    at = raster.withColumns({"__gc": (lng + 180) / step, "__gr": (90 - lat) / step}).withColumnRenamed("z", "__height")
    wrapped = geoid.unionByName(geoid.filter(F.col("col") == 0).withColumn("col", F.lit(cols).cast(geoid.schema["col"].dataType)))
    found = sample_bilinear(at, F.broadcast(wrapped) if cols * rows <= 1 << 20 else wrapped, [], F.col("__gc"), F.col("__gr"), max(cols + 1, rows), name="__u")
    return found.withColumn("z", F.col("__height") + F.coalesce("__u", F.lit(0.0))).drop("__gc", "__gr", "__u", "__height")


def write_pyramid(levels: DataFrame, path: str) -> None:
    """A pyramid's levels as tables by level, which a reader of one level finds without the others."""
    levels.write.mode("overwrite").partitionBy("level").parquet(path)


def polygon_mask(rings: DataFrame, keys: list[str], group: list[str], size: int, erosion: int = 0) -> DataFrame:
    """(group, row, col): the union of the eroded masks of a group's rings, given in pixels."""
    from .generators import rasterize

    return erode(rasterize(rings, keys, size), keys, size, erosion).select(*group, "row", "col").distinct()
