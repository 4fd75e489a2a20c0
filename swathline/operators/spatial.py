"""Joins by place: everything within reach becomes an equi-join on grid cells and a residual test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import num
from ..functions.geo import in_ring


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def contains(shapes: DataFrame, points: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Every pair of a shape (keys, ring) and a point (x, y) inside it.

    Shapes are put into each cell of their box, points into theirs; `size` is about the side of a usual shape, so that
    it lies in a few cells. A point that lies in several shapes makes several pairs.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    s = shapes.select(*keys, "ring", F.array_min(xs).alias("__x0"), F.array_max(xs).alias("__x1"), F.array_min(ys).alias("__y0"), F.array_max(ys).alias("__y1"))
    s = s.withColumn("__cx", _cells(F.col("__x0"), F.col("__x1"), size)).withColumn("__cy", _cells(F.col("__y0"), F.col("__y1"), size))
    p = points.withColumns({"__cx": F.floor(F.col("x") / size), "__cy": F.floor(F.col("y") / size)})
    inside = in_ring(F.col("x"), F.col("y"), F.col("ring"))
    box = F.col("x").between(F.col("__x0"), F.col("__x1")) & F.col("y").between(F.col("__y0"), F.col("__y1"))
    return s.join(p, ["__cx", "__cy"]).filter(box & inside).drop("__cx", "__cy", "__x0", "__x1", "__y0", "__y1", "ring")


def within(left: DataFrame, right: DataFrame, radius: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs of rows with x, y at most `radius` apart (of equal keys), the right ones' columns as r_..., and the distance.

    Cells are as wide as the radius; the left side is copied to the nine around it, so each pair meets once. Both sides grow with
    their tables, so they are shuffled and merged by cell; neither is broadcast.
    """
    keys = keys or []
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = left.withColumn("__s", around).withColumns({"__cx": cell("x") + F.col("__s.i"), "__cy": cell("y") + F.col("__s.j")}).drop("__s")
    b = right.withColumns({"__cx": cell("x"), "__cy": cell("y")})
    b = b.select("__cx", "__cy", *keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    d = F.hypot(F.col("x") - F.col("r_x"), F.col("y") - F.col("r_y"))
    return a.join(b.hint("merge"), ["__cx", "__cy", *keys]).withColumn("distance", d).filter(F.col("distance") <= radius).drop("__cx", "__cy")


def strips_to_tiles(strips: DataFrame, keys: list[str], reach: Column | float, side: float) -> DataFrame:
    """(keys, tx, ty): the tiles of `side` metres that each strip (x1, y1, x2, y2) can affect, its box and `reach` around; touching counts."""
    r = num(reach)
    span = lambda a, b: F.explode(F.sequence((F.ceil((F.least(a, b) - r) / side) - 1).cast("long"), F.floor((F.greatest(a, b) + r) / side).cast("long")))
    return strips.withColumn("tx", span(F.col("x1"), F.col("x2"))).withColumn("ty", span(F.col("y1"), F.col("y2"))).select(*keys, "tx", "ty")


def clip_to_box(x1: Column, y1: Column, x2: Column, y2: Column, box: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Liang and Barsky: the part (from, to) of a segment, as fractions of it, inside a box; null if none."""
    lo, hi = F.lit(0.0), F.lit(1.0)
    missed = F.lit(False)
    for p, q in ((x1 - x2, x1 - box[0]), (x2 - x1, box[2] - x1), (y1 - y2, y1 - box[1]), (y2 - y1, box[3] - y1)):
        t = q / F.when(p != 0, p)
        lo = F.when(p < 0, F.greatest(lo, t)).otherwise(lo)
        hi = F.when(p > 0, F.least(hi, t)).otherwise(hi)
        missed = missed | ((p == 0) & (q < 0))
    return F.when(~missed & (lo <= hi), lo), F.when(~missed & (lo <= hi), hi)


def views(pixels: DataFrame, poses: DataFrame, cameras: DataFrame, size: float) -> DataFrame:
    """(pixel, pose, gsd): which ground pixels (pixel, x, y, z, nx, ny, nz) which camera poses see, and how finely.

    poses: pose, camera, x, y, z, ground, r11 ... r33; cameras: seq, f_m, sx_m, sy_m, w_px, h_px, a registry. A camera's number
    that is none counts as the first. A pose reaches as far as half its image's diagonal on the ground and a quarter more; it
    is put into every grid cell in reach, pixels into theirs. Pairs that pass the frustum and face the camera stay; the
    resolution is that of the exact Jacobian of the image on the local plane, in the camera's own frame.
    """
    registry = F.broadcast(cameras.select(F.col("seq").alias("__camera"), "f_m", "sx_m", "sy_m", "w_px", "h_px"))
    known = cameras.count()
    p = poses.withColumn("__camera", F.when(F.col("camera").between(0, known - 1), F.col("camera")).otherwise(0).cast("int")).join(registry, "__camera")
    half = F.hypot(F.col("w_px") * F.col("sx_m"), F.col("h_px") * F.col("sy_m")) / 2 / F.col("f_m") * 1.25
    p = p.select("pose", *[F.col(c).alias(f"p_{c}") for c in ("x", "y", "z")], *[f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)], "f_m", "sx_m", "sy_m", "w_px", "h_px", (F.greatest(F.lit(1.0), F.col("z") - F.col("ground")) * half).alias("reach"))
    p = p.withColumn("__cx", _cells(F.col("p_x") - F.col("reach"), F.col("p_x") + F.col("reach"), size)).withColumn("__cy", _cells(F.col("p_y") - F.col("reach"), F.col("p_y") + F.col("reach"), size))
    g = pixels.select("pixel", "x", "y", "z", "nx", "ny", "nz", F.floor(F.col("x") / size).alias("__cx"), F.floor(F.col("y") / size).alias("__cy"))
    d = {c: F.col(c) - F.col(f"p_{c}") for c in ("x", "y", "z")}
    near = g.join(p, ["__cx", "__cy"]).filter(d["x"] * d["x"] + d["y"] * d["y"] <= F.col("reach") * F.col("reach"))
    # The ray and the normal in the camera's frame; each stage names the one before once, so the code stays small.
    turned = lambda v, j: F.col(f"r1{j}") * v[0] + F.col(f"r2{j}") * v[1] + F.col(f"r3{j}") * v[2]
    ray, normal = (d["x"], d["y"], d["z"]), (F.col("nx"), F.col("ny"), F.col("nz"))
    own = F.struct(*[turned(ray, j).alias(f"c{j}") for j in (1, 2, 3)], *[turned(normal, j).alias(f"n{j}") for j in (1, 2, 3)])
    near = near.select("pixel", "pose", "f_m", "sx_m", "sy_m", "w_px", "h_px", F.explode(F.array(own)).alias("o")).select("pixel", "pose", "f_m", "sx_m", "sy_m", "w_px", "h_px", "o.*").filter("c3 < -1e-9")
    u, v = F.col("f_m") * F.col("c1") / F.col("c3"), F.col("f_m") * F.col("c2") / F.col("c3")
    seen = near.select("*", F.explode(F.array(F.struct(u.alias("u"), v.alias("v"), (-(F.col("n1") * F.col("c1") + F.col("n2") * F.col("c2") + F.col("n3") * F.col("c3"))).alias("away")))).alias("i")).select("*", "i.*").drop("i")
    col, row = F.col("w_px") / 2 - F.col("u") / F.col("sx_m"), F.col("h_px") / 2 - F.col("v") / F.col("sy_m")
    seen = seen.filter((col >= 0) & (col < F.col("w_px")) & (row >= 0) & (row < F.col("h_px")) & (F.col("away") > 1e-3 * F.sqrt(F.col("c1") * F.col("c1") + F.col("c2") * F.col("c2") + F.col("c3") * F.col("c3"))))
    dot = F.col("n1") * F.col("u") + F.col("n2") * F.col("v") + F.col("n3") * F.col("f_m")
    square = F.col("u") * F.col("u") + F.col("v") * F.col("v") + F.col("f_m") * F.col("f_m")
    seen = seen.withColumns({"dot": dot, "square": square}).filter(F.abs("dot") >= 1e-12)
    stretch = lambda n, a: F.sqrt(F.greatest(F.lit(0.0), F.col("dot") * F.col("dot") - 2 * F.col("dot") * F.col(n) * F.col(a) + F.col(n) * F.col(n) * F.col("square"))) * F.abs("away") / (F.col("dot") * F.col("dot"))
    return seen.select("pixel", "pose", F.sqrt(stretch("n1", "u") * F.col("sx_m") * stretch("n2", "v") * F.col("sy_m")).alias("gsd"))


def visible(pixels: DataFrame, poses: DataFrame, cameras: DataFrame, size: float) -> DataFrame:
    """(pixel, overlap, gsd): the number of poses that see a pixel, and the finest resolution of them."""
    return views(pixels, poses, cameras, size).groupBy("pixel").agg(F.count(F.lit(1)).alias("overlap"), F.min("gsd").alias("gsd"))


def hit_ids(seen: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, poses, mark): how many different poses see any pixel of an owner (pixel, keys), and a digest of which."""
    own = seen.select("pixel", "pose").join(owners.select("pixel", *keys), "pixel").select(*keys, "pose").distinct()
    return own.groupBy(*keys).agg(F.count(F.lit(1)).alias("poses"), F.sum(F.col("pose").cast("decimal(38,0)") * (F.col("pose") % 1009 + 1)).cast("long").alias("mark"))


def candidates(tiles: DataFrame, poses: DataFrame, keys: list[str], size: float) -> DataFrame:
    """(keys, poses, all): how many poses (pose, x, y, reach) reach each tile's box (x0, y0, x1, y1); where none does, all count.

    Tiles and reaches meet in grid cells; the count of all poses is one number.
    """
    t = tiles.select(*keys, "x0", "y0", "x1", "y1").withColumn("__cx", _cells(F.col("x0"), F.col("x1"), size)).withColumn("__cy", _cells(F.col("y0"), F.col("y1"), size))
    p = poses.select("pose", "x", "y", "reach").withColumn("__cx", _cells(F.col("x") - F.col("reach"), F.col("x") + F.col("reach"), size)).withColumn("__cy", _cells(F.col("y") - F.col("reach"), F.col("y") + F.col("reach"), size))
    off = lambda v, lo, hi: F.greatest(F.col(lo) - F.col(v), F.col(v) - F.col(hi), F.lit(0.0))
    dx, dy = off("x", "x0", "x1"), off("y", "y0", "y1")
    near = t.join(p, ["__cx", "__cy"]).filter(dx * dx + dy * dy <= F.col("reach") * F.col("reach")).select(*keys, "pose").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    whole = poses.agg(F.count(F.lit(1)).alias("__all"))
    return tiles.select(*keys).join(near, keys, "left").join(F.broadcast(whole)).select(*keys, F.coalesce("__n", "__all").alias("poses"), F.col("__n").isNull().alias("all"))


def at_least(pixels: DataFrame, overlap: int) -> DataFrame:
    """Pixels seen less often than wanted count as not seen."""
    seen = F.col("overlap") >= overlap
    return pixels.withColumns({"gsd": F.when(seen, F.col("gsd")), "overlap": F.when(seen, F.col("overlap")).otherwise(F.lit(0).cast("long"))})
