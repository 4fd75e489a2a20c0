"""Elevations as coded colours, display colours and gradients, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import clamp, num


def decode(red: Column, green: Column, blue: Column) -> Column:
    """Metres from a coded colour."""
    return -10000 + (red * 65536 + green * 256 + blue) * 0.1


def encode(z: Column) -> tuple[Column, Column, Column]:
    """Red, green, blue of an elevation in tenths of a metre, held within 24 bits."""
    v = clamp(F.rint((z + 10000) * 10), 0, (1 << 24) - 1).cast("long")
    return F.shiftright(v, 16).cast("int"), F.shiftright(v, 8).bitwiseAND(F.lit(255)).cast("int"), v.bitwiseAND(F.lit(255)).cast("int")


def heat_colour(t: Column) -> Column:
    """struct<r, g, b>: blue, cyan, green, yellow, red over t from 0 to 1, linear between."""
    t = clamp(t, 0, 1)
    up = lambda start: F.floor(255 * (t - start) / 0.25 + 0.5).cast("int")
    down = lambda start: F.floor(255 * (1 - (t - start) / 0.25) + 0.5).cast("int")
    r = F.when(t < 0.5, 0).when(t < 0.75, up(0.5)).otherwise(255)
    g = F.when(t < 0.25, up(0.0)).when(t < 0.75, 255).otherwise(down(0.75))
    b = F.when(t < 0.25, 255).when(t < 0.5, down(0.25)).otherwise(0)
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def axis_gradient(centre: Column, positive: Column, negative: Column, step: Column | float) -> Column:
    """Rise a metre: central where both neighbours are known, else one-sided, else null. NaN counts as unknown."""
    known = lambda v: F.when(~F.isnan(v), v)
    p, n, step = known(positive), known(negative), num(step)
    return F.coalesce((p - n) / (2 * step), (p - centre) / step, (centre - n) / step)
