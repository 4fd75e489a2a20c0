"""Bearings and axes in degrees, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """x within [low, high]; NaN is the largest value here, so it becomes `high`: filter it first where that matters."""
    return F.greatest(num(low), F.least(num(high), x))


def axial(x: Column) -> Column:
    """The axis of a bearing, in [0, 180)."""
    return F.pmod(x, F.lit(180.0))


def axial_delta(a: Column, b: Column | float) -> Column:
    """The angle between two axes, at most 90."""
    d = F.abs(axial(a) - axial(num(b)))
    return F.least(d, 180.0 - d)


def circular_delta(a: Column, b: Column | float) -> Column:
    """The angle between two directions, at most 180."""
    d = F.abs(F.pmod(a, F.lit(360.0)) - F.pmod(num(b), F.lit(360.0)))
    return F.least(d, 360.0 - d)


def from_convention(angle: Column, convention: Column) -> Column:
    """A bearing clockwise from north; `eastCW` angles count from east, any other from north."""
    return F.pmod(F.when(convention == "eastCW", 90.0 - angle).otherwise(angle), F.lit(360.0))


def _vector(angle: Column, weight: Column, factor: float) -> tuple[Column, Column, Column]:
    good = (weight > 0) & ~F.isnan(angle) & (F.abs(angle) < math.inf)
    rad = F.radians(angle * factor)
    pick = lambda v: F.sum(F.when(good, v))
    return pick(F.sin(rad) * weight), pick(F.cos(rad) * weight), pick(weight)


def axial_mean(angle: Column, weight: Column) -> Column:
    """Aggregate: the weighted mean axis by doubled angles; null without weight."""
    s, c, total = _vector(axial(angle), weight, 2.0)
    return F.when(total > 0, axial(F.degrees(F.atan2(s, c)) / 2.0))


def circular_mean(angle: Column, weight: Column) -> Column:
    """Aggregate: the weighted mean direction in [0, 360); null without weight."""
    s, c, total = _vector(angle, weight, 1.0)
    return F.when(total > 0, F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)))


def circular_dispersion(angle: Column) -> Column:
    """Aggregate: one less the length of the mean vector."""
    rad = F.radians(angle)
    return 1.0 - F.sqrt(F.pow(F.avg(F.sin(rad)), F.lit(2)) + F.pow(F.avg(F.cos(rad)), F.lit(2)))


def circular_median(angles: Column) -> Column:
    """Of an array of directions in [0, 360): the element half the array's length on from the start of the narrowest arc.

    An arc starts at an element and holds those after it, around the circle, within 180 degrees; the first of equally
    narrow ones counts. Null for an empty array.
    """
    turned = F.array_sort(angles)
    n = F.size(turned)
    twice = F.concat(turned, F.transform(turned, lambda a: a + 360.0))
    within = lambda i: F.array_max(F.filter(F.slice(twice, i + 1, n), lambda a: a - F.get(twice, i) <= 180.0))
    spans = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((within(i) - F.get(twice, i)).alias("span"), i.alias("i")))
    return F.when(n > 0, F.pmod(F.get(twice, F.array_min(spans)["i"] + (n / 2).cast("int")), F.lit(360.0)))
