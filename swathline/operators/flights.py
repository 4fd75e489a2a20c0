"""Flights over areas: ordered sweeps, their heights, turns between them, and ways from one area to another.

Sweeps are straight lines in an area's own frame: `along` its bearing and `cross` to its right, in metres about the mean of its corners.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .generators import sweep_lines

#: Metres between samples of the ground, clearance beside that asked for, and slack of a band.
SAMPLE, MARGIN, SLACK = 30.0, 20.0, 0.5
#: Fixed values of turning: damping and period of the guidance, seconds of speed and of roll, gravity, share of the yaw, most roll.
DAMPING, PERIOD, SPEED_LAG, ROLL_FREQUENCY, ROLL_DAMPING, GRAVITY, YAW, MOST_ROLL = 0.75, 15.0, 2.0, 3.0, 0.8, 9.80665, 0.93, math.radians(40)


def sweeps(rings: DataFrame, keys: list[str], bearing: float, spacing: float) -> DataFrame:
    """(keys, seq, line, start, end, cross, x1, y1, x2, y2): the sweeps of areas in the order flown, every other one backwards.

    Stretches of a line count as one sweep, from the first to the last; lines that miss the ring don't alternate.
    """
    lines = sweep_lines(rings, keys, bearing, spacing).groupBy(*keys, "line").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    s = lines.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy("line")) - 1)
    forward, b, n = F.col("seq") % 2 == 0, math.radians(bearing), F.size("ring")
    s = s.select(*keys, "seq", "line", F.when(forward, F.col("lo")).otherwise(F.col("hi")).alias("start"), F.when(forward, F.col("hi")).otherwise(F.col("lo")).alias("end"), (F.col("line") * spacing).alias("cross"))
    middle = rings.select(*keys, *[(F.aggregate("ring", F.lit(0.0), lambda t, p: t + p[c]) / n).alias(f"__{c}") for c in "xy"])  # noqa: B023
    x = lambda a: F.col("__x") + F.col(a) * math.sin(b) + F.col("cross") * math.cos(b)
    y = lambda a: F.col("__y") + F.col(a) * math.cos(b) - F.col("cross") * math.sin(b)
    return s.join(middle, keys).select(*s.columns, x("start").alias("x1"), y("start").alias("y1"), x("end").alias("x2"), y("end").alias("y2"))


def heights(flown: DataFrame, keys: list[str], ground: Callable[[Column, Column], Column], agl: float, clearance: float, mode: str = "legacy") -> DataFrame:
    """flown sweeps with `low`, `high` and `z`: the ground under each, and the height that it is flown at.

    The ground counts under a sweep, and where it turns from the one before and to the next: legacy heights are `agl` over its
    highest; min-clearance ones `agl` over its own lowest, or the clearance and a margin over the highest, whichever is more.
    """
    n = F.greatest(F.lit(2), F.ceil(F.abs(F.col("end") - F.col("start")) / SAMPLE).cast("int") + 1)
    at = lambda t: ground(F.col("x1") + (F.col("x2") - F.col("x1")) * t, F.col("y1") + (F.col("y2") - F.col("y1")) * t)
    zs = F.transform(F.sequence(F.lit(0), n - 1), lambda k: at(k / (n - 1)))
    s = flown.withColumns({"low": F.array_min(zs), "__high": F.array_max(zs), "__first": at(F.lit(0.0)), "__last": at(F.lit(1.0))})
    w = Window.partitionBy(*keys).orderBy("seq")
    s = s.withColumn("high", F.greatest("__high", F.lag("__last").over(w), F.lead("__first").over(w)))
    z = F.col("high") + agl if mode == "legacy" else F.greatest(F.col("low") + agl, F.col("high") + clearance + MARGIN)
    return s.withColumn("z", z).drop("__high", "__first", "__last")


def traversals(lifted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, flip, x1, y1, z1, x2, y2, z2): where an area's flight begins and ends, flown as it is and backwards."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col("z").alias("z"))
    ends = lifted.groupBy(*keys).agg(F.min_by(point("x1", "y1"), "seq").alias("a"), F.max_by(point("x2", "y2"), "seq").alias("b"))
    way = lambda flip, p, q: F.struct(F.lit(flip).alias("flip"), *[F.col(f"{s}.{c}").alias(f"{c}{i}") for i, s in ((1, p), (2, q)) for c in "xyz"])
    return ends.select(*keys, F.explode(F.array(way(0, "a", "b"), way(1, "b", "a"))).alias("w")).select(*keys, "w.*")


def turn_points(flown: DataFrame, keys: list[str], bearing: float, radius: float, distance: float = 80.0) -> DataFrame:
    """(keys, seq, end, off, loiter, next): from every sweep's end straight on to where it turns off, about which centre, to the next start.

    The centre lies half way between the two sweeps, or the radius aside where they are nearer than its double.
    """
    w, b = Window.partitionBy(*keys).orderBy("seq"), math.radians(bearing)
    s = flown.withColumns({"__nx": F.lead("x1").over(w), "__ny": F.lead("y1").over(w), "__side": F.lead("cross").over(w) - F.col("cross")}).filter("__nx IS NOT NULL")
    on, aside = F.signum(F.col("end") - F.col("start")) * distance, F.greatest(F.abs("__side") / 2, F.lit(radius)) * F.signum("__side")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    off_x, off_y = F.col("x2") + on * math.sin(b), F.col("y2") + on * math.cos(b)
    return s.select(*keys, "seq", point(F.col("x2"), F.col("y2")).alias("end"), point(off_x, off_y).alias("off"), point(off_x + aside * math.cos(b), off_y - aside * math.sin(b)).alias("loiter"), point(F.col("__nx"), F.col("__ny")).alias("next"))


def leads(options: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """(keys, flip, in_x, in_y, out_x, out_y): centres of the circles that lead into an area's flight and out of it, to the right of its way."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.greatest(F.hypot(dx, dy), F.lit(1e-9))
    right = dy / length * radius, -dx / length * radius
    return options.select(*keys, "flip", *[(F.col(f"{c}{i}") + r).alias(f"{n}_{c}") for n, i in (("in", 1), ("out", 2)) for c, r in zip("xy", right, strict=True)])


def tangent_length(x1: Column, y1: Column, x2: Column, y2: Column, radius: Column | float, crossed: bool = False) -> Column:
    """Metres of the straight part between two circles of one radius: along their common tangent, or the one that crosses between them."""
    d = F.hypot(x2 - x1, y2 - y1)
    return F.sqrt(F.greatest(F.lit(0.0), d * d - 4 * F.lit(float(radius)) ** 2)) if crossed else d


def ways(pairs: DataFrame, keys: list[str], ground: Callable[[Column, Column], Column], clearance: float, height: float, speed: float = 16.0, up: float = 4.0, down: float = 3.0) -> DataFrame:
    """(keys, strategy, z, metres, seconds, cost, worst) of ways from (x1, y1, z1) to (x2, y2, z2), straight and sampled each 30 m.

    `level`: all of the way fits between the clearance and the greatest height over ground at the height of its ends; `adjusted`: at
    another height; `stepped`: height follows the ground, as one height doesn't fit; `direct`: not even that fits, or the ground
    isn't known. A way climbs and descends over its ends. worst: metres outside the band, null for unknown ground.
    """
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n = F.greatest(F.lit(2), F.ceil(length / SAMPLE).cast("int") + 1)
    at = lambda t: ground(F.col("x1") + (F.col("x2") - F.col("x1")) * t, F.col("y1") + (F.col("y2") - F.col("y1")) * t)
    p = pairs.withColumns({"metres": length, "__g": F.transform(F.sequence(F.lit(0), n - 1), lambda k: at(k / (n - 1)))})
    known = ~F.exists("__g", lambda g: g.isNull() | F.isnan(g))
    p = p.withColumns({"__known": known, "__floor": F.array_max("__g") + clearance - SLACK, "__roof": F.array_min("__g") + height + SLACK})
    floor, roof, own = F.col("__floor"), F.col("__roof"), F.greatest("z1", "z2")
    inside = (own >= floor) & (own <= roof)
    steps = F.transform("__g", lambda g: g + clearance)
    # Between two samples the ground can rise and fall by what the band is wide, at most.
    climbs = F.aggregate(F.sequence(F.lit(1), F.size("__g") - 1), F.lit(0.0), lambda m, i: F.greatest(m, F.abs(F.get("__g", i) - F.get("__g", i - 1))))
    strategy = F.when(~F.col("__known"), "direct").when(inside, "level").when(floor <= roof, "adjusted").when(climbs <= height - clearance, "stepped").otherwise("direct")
    p = p.withColumn("strategy", strategy)
    z = F.when(F.col("strategy") == "adjusted", F.greatest(floor, F.least(roof, own))).otherwise(own)
    rise = F.when(F.col("strategy") == "stepped", F.aggregate(F.sequence(F.lit(1), F.size("__g") - 1), F.lit(0.0), lambda s, i: s + F.greatest(F.lit(0.0), F.get(steps, i) - F.get(steps, i - 1))))
    p = p.withColumns({"z": z, "__rise": F.coalesce(rise, F.lit(0.0))})
    climb = F.greatest(F.lit(0.0), F.col("z") - F.col("z1")) + F.greatest(F.lit(0.0), F.col("z2") - F.col("z")) + F.col("__rise")
    fall = F.greatest(F.lit(0.0), F.col("z1") - F.col("z")) + F.greatest(F.lit(0.0), F.col("z") - F.col("z2")) + F.col("__rise")
    worst = F.when(F.col("__known"), F.greatest(F.lit(0.0), floor - F.col("z"), F.col("z") - roof))
    return p.select(*keys, "strategy", "z", "metres", F.greatest(F.col("metres") / speed, climb / up, fall / down).alias("seconds"), (F.col("metres") / speed + 2.5 * climb / up + 0.6 * fall / down).alias("cost"), F.when(F.col("strategy") == "stepped", 0.0).otherwise(worst).alias("worst"))


def simulate_turn(end: tuple, off: tuple, loiter: tuple, after: tuple, heading: float, radius: float, speed: float, step: float = 0.02, most: float = 300.0) -> list[tuple[float, float, float]] | None:
    """The path (x, y, seconds) of an aircraft from a sweep's end, straight on to where it turns off, around a circle, to the next start.

    Guidance steers for a point ahead on the way; the roll follows it as a damped oscillation, the turn follows the roll. None if the
    next start isn't reached within `most` seconds.
    """
    x, y = end
    roll = rate = t = 0.0
    path, stage = [(x, y, 0.0)], "on"
    ahead, gain = DAMPING * PERIOD / math.pi, 4 * DAMPING**2
    side = math.copysign(1.0, (loiter[0] - off[0]) * math.cos(heading) - (loiter[1] - off[1]) * math.sin(heading))
    start = heading
    while t < most:
        reach = max(1.0, ahead * speed)
        if stage == "on":
            to = off[0] + math.sin(start) * reach, off[1] + math.cos(start) * reach
            if (x - off[0]) * math.sin(start) + (y - off[1]) * math.cos(start) >= 0:
                stage = "round"
        if stage == "round":
            angle = math.atan2(x - loiter[0], y - loiter[1]) + side * reach / radius
            to = loiter[0] + radius * math.sin(angle), loiter[1] + radius * math.cos(angle)
            if math.cos(heading - math.atan2(after[0] - x, after[1] - y)) > 0.98:
                stage = "to"
        if stage == "to":
            to = after
            if math.hypot(x - after[0], y - after[1]) < max(5.0, speed * 0.5):
                return [*path, (after[0], after[1], t)]
        bearing = math.atan2(to[0] - x, to[1] - y) - heading
        wanted = math.atan(gain * speed * speed / reach * math.sin(math.atan2(math.sin(bearing), math.cos(bearing))) / GRAVITY)
        wanted = max(-MOST_ROLL, min(MOST_ROLL, wanted))
        rate += (ROLL_FREQUENCY**2 * (wanted - roll) - 2 * ROLL_DAMPING * ROLL_FREQUENCY * rate) * step
        roll += rate * step
        heading += YAW * GRAVITY * math.tan(roll) / max(speed, 1.0) * step
        x, y, t = x + speed * math.sin(heading) * step, y + speed * math.cos(heading) * step, t + step
        path.append((x, y, t))
    return None


def turn_previews(turns: DataFrame, keys: list[str], bearing: float, radius: float, speed: float) -> DataFrame:
    """(keys, seq, metres, seconds, reached) of every turn as flown; turns are flown one by one, rows in and rows out."""

    def work(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                p = [(r[n]["x"], r[n]["y"]) for n in ("end", "off", "loiter", "next")]
                way = math.atan2(p[1][0] - p[0][0], p[1][1] - p[0][1])
                path = simulate_turn(*p, way, max(radius, math.dist(p[1], p[2])), speed)
                metres = float(np.hypot(*np.diff(np.array(path)[:, :2], axis=0).T).sum()) if path else None
                out.append({**{k: r[k] for k in (*keys, "seq")}, "metres": metres, "seconds": path[-1][2] if path else None, "reached": path is not None})
            yield pd.DataFrame(out, columns=[*keys, "seq", "metres", "seconds", "reached"])

    own = "".join(f"`{k}` {turns.schema[k].dataType.simpleString()}, " for k in keys)
    return turns.mapInPandas(work, f"{own}seq int, metres double, seconds double, reached boolean")
