"""Missions of several areas: connections between them, and the order in which they are flown."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Areas of a mission up to which the order is the cheapest of all; beyond it, a good one.
EXACT_AREAS = 17


def connections(areas: DataFrame, keys: list[str], name: str, speed: float, up: float, down: float) -> DataFrame:
    """(keys, name, to_area, flip, to_flip, metres, seconds, cost) for every ordered pair of a mission's areas, each flown either way.

    areas: keys, name, half (degrees), x (metres of the middle), z. An area flown forward ends half its length on, flipped
    half before; seconds are those of the slowest of flying, climbing and descending, cost weighs climbs 2.5, descents 0.6.
    Pairs meet by mission, so a mission's areas squared are made and no more.
    """
    a = areas.select(*keys, name, "x", "half", "z", F.explode(F.array(F.lit(0), F.lit(1))).alias("flip"))
    b = a.select(*keys, F.col(name).alias("to_area"), F.col("x").alias("__x"), F.col("half").alias("__half"), F.col("z").alias("__z"), F.col("flip").alias("to_flip"))
    both = a.join(b, keys).filter(F.col(name) != F.col("to_area"))
    sign = lambda flip: F.when(F.col(flip) == 0, 1.0).otherwise(-1.0)
    metres = F.abs(F.col("x") + sign("flip") * F.col("half") * 75000 - F.col("__x") + sign("to_flip") * F.col("__half") * 75000)
    rise = F.col("__z") - F.col("z")
    climb, fall = F.greatest(rise, F.lit(0.0)) / up, F.greatest(-rise, F.lit(0.0)) / down
    return both.select(*keys, name, "to_area", "flip", "to_flip", metres.alias("metres"), F.greatest(metres / speed, climb, fall).alias("seconds"), (metres / speed + 2.5 * climb + 0.6 * fall).alias("cost"))


def cheapest_path(cost: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[float, list[int]]:
    """The cheapest way through n areas by dynamic programming over sets: (cost, [2 area + flip, ...]).

    cost[i, j] leads from state i = 2 area + flip to j. All sets of one size advance together, as arrays: sets times states,
    so 17 areas take 2^17 times 34 numbers.
    """
    states = len(start)
    n = states // 2
    best = np.full((1 << n, states), np.inf)
    came = np.full((1 << n, states), -1, np.int16)
    own = 1 << (np.arange(states) // 2)
    best[own, np.arange(states)] = start
    sets = np.arange(1 << n)
    size = np.zeros(1 << n, np.int64)
    for k in range(n):
        size += sets >> k & 1
    for k in range(1, n):
        now = sets[size == k]
        for j in range(states):
            free = now[(now & own[j]) == 0]
            by = best[free] + cost[:, j]
            i = by.argmin(axis=1)
            best[free | own[j], j], came[free | own[j], j] = by[np.arange(len(free)), i], i
    last = int((best[-1] + end).argmin())
    total, path, at = float(best[-1, last] + end[last]), [last], (1 << n) - 1
    while came[at, path[-1]] >= 0:
        at, before = at & ~int(own[path[-1]]), int(came[at, path[-1]])
        path.append(before)
    return total, path[::-1]


def good_path(cost: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[float, list[int]]:
    """A way through many areas: each put where it costs least, then flips and swaps while they help."""
    n = len(start) // 2

    def total(p: list[int]) -> float:
        return float(start[p[0]] + sum(cost[a, b] for a, b in itertools.pairwise(p)) + end[p[-1]])

    left, path = set(range(n)), []
    while left:
        options = [(total([*path[:k], 2 * a + f, *path[k:]]), a, f, k) for a in sorted(left) for f in (0, 1) for k in range(len(path) + 1)]
        _, a, f, k = min(options)
        path.insert(k, 2 * a + f)
        left.remove(a)
    at, better = total(path), True
    while better:
        flips = [[*path[:k], path[k] ^ 1, *path[k + 1 :]] for k in range(n)]
        swaps = [[path[j] if x == i else path[i] if x == j else p for x, p in enumerate(path)] for i, j in itertools.combinations(range(n), 2)]
        to = min(flips + swaps, key=total, default=path)
        better = total(to) < at - 1e-9
        if better:
            path, at = to, total(to)
    return at, path


def sequence(links: DataFrame, ends: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, place, name, flip, cost): the order in which each mission's areas are flown, and what it costs in all.

    links: keys, name, flip, to_area, to_flip, cost, as `connections` gives; ends: keys, name, flip, start, end, the costs of
    beginning and of ending with an area, one row a way round. A mission is one group of a bounded number of areas:
    exact up to EXACT_AREAS of them.
    """

    def order(own: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
        out = {**{k: [] for k in keys}, "place": [], name: [], "flip": [], "cost": []}
        if len(ways):
            names = sorted(ways[name].unique())
            at = {a: 2 * i for i, a in enumerate(names)}
            cost, start, end = np.full((2 * len(names),) * 2, np.inf), np.zeros(2 * len(names)), np.zeros(2 * len(names))
            cost[own[name].map(at).to_numpy(int) + own["flip"].to_numpy(int), own["to_area"].map(at).to_numpy(int) + own["to_flip"].to_numpy(int)] = own["cost"]
            state = ways[name].map(at).to_numpy(int) + ways["flip"].to_numpy(int)
            start[state], end[state] = ways["start"], ways["end"]
            total, path = (cheapest_path if len(names) <= EXACT_AREAS else good_path)(cost, start, end)
            out = {**{k: [ways[k].iloc[0]] * len(path) for k in keys}, "place": range(len(path)), name: [names[s // 2] for s in path], "flip": [s % 2 for s in path], "cost": [total] * len(path)}
        return pd.DataFrame(out)

    # Columns of their own, as both sides may come from the same areas.
    links = links.select(*[F.col(c).alias(c) for c in links.columns])
    ends = ends.select(*[F.col(c).alias(c) for c in ends.columns])
    fields = ", ".join(f"`{k}` {ends.schema[k].dataType.simpleString()}" for k in keys)
    return links.groupBy(*keys).cogroup(ends.groupBy(*keys)).applyInPandas(order, f"{fields}, place int, `{name}` {ends.schema[name].dataType.simpleString()}, flip int, cost double")
