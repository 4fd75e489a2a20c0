"""The partition solver: every area's cells split in two, again and again, and the frontier of quality against time.

A search of one area is one task over that area's own cells, whose number its grid bounds; areas are searched side by side. What the
search tries at a node (directions times quantiles, each side at each of its headings) is worked out as arrays.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.scores import CAPTURE, COMPACTNESS, CONVEXITY, LEAST_CHILD, LEAST_REST, LINE_FLOOR, MEAN_CONVEXITY, MOST_OF_TWO, NEAR_MISS, SCALE, TRANSIT

#: Quantiles of a cut, most directions, headings, splits of a node, regions and states of a frontier.
QUANTILES, DIRECTIONS, HEADINGS, SPLITS, MOST_REGIONS, MOST_STATES = (0.20, 0.25, 0.33, 0.40, 0.50, 0.60, 0.67, 0.75, 0.80), 16, 8, 8, 8, 20
#: Least angles between headings and between cuts, seconds between regions and of a region, cost of a further region.
HEADING_APART, CUT_APART, GAP, START, EACH = 9.0, 8.0, 45.0, 25.0, 0.02
#: What a split may lose in quality and in rank, and what its time and its alignment weigh.
MOST_LOSS, LEAST_RANK, RANK_TIME, RANK_ALIGNED, RANK_UNEVEN = 0.03, -0.02, 6000.0, 28.0, 0.2


def _delta(a, b):
    d = np.abs(np.mod(a, 180.0) - np.mod(b, 180.0))
    return np.minimum(d, 180.0 - d)


def apart(angles: list[float | None], least: float, most: int) -> list[float]:
    """Angles in order, each at least so far from those before it; null and what isn't finite are left out."""
    out: list[float] = []
    for a in angles:
        if a is not None and math.isfinite(a) and len(out) < most:
            a %= 180.0
            if all(min(d, 180.0 - d) >= least for d in (abs(a - b) for b in out)):
                out.append(a)
    return out


def hull_area(points: np.ndarray) -> float:
    """The area of points' hull, whose corners are among the lowest and the highest of every column."""
    return _hull_area(*points.T.tolist())


def _hull_area(xs: list[float], ys: list[float]) -> float:
    low: dict[float, float] = {}
    high: dict[float, float] = {}
    for x, y in zip(xs, ys, strict=True):
        if x not in low:
            low[x] = high[x] = y
        elif y < low[x]:
            low[x] = y
        elif y > high[x]:
            high[x] = y
    p = [q for x in sorted(low) for q in (((x, low[x]), (x, high[x])) if low[x] != high[x] else ((x, low[x]),))]
    if len(p) < 3:
        return 0.0

    def half(rows: list) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    found = half(p) + half(p[::-1])
    if len(found) < 3:
        return 0.0
    x0, y0 = found[0]  # from one of its corners, so that places far away lose no digits
    return abs(sum((a - x0) * (d - y0) - (b - y0) * (c - x0) for (a, b), (c, d) in zip(found, found[1:] + found[:1], strict=True))) / 2


def cells_hull_area(x: list[float], y: list[float], half: float) -> float:
    """The area of the hull of square cells, so far from their middles to their sides: of the corners of every row's first and last cell."""
    first: dict[float, float] = {}
    last: dict[float, float] = {}
    for a, b in zip(x, y, strict=True):
        if b not in first:
            first[b] = last[b] = a
        elif a < first[b]:
            first[b] = a
        elif a > last[b]:
            last[b] = a
    ends = [(a + dx, b + dy) for b in first for a, dx in ((first[b], -half), (last[b], half)) for dy in (-half, half)]
    return _hull_area([p[1] for p in ends], [p[0] for p in ends])


class Area:
    """An area's cells (x, y, row, col, area, bearing, aspect, slope, conf, strength), and how it is flown."""

    def __init__(self, cells: pd.DataFrame, step: float, spacing: float, speed: float, radius: float):
        self.c = {n: cells[n].to_numpy(float) for n in ("x", "y", "area", "bearing", "aspect", "slope", "conf", "strength")}
        self.step, self.spacing, self.speed, self.radius = step, spacing, speed, radius
        at = {p: i for i, p in enumerate(zip(cells["row"].tolist(), cells["col"].tolist(), strict=True))}
        pairs = [(i, at[q]) for (r, c), i in at.items() for q in ((r, c + 1), (r + 1, c)) if q in at]
        self.pairs = np.array(pairs, int).reshape(-1, 2)
        self.whole = self.c["area"].sum()
        a, b = self.pairs.T
        turn = np.abs((self.c["aspect"][a] - self.c["aspect"][b] + 180) % 360 - 180)
        self.breaks = step * (0.55 * (self.c["strength"][a] + self.c["strength"][b]) / 2 + 0.3 * turn + 0.15 * _delta(self.c["bearing"][a], self.c["bearing"][b]))
        self.near: list[list[int]] = [[] for _ in range(len(cells))]
        for i, j in pairs:
            self.near[i].append(j)
            self.near[j].append(i)
        # What every region sums over its own cells, worked out once.
        self.sure = np.maximum(1e-6, self.c["area"] * (0.2 + 0.8 * self.c["conf"]))
        t, u = np.radians(2 * self.c["bearing"]), np.radians(self.c["aspect"])
        self.axes = [f(v) * self.sure for v in (t, u) for f in (np.sin, np.cos)]
        self.bins = (np.mod(self.c["bearing"], 180.0) // 15).astype(int) % 12
        self.weight = np.maximum(1e-6, self.c["area"] * (0.35 + 0.65 * self.c["conf"]))
        self.share = 0.35 + 0.65 * self.c["conf"]
        self.shapes: dict[bytes, dict] = {}
        self.everything = self._mean_axes(np.arange(len(cells)))
        self.regions: dict[bytes, dict] = {}
        self.frontiers: dict[tuple, list] = {}

    def _mean_axes(self, own: np.ndarray) -> tuple[float, float]:
        t, t_, u, u_ = (a[own].sum() for a in self.axes)
        return float(np.degrees(np.arctan2(t, t_)) / 2 % 180), float(np.degrees(np.arctan2(u, u_)) % 360)

    def _spread_axis(self, own: np.ndarray) -> float | None:
        if len(own) < 2:
            return None
        w, x, y = (self.c[n][own] for n in ("area", "x", "y"))
        whole = w.sum()
        x, y = x - (x * w).sum() / whole, y - (y * w).sum() / whole
        return float(np.degrees(np.arctan2(2 * (w * x * y).sum(), (w * y * y).sum() - (w * x * x).sum())) / 2 % 180)

    def headings(self, own: np.ndarray) -> list[float]:
        """Means of bearings and aspects, of the region and the area, the axis of its spread, and the fullest bins of 15 degrees."""
        axis, aspect = self._mean_axes(own)
        whole_axis, whole_aspect = self.everything
        spread = self._spread_axis(own)
        bins = np.bincount(self.bins[own], self.sure[own], 12)
        full = [b * 15 + 7.5 for b in np.argsort(-bins, kind="stable") if bins[b] > 0]
        return apart([axis, aspect, aspect + 90, whole_axis, whole_aspect, whole_aspect + 90, spread, None if spread is None else spread + 90, *full], HEADING_APART, HEADINGS) or [whole_axis]

    def cuts(self, own: np.ndarray, heading: float) -> list[float]:
        spread = self._spread_axis(own)
        near = [x for h in self.headings(own) for x in (h, h + 90)]
        return apart([heading + 90, heading, *near, spread, None if spread is None else spread + 90, 0, 30, 45, 60, 90, 120, 135, 150], CUT_APART, DIRECTIONS)

    def connected(self, own: np.ndarray) -> bool:
        if len(own) == 0:
            return True
        left = set(own.tolist())
        found = [left.pop()]
        while found and left:
            for j in self.near[found.pop()]:
                if j in left:
                    left.remove(j)
                    found.append(j)
        return not left

    def shape(self, own: np.ndarray) -> dict:
        """A region's figures that are the same at every heading."""
        name = own.tobytes()
        if name not in self.shapes:
            x, y = self.c["x"][own], self.c["y"][own]
            member = np.zeros(len(self.c["x"]), bool)
            member[own] = True
            shared = int((member[self.pairs[:, 0]] & member[self.pairs[:, 1]]).sum())
            rim = (4 * len(own) - 2 * shared) * self.step
            ground = len(own) * self.step**2
            self.shapes[name] = {"area": float(self.c["area"][own].sum()), "convexity": ground / max(1e-9, cells_hull_area(x.tolist(), y.tolist(), self.step / 2)), "compactness": rim * rim / (4 * math.pi * ground)}
        return self.shapes[name]

    def region(self, own: np.ndarray) -> dict:
        """The best of a region's headings by its score, and its figures there; the first of equal ones."""
        name = own.tobytes()
        if name not in self.regions:
            shape = self.shape(own)
            tried = [{**shape, **t} for t in self._flown(own, self.headings(own))]
            for t in tried:
                t["score"] = t["quality"] + 0.06 * max(0.0, t["compactness"] - 3.4) + 0.35 * max(0.0, 0.75 - t["convexity"]) + 0.18 * t["fragments"] + 0.28 * t["transit"] + 0.12 * t["short"] + t["seconds"] / 55_000
            self.regions[name] = {**min(tried, key=lambda t: t["score"]), "cells": own}
        return self.regions[name]

    def _flown(self, own: np.ndarray, headings: list[float]) -> list[dict]:
        """A region's figures at each heading; cells by headings as arrays."""
        x, y, w, share = self.c["x"][own], self.c["y"][own], self.weight[own], self.share[own]
        sin, cos = (np.array([[f(math.radians(h))] for h in headings]) for f in (math.sin, math.cos))
        along, across = x * sin + y * cos, x * cos - y * sin
        turn = np.radians(_delta(self.c["bearing"][own], np.array(headings)[:, None]))
        tilt = np.sin(turn)
        miss = tilt**2 * share
        steep = np.minimum(np.maximum(np.abs(tilt) * self.c["slope"][own] / 0.12, 0), 1.8)
        low = np.minimum(np.maximum(np.maximum(0, miss - 0.3) * 1.8 + np.maximum(0, steep - 1) * 0.5, 0), 1)
        whole = w.sum()
        quality = (((1.35 * miss + 0.35 * steep + 1.05 * low) * w).sum(axis=1) / whole).tolist()
        mismatch = ((np.degrees(turn) * w).sum(axis=1) / whole).tolist()
        # Lines are as far apart as asked for, or as the cells are; each flies from its first cell to its last.
        apart_ = max(self.spacing, self.step)
        per = apart_ / self.spacing
        line = np.rint((across - across.mean(axis=1, keepdims=True)) / apart_).astype(int)
        line -= line.min(axis=1, keepdims=True)
        most = int(line.max()) + 1
        line += np.arange(len(headings))[:, None] * most
        flat, place = line.ravel(), along.ravel()
        his, los = np.full(len(headings) * most, -np.inf), np.full(len(headings) * most, np.inf)
        np.minimum.at(los, flat, place), np.maximum.at(his, flat, place)
        counts = np.bincount(flat, minlength=len(headings) * most)
        spans = [(np.ptp(v, axis=1) + self.step).tolist() for v in (along, across)]
        # The lines in use, heading by heading: `at` is where a heading's begin.
        used = np.flatnonzero(counts)
        lo, hi, of = los[used], his[used], used // most
        at = np.searchsorted(of, np.arange(len(headings)))
        ns = np.diff(np.append(at, len(used))).tolist()
        length = hi - lo + self.step
        each = lambda v: np.add.reduceat(v, at).tolist()
        flown, short = each(length), each((length < max(80.0, 5 * self.spacing)).astype(int))
        lost = [0.0] * len(headings)
        if apart_ <= self.step * 1.01:
            wanted = np.maximum(1, np.rint(length / self.step))
            lost = each(np.minimum(np.maximum(1 - counts[used] / wanted, 0), 1))
        jumps = np.zeros(len(used))
        jumps[1:] = np.abs(hi[1:] - hi[:-1])
        jumps[at] = 0.0
        jump, turn_ = each(jumps), math.pi * self.radius + max(0.0, self.spacing - 2 * self.radius)
        out = []
        for k, (heading, n) in enumerate(zip(headings, ns, strict=True)):
            connectors = per * (n - 1) * turn_ + jump[k]
            total = flown[k] * per + connectors
            out.append({
                "heading": heading, "quality": quality[k], "mismatch": mismatch[k], "lines": n * per, "mean_line": flown[k] / n, "fragments": lost[k] / n, "transit": connectors / max(1.0, total),
                "short": short[k] / n, "seconds": total / self.speed + START, "along": spans[0][k], "across": spans[1][k],
            })
        return out

    def fits(self, shape: dict, whole: float, practical: bool) -> bool:
        """Whether a region passes those gates that ask for no heading."""
        k = int(practical)
        return not (shape["area"] / max(1.0, whole) < LEAST_CHILD or shape["convexity"] < CONVEXITY[k] or shape["compactness"] > COMPACTNESS[k])

    def passes(self, r: dict, whole: float, practical: bool) -> bool:
        """Whether a region passes the basic, or the practical, gates."""
        k = int(practical)
        least = max(LINE_FLOOR[k], SCALE[k] * max(1.0, r["along"], r["across"]))
        capture = min(1.0, max(0.0, 1 - 0.65 * r["fragments"] - 0.85 * r["transit"] - 0.45 * r["short"]))
        hard = not self.fits(r, whole, practical) or r["lines"] < 1 or capture < CAPTURE[k] or (practical and r["transit"] > TRANSIT[k])
        missing = least - r["mean_line"]
        return not hard and missing <= min(30.0, max(12.0, least * NEAR_MISS[k]))

    def plan(self, regions: list[dict], boundary: float = 0.0, tree=None) -> dict:
        area = np.array([r["area"] for r in regions])
        q = np.array([r["quality"] + 0.22 * max(0.0, 0.74 - r["convexity"]) + 0.05 * max(0.0, r["compactness"] - 3) + 0.22 * r["fragments"] + 0.28 * r["transit"] + 0.02 * r["short"] for r in regions])
        n = len(regions)
        return {"regions": regions, "boundary": boundary, "quality": float((q * area).sum() / area.sum()) + EACH * (n - 1), "seconds": sum(r["seconds"] for r in regions) + GAP * (n - 1), "tree": tree}

    def practical(self, plan: dict) -> bool:
        r = plan["regions"]
        share = np.array([x["area"] for x in r]) / max(1.0, self.whole)
        convexity = sum(x["area"] * x["convexity"] for x in r) / max(1.0, sum(x["area"] for x in r))
        return len(r) > 1 and 1 - share.max() >= LEAST_REST and share.min() >= LEAST_CHILD and convexity >= MEAN_CONVEXITY and (len(r) != 2 or share.max() <= MOST_OF_TWO) and all(self.passes(x, self.whole, True) for x in r)

    def splits(self, own: np.ndarray) -> list[dict]:
        """The best splits of a region in two by a straight cut: connected, large enough, flyable, and not much worse."""
        base = self.region(own)
        plan, found, seen = self.plan([base]), [], set()
        area = self.c["area"][own]
        for direction in self.cuts(own, base["heading"]):
            d = math.radians(direction)
            place = self.c["x"][own] * math.cos(d) - self.c["y"][own] * math.sin(d)
            order = np.argsort(place, kind="stable")
            run, sorted_place = np.cumsum(area[order]), place[order]
            for q in QUANTILES:
                at = sorted_place[min(len(order) - 1, int(np.searchsorted(run, q * run[-1])))]
                left = place <= at
                if left.all() or not left.any() or left.tobytes() in seen or (~left).tobytes() in seen:
                    continue
                seen.add(left.tobytes())
                shares = area[left].sum() / area.sum(), area[~left].sum() / area.sum()
                a, b = own[left], own[~left]
                # All of these only drop splits; those that cost least come first.
                if min(shares) < LEAST_CHILD or not self.connected(a) or not self.connected(b) or not all(self.fits(self.shape(h), base["area"], False) for h in (a, b)):
                    continue
                side = np.zeros(len(self.c["x"]), np.int8)
                side[a], side[b] = 1, 2
                across = side[self.pairs[:, 0]] * side[self.pairs[:, 1]] == 2
                boundary, weight = across.sum() * self.step, self.breaks[across].sum()
                if boundary <= 0.8 * self.step:
                    continue
                if not all(self.passes(self.region(h), base["area"], False) for h in (a, b)):
                    continue
                halves = [self.region(a), self.region(b)]
                both = self.plan(halves, boundary)
                gain, aligned = plan["quality"] - both["quality"], weight / boundary
                rank = gain - max(0.0, both["seconds"] - plan["seconds"]) / RANK_TIME + aligned / RANK_ALIGNED - RANK_UNEVEN * abs(shares[0] - shares[1])
                if gain <= -MOST_LOSS and rank <= LEAST_RANK:
                    continue
                found.append({"a": a, "b": b, "boundary": boundary, "rank": rank, "direction": direction, "at": float(at)})
        return sorted(found, key=lambda s: -s["rank"])[:SPLITS]

    def frontier(self, plans: list[dict]) -> list[dict]:
        """Plans that none equals or beats in quality and time; unsplit ones neither beat nor are beaten, impractical ones don't beat practical ones."""
        state = [2 if len(p["regions"]) == 1 else int(self.practical(p)) for p in plans]
        order = sorted(range(len(plans)), key=lambda i: (plans[i]["seconds"], plans[i]["quality"], len(plans[i]["regions"])))
        eps, kept = 1e-6, []

        def beats(i: int, j: int) -> bool:
            p, q = plans[i], plans[j]
            if 2 in (state[i], state[j]) or (state[i] == 0 and state[j] == 1):
                return False
            no_worse = p["quality"] <= q["quality"] + eps and p["seconds"] <= q["seconds"] + eps
            return no_worse and (p["quality"] < q["quality"] - eps or p["seconds"] < q["seconds"] - eps)

        for i in order:
            if not any(beats(j, i) for j in kept):
                kept = [j for j in kept if not beats(i, j)] + [i]
        # The unsplit plan comes first, then practical ones, then the others: those are what a full frontier leaves out.
        thin: dict[int, None] = {}
        for good in (2, 1, 0):
            for n in sorted({len(plans[i]["regions"]) for i in kept}):
                few = sorted((i for i in kept if len(plans[i]["regions"]) == n and state[i] == good), key=lambda i: (plans[i]["quality"], plans[i]["seconds"]))
                thin |= dict.fromkeys(few[: 5 if good else 3] + sorted(few, key=lambda i: plans[i]["seconds"])[:1])
        most = sorted(list(thin)[:MOST_STATES], key=lambda i: (plans[i]["quality"], plans[i]["seconds"]))
        return [plans[i] for i in most]

    def solve(self, own: np.ndarray, depth: int) -> list[dict]:
        """The frontier of an area's plans: as it is, or split in two with a plan of either side."""
        key = own.tobytes(), depth
        if key not in self.frontiers:
            plans = [self.plan([self.region(own)], tree=None)]
            if depth > 0 and len(own) >= 4 and plans[0]["regions"][0]["lines"] >= 1:
                for s in self.splits(own):
                    for left in self.solve(s["a"], depth - 1):
                        for right in self.solve(s["b"], depth - 1):
                            if len(left["regions"]) + len(right["regions"]) <= MOST_REGIONS:
                                tree = {"direction": s["direction"], "at": s["at"], "left": left["tree"], "right": right["tree"]}
                                plans.append(self.plan(left["regions"] + right["regions"], s["boundary"] + left["boundary"] + right["boundary"], tree))
            once = {tuple(sorted((r["cells"].tobytes(), r["heading"]) for r in p["regions"])): p for p in reversed(plans)}
            self.frontiers[key] = self.frontier(list(once.values()))
        return self.frontiers[key]


def solved(cells: DataFrame, keys: list[str], step: float, spacing: float, speed: float = 12.0, radius: float = 40.0, depth: int = 3) -> DataFrame:
    """(keys, plan, regions, quality, seconds, practical, boundary, region, heading, cell): the frontier of every area's partitions.

    cells: keys, cell, row, col, x, y, area, bearing, aspect, slope, conf, strength. Returned are the area as it is, the practical
    plans of its frontier, and the best plan of two regions, in the order of regions, time and quality; one row a cell.
    """
    cell = cells.schema["cell"].dataType.simpleString()
    own = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)

    def work(c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("cell", ignore_index=True)
        area = Area(c, step, spacing, speed, radius)
        plans = area.solve(np.arange(len(c)), depth)
        two = [p for p in plans if len(p["regions"]) == 2][:1]
        shown = [p for p in plans if len(p["regions"]) == 1 or area.practical(p)]
        shown = sorted([*shown, *(p for p in two if p not in shown)], key=lambda p: (len(p["regions"]), p["seconds"], p["quality"]))
        frames = [
            pd.DataFrame({"plan": i, "regions": len(p["regions"]), "quality": p["quality"], "seconds": p["seconds"], "practical": area.practical(p), "boundary": float(p["boundary"]), "region": k, "heading": r["heading"], "cell": c["cell"].to_numpy()[r["cells"]]})
            for i, p in enumerate(shown)
            for k, r in enumerate(sorted(p["regions"], key=lambda r: int(r["cells"][0])))
        ]
        out = pd.concat(frames, ignore_index=True)
        for k in reversed(keys):
            out.insert(0, k, c[k].iloc[0])
        return out

    # A search takes long beside its few rows, so areas are dealt to as many tasks as a shuffle has, which no size of rows makes fewer.
    dealt = cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return dealt.groupBy(*keys).applyInPandas(work, f"{own}, plan int, regions int, quality double, seconds double, practical boolean, boundary double, region int, heading double, cell {cell}")


def reconstruct(ring: list[tuple[float, float]], tree: dict | None) -> list[list[tuple[float, float]]]:
    """The rings of a plan's regions from its tree of cuts: a convex ring clipped at each cut, left sides first."""
    if tree is None:
        return [ring]
    d = math.radians(tree["direction"])
    side = lambda p: p[0] * math.cos(d) - p[1] * math.sin(d) - tree["at"]

    def clip(sign: float) -> list[tuple[float, float]]:
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            a, b = side(p) * sign, side(q) * sign
            if a <= 0:
                out.append(p)
            if a * b < 0:
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        return out

    return [r for part, name in ((clip(1.0), "left"), (clip(-1.0), "right")) if len(part) > 2 for r in reconstruct(part, tree[name])]
