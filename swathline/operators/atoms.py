"""Terrain atoms: patches of like cells, their graph, and regions made of them.

Patches and regions of one area are found in one task, from the cells of that area alone, which are bounded by its grid; bands and
adjacency, which need no order, are plain joins over all areas.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.angles import axial, axial_delta

#: Greatest turn, barrier and cost over which neighbours are merged, and most patches to begin with.
MERGE_TURN, MERGE_BARRIER, MERGE_COST, MOST_ATOMS = 14.0, 11.25, 1.75, 36
#: Share of the area and spread from which on a patch is split, passes of that, and least shares of its parts.
LARGE, SPREAD, PASSES, LEAST_HALF, LEAST_BAND, BAND = 0.2, 10.0, 4, 0.14, 0.1, 24.0


def edge_costs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, turn, barrier, cost) of cells side by side: how much the terrain changes from one to the other.

    cells: keys, cell, row, col, bearing, conf, strength. Each cell goes to the places right of and above it: two equi-joins.
    """
    own = ("cell", "bearing", "conf", "strength")
    parts = []
    for dr, dc in ((0, 1), (1, 0)):
        b = cells.select(*keys, (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), *[F.col(c).alias(f"b_{c}") for c in own])
        parts.append(cells.select(*keys, "row", "col", *own).join(b, [*keys, "row", "col"]))
    e = parts[0].unionByName(parts[1])
    turn, barrier = axial_delta(F.col("bearing"), F.col("b_bearing")), (F.col("strength") + F.col("b_strength")) / 2
    e = e.select(*keys, F.col("cell").alias("a"), F.col("b_cell").alias("b"), turn.alias("turn"), barrier.alias("barrier"), F.abs(F.col("conf") - F.col("b_conf")).alias("sure"))
    return e.select(*keys, "a", "b", "turn", "barrier", (F.col("turn") / 18 + F.col("barrier") / 10 + 0.8 * F.col("sure")).alias("cost"))


def bearing_bands(cells: DataFrame, keys: list[str], least: float, width: float = BAND) -> DataFrame:
    """(cell, band, part, area): connected cells of one band of bearings, named by their least cell; parts under `least` area are left out."""
    from .search import components

    c = cells.withColumn("band", F.floor(axial(F.col("bearing")) / width).cast("int"))
    e = edge_costs(c, [*keys, "band"]).select("a", "b")
    labels = components(c.select(F.col("cell").alias("node")), e).select(F.col("node").alias("cell"), F.col("component").alias("part"))
    big = c.join(labels, "cell")
    sizes = big.groupBy("part").agg(F.sum("area").alias("__area")).filter(F.col("__area") >= least)
    return big.join(sizes, "part").select("cell", "band", "part", F.col("__area").alias("area"))


def adjacency(cells: DataFrame, keys: list[str], label: str, step: float) -> DataFrame:
    """(keys, left, right, boundary, turn, barrier) of patches side by side: metres in common, and means along them."""
    own = cells.select(F.col("cell").alias("a"), F.col(label).alias("left"))
    e = edge_costs(cells, keys).join(own, "a").join(own.select(F.col("a").alias("b"), F.col("left").alias("right")), "b").filter("left <> right")
    pair = F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")
    return e.groupBy(*keys, *pair).agg((F.count(F.lit(1)) * step).alias("boundary"), F.avg("turn").alias("turn"), F.avg("barrier").alias("barrier"))


def _delta(a: np.ndarray, b) -> np.ndarray:
    d = np.abs(np.mod(a, 180.0) - np.mod(b, 180.0))
    return np.minimum(d, 180.0 - d)


def _axis(bearing: np.ndarray, weight: np.ndarray) -> float:
    t = np.radians(2 * bearing)
    return float(np.degrees(np.arctan2((np.sin(t) * weight).sum(), (np.cos(t) * weight).sum())) / 2 % 180)


class Patches:
    """The cells of one area with their neighbours: arrays, and a label for each cell."""

    def __init__(self, cells: pd.DataFrame, pairs: np.ndarray, cost: np.ndarray, turn: np.ndarray, barrier: np.ndarray):
        self.c = {n: cells[n].to_numpy(float) for n in ("x", "y", "area", "bearing", "conf")}
        self.weight = np.maximum(1e-6, self.c["area"] * (0.25 + 0.75 * self.c["conf"]))
        order = np.lexsort((pairs[:, 1], pairs[:, 0], cost)) if len(pairs) else np.zeros(0, int)
        self.pairs, self.cost, self.turn, self.barrier = pairs[order], cost[order], turn[order], barrier[order]
        self.n = len(cells)
        self.label = np.arange(self.n)

    def merge(self, most: int) -> None:
        """Merges neighbours that are alike, then the cheapest of those left while there are more than `most` patches."""
        parent = list(range(self.n))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        alike = (self.turn <= MERGE_TURN) & (self.barrier <= MERGE_BARRIER) & (self.cost <= MERGE_COST)
        count = self.n
        for chosen, capped in ((alike, False), (~alike, True)):
            for a, b in self.pairs[chosen].tolist():
                if capped and count <= most:
                    break
                i, j = sorted((find(a), find(b)))
                if i != j:
                    parent[j], count = i, count - 1
        self.label = np.array([find(i) for i in range(self.n)], int)

    def absorb(self, least: int) -> None:
        """Patches of too few cells go to the neighbour over the cheapest edge, the smallest patches first, until none can."""
        while True:
            ids, sizes = np.unique(self.label, return_counts=True)
            for i in ids[np.argsort(sizes, kind="stable")][np.sort(sizes) < least]:
                la, lb = self.label[self.pairs[:, 0]], self.label[self.pairs[:, 1]]
                out = np.flatnonzero((la == i) != (lb == i))
                if len(out):
                    k = out[0]  # edges are in the order of their cost
                    self.label[self.label == i] = lb[k] if la[k] == i else la[k]
                    break
            else:
                return

    def connected(self, own: np.ndarray) -> list[np.ndarray]:
        """The connected parts of some cells, each in order, the one with the least cell first."""
        at = np.full(self.n, -1)
        at[own] = own
        inside = self.pairs[(at[self.pairs[:, 0]] >= 0) & (at[self.pairs[:, 1]] >= 0)] if len(self.pairs) else self.pairs
        while True:
            low = np.minimum(at[inside[:, 0]], at[inside[:, 1]]) if len(inside) else np.zeros(0, int)
            new = at.copy()
            np.minimum.at(new, inside[:, 0], low), np.minimum.at(new, inside[:, 1], low)
            if np.array_equal(new, at):
                return [own[at[own] == i] for i in np.unique(at[own])]
            at = new

    def two_means(self, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray] | None:
        """Two connected halves by bearing and place, of at least so much area each: six rounds from the extreme bearings."""
        c = {n: v[own] for n, v in self.c.items()}
        t = np.radians(2 * c["bearing"])
        scale = max(1.0, np.ptp(c["x"]), np.ptp(c["y"]))
        f = np.stack([np.cos(t), np.sin(t), (c["x"] - c["x"].mean()) / scale, (c["y"] - c["y"].mean()) / scale], axis=1)
        first, last = int(c["bearing"].argmin()), len(own) - 1 - int(c["bearing"][::-1].argmax())
        centres, w = [f[first], f[last]], self.weight[own]
        side = np.zeros(len(own), int)
        for _ in range(6):
            side = (((f - centres[0]) ** 2).sum(axis=1) > ((f - centres[1]) ** 2).sum(axis=1)).astype(int)
            for s in (0, 1):  # what is cut off from the largest part of its side goes to the other
                parts = self.connected(own[side == s])
                if len(parts) > 1:
                    keep = max(parts, key=len)
                    side[(side == s) & ~np.isin(own, keep)] = 1 - s
            if any(c["area"][side == s].sum() < max(least, 1e-12) for s in (0, 1)):
                return None
            centres = [(f[side == s] * w[side == s, None]).sum(axis=0) / w[side == s].sum() for s in (0, 1)]
        return own[side == 0], own[side == 1]

    def bands(self, own: np.ndarray, least: float) -> list[np.ndarray] | None:
        band = np.floor(np.mod(self.c["bearing"][own], 180.0) / BAND)
        parts = [p for b in np.unique(band) for p in self.connected(own[band == b]) if self.c["area"][p].sum() >= least]
        return parts if len(parts) > 1 else None

    def split_large(self) -> None:
        """Patches that are large and mixed become halves, or bands; cells of no band stay where they were."""
        whole = max(1.0, self.c["area"].sum())
        for _ in range(PASSES):
            changed = False
            for i in np.unique(self.label):
                own = np.flatnonzero(self.label == i)
                area, w = self.c["area"][own].sum(), self.weight[own]
                spread = (_delta(self.c["bearing"][own], _axis(self.c["bearing"][own], w)) * w).sum() / w.sum()
                if area / whole <= LARGE or spread < SPREAD:
                    continue
                parts = self.two_means(own, area * LEAST_HALF) or self.bands(own, area * LEAST_BAND)
                for p in (parts or [])[1:]:
                    self.label[p] = self.n + p.min()
                    changed = True
            self.names()
            if not changed:
                return

    def names(self) -> None:
        """Every patch by its least cell."""
        for i in np.unique(self.label):
            own = self.label == i
            self.label[own] = np.flatnonzero(own)[0] + (self.n * 4)
        self.label -= self.n * 4


def _patches(cells: pd.DataFrame, links: pd.DataFrame) -> Patches:
    at = pd.Series(np.arange(len(cells)), index=cells["cell"])
    pairs = np.stack([at[links["a"]].to_numpy(int), at[links["b"]].to_numpy(int)], axis=1) if len(links) else np.zeros((0, 2), int)
    return Patches(cells, pairs, *(links[c].to_numpy(float) for c in ("cost", "turn", "barrier")))


def _grouped(cells: DataFrame, keys: list[str], work, fields: str) -> DataFrame:
    # Keys of their own, as both sides of the cogroup come from the same cells.
    links = edge_costs(cells, keys).select(*[F.col(k).alias(k) for k in keys], "a", "b", "turn", "barrier", "cost")
    own = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)

    def run(c: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(c):
            return pd.DataFrame({k: [] for k in (*keys, *(f.split()[0] for f in fields.split(", ")))})
        c = c.sort_values("cell", ignore_index=True)
        out = work(c, _patches(c, e))
        for k in reversed(keys):
            out.insert(0, k, c[k].iloc[0])
        return out

    return cells.groupBy(*keys).cogroup(links.groupBy(*keys)).applyInPandas(run, f"{own}, {fields}")


def atoms(cells: DataFrame, keys: list[str], least: int = 4, most: int = MOST_ATOMS) -> DataFrame:
    """(keys, cell, atom): patches of like cells of each area, named by their least cell.

    cells: keys, cell, row, col, x, y, area, bearing, conf, strength. Like neighbours are merged; beyond `most` patches the cheapest
    others too; patches under `least` cells join a neighbour; large mixed ones are halved, and small ones joined again.
    """

    def work(c: pd.DataFrame, p: Patches) -> pd.DataFrame:
        p.merge(most)
        p.absorb(least)
        p.split_large()
        p.absorb(least)
        p.names()
        return pd.DataFrame({"cell": c["cell"], "atom": c["cell"].to_numpy()[p.label]})

    return _grouped(cells, keys, work, f"cell {cells.schema['cell'].dataType.simpleString()}, atom {cells.schema['cell'].dataType.simpleString()}")


def halves(cells: DataFrame, keys: list[str], least: float = LEAST_HALF) -> DataFrame:
    """(keys, cell, side): each area in two connected halves by bearing and place; side is null where there are none of the least share."""

    def work(c: pd.DataFrame, p: Patches) -> pd.DataFrame:
        found = p.two_means(np.arange(p.n), least * p.c["area"].sum())
        side = pd.array([None] * p.n, dtype="Int32")
        for s, own in enumerate(found or ()):
            side[own] = s
        return pd.DataFrame({"cell": c["cell"], "side": side})

    return _grouped(cells, keys, work, f"cell {cells.schema['cell'].dataType.simpleString()}, side int")


class Regions:
    """Regions of patches: seeds, rounds of moving patches to cheaper regions, and merging."""

    def __init__(self, p: Patches):
        self.ids, self.of = np.unique(p.label, return_inverse=True)
        k = len(self.ids)
        sums = lambda v: np.bincount(self.of, v, k)
        self.area, self.weight = sums(p.c["area"]), sums(p.weight)
        t = np.radians(2 * p.c["bearing"])
        self.sin, self.cos = sums(np.sin(t) * p.weight), sums(np.cos(t) * p.weight)
        self.x, self.y = sums(p.c["x"] * p.c["area"]) / self.area, sums(p.c["y"] * p.c["area"]) / self.area
        self.bearing = np.degrees(np.arctan2(self.sin, self.cos)) / 2 % 180
        self.cut = np.zeros((k, k))
        a, b = (self.of[p.pairs[:, i]] for i in (0, 1)) if len(p.pairs) else (np.zeros(0, int),) * 2
        across = a != b
        # A boundary is worth keeping where terrain turns: cheap to cut there.
        np.add.at(self.cut, (a[across], b[across]), np.exp(-p.cost[across]))
        self.cut += self.cut.T
        self.side = np.zeros((k, k))
        np.add.at(self.side, (a[across], b[across]), 1.0)
        self.side += self.side.T
        self.whole = max(1e-9, self.area.sum())

    def seeds(self, k: int, how: str) -> list[int]:
        """k patches far apart: by bearing, by place, or the largest."""
        if how == "large":
            return np.argsort(-self.area, kind="stable")[:k].tolist()
        chosen = [int(self.area.argmax())]
        while len(chosen) < k:
            if how == "bearing":
                far = np.min([_delta(self.bearing, self.bearing[s]) for s in chosen], axis=0)
            else:
                far = np.min([np.hypot(self.x - self.x[s], self.y - self.y[s]) for s in chosen], axis=0)
            far[chosen] = -1
            chosen.append(int(far.argmax()))
        return chosen

    def node(self, axes: np.ndarray) -> np.ndarray:
        """The cost of each patch at each heading, by its share of the area."""
        return np.sin(np.radians(_delta(self.bearing[:, None], axes[None, :]))) ** 2 * (self.area / self.whole)[:, None]

    def axes(self, region: np.ndarray, k: int) -> np.ndarray:
        return np.degrees(np.arctan2(np.bincount(region, self.sin, k), np.bincount(region, self.cos, k))) / 2 % 180

    def settle(self, seeds: list[int], smooth: float = 0.02) -> np.ndarray:
        """Patches to the cheapest region, by heading and what is cut, for ten rounds at most; then regions are made connected."""
        k = len(seeds)
        near = np.hypot(self.x[:, None] - self.x[seeds], self.y[:, None] - self.y[seeds])
        region = (self.node(self.bearing[seeds]) + 1e-3 * near / max(1e-9, near.max())).argmin(axis=1)
        region[seeds] = np.arange(k)
        for _ in range(10):
            before = region.copy()
            node = self.node(self.axes(region, k))
            for i in range(len(region)):
                joined = np.bincount(region, self.cut[i], k)
                cost = node[i] + smooth * (joined.sum() - joined)
                cost[np.bincount(region, self.side[i], k) == 0] += 1e-6
                region[i] = cost.argmin()
            if np.array_equal(before, region):
                break
        return self.repaired(region)

    def parts(self, region: np.ndarray) -> np.ndarray:
        """Each connected part of a region as a region of its own, by its least patch."""
        at = np.arange(len(region))
        same = (region[:, None] == region[None, :]) & (self.side > 0)
        while True:
            new = np.minimum(at, np.where(same, at[None, :], len(at)).min(axis=1))
            if np.array_equal(new, at):
                return at
            at = new

    def repaired(self, region: np.ndarray, least: float = 0.05) -> np.ndarray:
        """Connected regions of a least share of the area: smaller parts go to the neighbour that they share most with."""
        region = self.parts(region)
        while True:
            ids = np.unique(region)
            areas = np.array([self.area[region == i].sum() for i in ids]) / self.whole
            for i in ids[np.argsort(areas, kind="stable")][np.sort(areas) < least]:
                border = np.bincount(region, self.side[region == i].sum(axis=0), len(region))
                border[i] = 0
                if border.max() > 0:
                    region[region == i] = int(border.argmax())
                    break
            else:
                return np.unique(region, return_inverse=True)[1]

    def cost(self, region: np.ndarray) -> float:
        """Mismatch of the regions' headings, what is cut, one more for each region, and a share that is too large."""
        k = int(region.max()) + 1
        node = self.node(self.axes(region, k))[np.arange(len(region)), region].sum()
        cut = self.cut[region[:, None] != region[None, :]].sum() / max(1e-9, self.cut.sum())
        largest = max(self.area[region == i].sum() for i in range(k)) / self.whole
        return float(node + 0.42 * cut * 0.1 + 0.03 * (k - 1) + 2.4 * max(0.0, largest - 0.7) * (k > 1))

    def fine(self, most: int) -> np.ndarray:
        """The cheapest of the segmentations into 2 to `most` regions, from seeds of three kinds."""
        n = len(self.area)
        found = [self.settle(self.seeds(k, how)) for k in range(2, min(most, n) + 1) for how in ("bearing", "place", "large")]
        return min([*found, np.zeros(n, int)], key=lambda r: (round(self.cost(r), 9), r.max()))

    def levels(self, region: np.ndarray) -> list[np.ndarray]:
        """The regions, and fewer of them one by one, each time by the cheapest merge of two neighbours."""
        out = [region]
        while region.max() > 0:
            k = int(region.max()) + 1
            pairs = [(i, j) for i in range(k) for j in range(i + 1, k) if self.side[np.ix_(region == i, region == j)].sum() > 0] or [(0, 1)]
            merged = [np.unique(np.where(region == j, i, region), return_inverse=True)[1] for i, j in pairs]
            region = min(merged, key=lambda r: round(self.cost(r), 9))
            out.append(region)
        return out


def segmentation(cells: DataFrame, keys: list[str], most: int = 8, least: int = 4) -> DataFrame:
    """(keys, level, cell, region, cost): every area in its cheapest regions of patches, and in fewer ones down to a single one.

    level is the number of regions. A region is named by its least cell. Costs are comparable within an area.
    """

    def work(c: pd.DataFrame, p: Patches) -> pd.DataFrame:
        p.merge(MOST_ATOMS)
        p.absorb(least)
        p.split_large()
        p.absorb(least)
        p.names()
        r = Regions(p)
        frames = []
        for region in r.levels(r.fine(most)):
            own = region[r.of]
            names = np.array([c["cell"].to_numpy()[np.flatnonzero(own == i)[0]] for i in range(own.max() + 1)])
            frames.append(pd.DataFrame({"level": int(own.max()) + 1, "cell": c["cell"], "region": names[own], "cost": r.cost(region)}))
        return pd.concat(frames, ignore_index=True)

    cell = cells.schema["cell"].dataType.simpleString()
    return _grouped(cells, keys, work, f"level int, cell {cell}, region {cell}, cost double")


def frontier(levels: DataFrame, keys: list[str], least: float = 0.04) -> DataFrame:
    """(keys, level, cost, practical): every level's cost once, and whether none of its regions has under the least share of cells."""
    sizes = levels.groupBy(*keys, "level", "region").agg(F.count(F.lit(1)).alias("n"), F.first("cost").alias("cost"))
    s = sizes.groupBy(*keys, "level").agg(F.first("cost").alias("cost"), (F.min("n") / F.sum("n")).alias("__least"))
    return s.select(*keys, "level", "cost", (F.col("__least") >= least).alias("practical"))
