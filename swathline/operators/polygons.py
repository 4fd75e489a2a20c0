"""Polygon algebra: unions, intersections, differences, shared boundaries, merges, and coverages with fewer points.

Rings are arrays of struct<x, y> in metres, without the first point again at the end. Pairs and groups come by key; the algebra of
one pair is an Arrow kernel, all measures are expressions.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import _edges

RING = "array<struct<x:double,y:double>>"
#: Least shared boundary, how far apart boundaries may run, their greatest angle's sine, area and width that still count as touching.
LEAST_BOUNDARY, SLOP, PARALLEL, AREA_EPS, OVERLAP_WIDTH = 1.0, 0.25, 0.08, 0.01, 0.25

Ring = list[tuple[float, float]]


def signed_area(ring: Ring) -> float:
    x, y = np.array(ring).T
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def _segments(rings: list[Ring]) -> np.ndarray:
    return np.concatenate([np.hstack([np.array(r, float), np.roll(np.array(r, float), -1, axis=0)]) for r in rings]) if rings else np.zeros((0, 4))


def _inside(points: np.ndarray, segments: np.ndarray) -> np.ndarray:
    x, y = points[:, 0, None], points[:, 1, None]
    x1, y1, x2, y2 = segments.T
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return hit.sum(axis=1) % 2 == 1


def _cut(first: np.ndarray, second: np.ndarray, grid: float) -> tuple[np.ndarray, np.ndarray]:
    """Both boundaries split wherever they cross, touch or end on each other; a point in common is the same for both, on a grid."""
    snap = lambda p: np.round(p / grid) * grid
    sides = snap(first), snap(second)
    cuts: tuple[list, list] = tuple([[s[:2], s[2:]] for s in side] for side in sides)
    e, starts = sides[1][:, 2:] - sides[1][:, :2], sides[1][:, :2]
    for i, (x1, y1, x2, y2) in enumerate(sides[0]):
        d, off = np.array([x2 - x1, y2 - y1]), starts - [x1, y1]
        det = d[0] * e[:, 1] - d[1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (off[:, 0] * e[:, 1] - off[:, 1] * e[:, 0]) / det
            u = (off[:, 0] * d[1] - off[:, 1] * d[0]) / det
        for j in np.flatnonzero((np.abs(det) > 1e-9) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)):
            at = snap(np.array([x1, y1]) + t[j] * d)
            cuts[0][i].append(at), cuts[1][j].append(at)
    for own, other in ((0, 1), (1, 0)):
        ends = np.unique(sides[other][:, :2], axis=0)
        for i, (x1, y1, x2, y2) in enumerate(sides[own]):
            d = np.array([x2 - x1, y2 - y1])
            length = max(1e-30, float(d @ d))
            along, across = (ends - [x1, y1]) @ d / length, np.abs((ends[:, 0] - x1) * d[1] - (ends[:, 1] - y1) * d[0]) / math.sqrt(length)
            cuts[own][i] += list(ends[(across <= grid) & (along > 0) & (along < 1)])
    out = []
    for side, found in zip(sides, cuts, strict=True):
        parts = [np.zeros((0, 4))]
        for s, points in zip(side, found, strict=True):
            p = np.array(points)
            p = p[np.argsort((p - s[:2]) @ (s[2:] - s[:2]), kind="stable")]
            keep = np.any(np.abs(p[1:] - p[:-1]) > grid / 2, axis=1)
            parts.append(np.hstack([p[:-1], p[1:]])[keep])
        out.append(np.concatenate(parts))
    return out[0], out[1]


def _turned(rings: list[Ring]) -> list[Ring]:
    return [r if signed_area(r) > 0 else r[::-1] for r in rings]


def boolean(a: list[Ring], b: list[Ring], kind: str, grid: float = 1e-6) -> list[Ring]:
    """The rings of the union, intersection or difference of two polygons without holes, outer ones counter-clockwise, holes clockwise.

    Pieces of either boundary stay by the side of the other that they are on; what is common stays once where both run the
    same way (for a difference: opposite ways). The pieces are then joined, turning as far left as they can.
    """
    a, b = _turned([r for r in a if len(r) > 2]), _turned([r for r in b if len(r) > 2])
    if not a or not b:
        return {"union": a or b, "intersection": [], "difference": a}[kind]
    sa, sb = _segments(a), _segments(b)
    pa_, pb = _cut(sa, sb, grid)
    key = lambda s: list(map(tuple, np.round(s / grid).astype(np.int64).tolist()))
    ka, kb = key(pa_), key(pb)
    there = set(kb)
    same = np.array([k in there for k in ka], bool)
    against = np.array([(k[2], k[3], k[0], k[1]) in there for k in ka], bool)
    shared_b = np.array([k in set(ka) or (k[2], k[3], k[0], k[1]) in set(ka) for k in kb], bool)
    mid = lambda s: (s[:, :2] + s[:, 2:]) / 2
    in_b, in_a = _inside(mid(pa_), sb), _inside(mid(pb), sa)
    free = ~same & ~against
    if kind == "union":
        kept = [*pa_[free & ~in_b], *pb[~shared_b & ~in_a], *pa_[same]]
    elif kind == "intersection":
        kept = [*pa_[free & in_b], *pb[~shared_b & in_a], *pa_[same]]
    else:
        kept = [*pa_[free & ~in_b], *pb[~shared_b & in_a][:, [2, 3, 0, 1]], *pa_[against]]
    return _joined(np.array(kept).reshape(-1, 4), grid)


def _joined(pieces: np.ndarray, grid: float) -> list[Ring]:
    out: dict[tuple, list[tuple]] = defaultdict(list)
    for x1, y1, x2, y2 in np.round(pieces / grid).astype(np.int64).tolist():
        out[x1, y1].append((x2, y2))
    rings = []
    while out:
        start = next(iter(out))
        ring, at = [start], out[start].pop()
        before = start
        if not out[start]:
            del out[start]
        while at != start and at in out:
            heading = math.atan2(at[1] - before[1], at[0] - before[0])
            ways = out[at]
            # Left of straight on first, back last.
            k = max(range(len(ways)), key=lambda i: (math.atan2(ways[i][1] - at[1], ways[i][0] - at[0]) - heading + math.pi - 1e-9) % (2 * math.pi))  # noqa: B023
            ring.append(at)
            before, at = at, ways.pop(k)
            if not ways:
                del out[before]
        if at == start and len(ring) > 2:
            ring = _straight([(x * grid, y * grid) for x, y in ring])
            if len(ring) > 2 and abs(signed_area(ring)) > grid:
                rings.append(ring)
    return rings


def _straight(ring: Ring) -> Ring:
    """Without the points that lie on the line between their neighbours."""
    n = len(ring)
    turn = lambda p, q, r: abs((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])) / max(1e-12, math.dist(p, r))
    return [q for i, q in enumerate(ring) if turn(ring[i - 1], q, ring[(i + 1) % n]) > 1e-6]


def _list(ring) -> Ring:
    return [(p["x"], p["y"]) for p in ring or []]


def _struct(ring: Ring) -> list[dict]:
    return [{"x": x, "y": y} for x, y in ring]


def algebra(pairs: DataFrame, keys: list[str], kinds: tuple[str, ...] = ("union", "intersection", "difference")) -> DataFrame:
    """(keys, kind, rings, area, outers, holes) of pairs of rings a, b: one row a pair and kind. Null rings count as nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = {k: [] for k in (*keys, "kind", "rings", "area", "outers", "holes")}
            for row in rows:
                for kind in kinds:
                    rings = boolean([_list(row["a"])], [_list(row["b"])], kind)
                    areas = [signed_area(r) for r in rings]
                    for k, v in (*((k, row[k]) for k in keys), ("kind", kind), ("rings", [_struct(r) for r in rings]), ("area", sum(areas)), ("outers", sum(x > 0 for x in areas)), ("holes", sum(x < 0 for x in areas))):
                        out[k].append(v)
            fields = [pa.field(k, batch.schema.field(k).type) for k in keys]
            point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
            schema = pa.schema([*fields, ("kind", pa.string()), ("rings", pa.list_(pa.list_(point))), ("area", pa.float64()), ("outers", pa.int32()), ("holes", pa.int32())])
            yield pa.RecordBatch.from_pydict(out, schema)

    own = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select(*keys, "a", "b").mapInArrow(work, f"{own}, kind string, rings array<{RING}>, area double, outers int, holes int")


def shared_boundary(a: Column, b: Column) -> Column:
    """Metres of a's sides that run along b's: of every side the longest stretch beside one of b's, nearly parallel and at most SLOP away."""

    def beside(s: Column, o: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        ex, ey = o["b"]["x"] - o["a"]["x"], o["b"]["y"] - o["a"]["y"]
        length, other = F.hypot(dx, dy), F.hypot(ex, ey)
        ux, uy = dx / length, dy / length
        place = lambda p: ((p["x"] - s["a"]["x"]) * ux + (p["y"] - s["a"]["y"]) * uy, F.abs((p["x"] - s["a"]["x"]) * uy - (p["y"] - s["a"]["y"]) * ux))
        (t0, o0), (t1, o1) = place(o["a"]), place(o["b"])
        near = (length > 1e-6) & (other > 1e-6) & (F.abs(ux * ey - uy * ex) / other <= PARALLEL) & (F.greatest(o0, o1) <= SLOP)
        return F.when(near, F.greatest(F.lit(0.0), F.least(length, F.greatest(t0, t1)) - F.greatest(F.lit(0.0), F.least(t0, t1)))).otherwise(0.0)

    best = lambda s: F.aggregate(_edges(b), F.lit(0.0), lambda m, o: F.greatest(m, beside(s, o)))
    return F.aggregate(F.transform(_edges(a), best), F.lit(0.0), lambda t, x: t + x)


def merge_candidates(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, boundary, overlap, reason): whether rings a and b can become one area; reason is null where they can.

    They must share a boundary, overlap along it no wider than OVERLAP_WIDTH, and make one ring without holes.
    """
    found = algebra(pairs, keys, ("union", "intersection")).groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == "intersection", F.col("area"))).alias("overlap"), F.max(F.when(F.col("kind") == "union", F.col("outers"))).alias("__outers"), F.max(F.when(F.col("kind") == "union", F.col("holes"))).alias("__holes"),
    )
    both = pairs.select(*keys, shared_boundary(F.col("a"), F.col("b")).alias("boundary")).join(found, keys)
    reason = F.when(F.col("boundary") < LEAST_BOUNDARY, "apart").when((F.col("overlap") > AREA_EPS) & (F.col("overlap") / F.col("boundary") > OVERLAP_WIDTH), "overlapping").when((F.col("__outers") != 1) | (F.col("__holes") > 0), "not one ring")
    return both.select(*keys, "boundary", "overlap", reason.alias("reason"))


def _boundary(a: Ring, b: Ring) -> float:
    """shared_boundary of two rings as arrays."""
    s, o = _segments([a]), _segments([b])
    d, e = s[:, 2:] - s[:, :2], o[:, 2:] - o[:, :2]
    length, other = np.hypot(*d.T), np.hypot(*e.T)
    u = d / length[:, None]
    total = 0.0
    for k in range(len(s)):
        p, q = o[:, :2] - s[k, :2], o[:, 2:] - s[k, :2]
        off = np.maximum(np.abs(p[:, 0] * u[k, 1] - p[:, 1] * u[k, 0]), np.abs(q[:, 0] * u[k, 1] - q[:, 1] * u[k, 0]))
        near = (np.abs(u[k, 0] * e[:, 1] - u[k, 1] * e[:, 0]) / other <= PARALLEL) & (off <= SLOP)
        t0, t1 = p @ u[k], q @ u[k]
        run = np.minimum(length[k], np.maximum(t0, t1)) - np.maximum(0.0, np.minimum(t0, t1))
        total += max(0.0, float(np.where(near, run, 0.0).max(initial=0.0)))
    return total


def _fits(whole: Ring, ring: Ring) -> Ring | None:
    """The ring of both together, where they may be merged."""
    border = _boundary(whole, ring)
    if border < LEAST_BOUNDARY:
        return None
    over = sum(map(signed_area, boolean([whole], [ring], "intersection")))
    if over > AREA_EPS and over / border > OVERLAP_WIDTH:
        return None
    union = boolean([whole], [ring], "union")
    return union[0] if len(union) == 1 else None


def merged(rings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, merged, refused, eligible, ring, area): the selected areas of a group made one, in order, and what else would fit.

    rings: keys, order, ring, selected. The first selected one begins; every further one is merged if it fits what is merged so
    far, and refused if not; eligible counts those not selected, or refused, that fit the result. A group without a selected
    area has no row. A selection is a bounded group, folded in one task.
    """

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r[order])
        picked, rest = [r for r in rows if r["selected"]], [r for r in rows if not r["selected"]]
        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        schema = pa.schema([*[table.schema.field(k) for k in keys], ("merged", pa.int32()), ("refused", pa.int32()), ("eligible", pa.int32()), ("ring", pa.list_(point)), ("area", pa.float64())])
        if not picked:
            return schema.empty_table()
        whole, refused = _list(picked[0]["ring"]), []
        for r in picked[1:]:
            found = _fits(whole, _list(r["ring"]))
            refused += [r] * (found is None)
            whole = found or whole
        others = sum(_fits(whole, _list(r["ring"])) is not None for r in rest + refused)
        row = {**{k: picked[0][k] for k in keys}, "merged": len(picked) - len(refused), "refused": len(refused), "eligible": others, "ring": _struct(whole), "area": abs(signed_area(whole))}
        return pa.Table.from_pylist([row], schema)

    own = ", ".join(f"`{k}` {rings.schema[k].dataType.simpleString()}" for k in keys)
    return rings.groupBy(*keys).applyInArrow(fold, f"{own}, merged int, refused int, eligible int, ring {RING}, area double")


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """Metres from a point to the nearest side of a ring."""

    def to(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy) / length))).otherwise(0.0)
        return F.hypot(x - e["a"]["x"] - t * dx, y - e["a"]["y"] - t * dy)

    return F.array_min(F.transform(_edges(ring), to))


def nearest_region(gaps: DataFrame, regions: DataFrame, keys: list[str], gap: str, region: str) -> DataFrame:
    """(keys, gap, region, distance): the region of the same parent whose boundary a gap (x, y of its middle) is nearest to, ties by name."""
    both = gaps.select(*keys, gap, "x", "y").join(regions.select(*keys, region, "ring"), keys)
    both = both.select(*keys, gap, region, ring_distance(F.col("x"), F.col("y"), F.col("ring")).alias("distance"))
    best = both.groupBy(*keys, gap).agg(F.min(F.struct("distance", region)).alias("b"))
    return best.select(*keys, gap, f"b.{region}", "b.distance")


def _peucker(line: Ring, tolerance: float) -> Ring:
    """The line's ends and those points between that are needed to keep within the tolerance."""
    if len(line) < 3:
        return line
    p = np.array(line)
    d = p[-1] - p[0]
    n = math.hypot(*d)
    off = np.abs((p[:, 0] - p[0, 0]) * d[1] - (p[:, 1] - p[0, 1]) * d[0]) / n if n > 0 else np.hypot(*(p - p[0]).T)
    k = int(off.argmax())
    return [line[0], line[-1]] if off[k] <= tolerance else _peucker(line[: k + 1], tolerance)[:-1] + _peucker(line[k:], tolerance)


def simplify_rings(rings: list[Ring], tolerance: float, rim: bool = True) -> list[Ring]:
    """Rings of a coverage with fewer points: what two of them share stays shared.

    Points where three sides meet stay. The lines between such points are simplified once each, so neighbours stay neighbours;
    with rim=False lines that one ring alone has are left as they are. A ring that would vanish keeps its points.
    """
    snap = lambda p: (round(p[0], 6), round(p[1], 6))
    rings = [[snap(p) for p in r] for r in rings]
    uses, near = defaultdict(int), defaultdict(set)
    for r in rings:
        for p, q in zip(r, r[1:] + r[:1], strict=True):
            uses[frozenset((p, q))] += 1
            near[p].add(q), near[q].add(p)
    # A point is fixed where lines fork, and where one ring's own side becomes a shared one.
    fixed = {p for p, qs in near.items() if len(qs) != 2 or len({uses[frozenset((p, q))] for q in qs}) > 1}
    known: dict[tuple, Ring] = {}
    out = []
    for r in rings:
        anchors = [i for i, p in enumerate(r) if p in fixed]
        if not anchors:  # a ring by itself: its least point and the one farthest from it
            i = min(range(len(r)), key=lambda i: r[i])
            anchors = sorted({i, max(range(len(r)), key=lambda j: (math.dist(r[i], r[j]), r[j]))})
        made: Ring = []
        for i, j in zip(anchors, anchors[1:] + [anchors[0] + len(r)], strict=True):
            line = [r[k % len(r)] for k in range(i, j + 1)]
            back = line[::-1] < line
            name = tuple(line[::-1] if back else line)
            if name not in known:
                own = uses[frozenset(line[:2])] == 1
                known[name] = list(name) if own and not rim else _peucker(list(name), tolerance)
            made += (known[name][::-1] if back else known[name])[:-1]
        out.append(made if len(made) > 2 else r)
    return out


def simplified(rings: DataFrame, keys: list[str], name: str, tolerance: float, rim: bool = True) -> DataFrame:
    """(keys, name, ring): the coverages of each group with fewer points; a coverage is a bounded group."""

    def work(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        made = simplify_rings([_list(r["ring"]) for r in rows], tolerance, rim)
        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        schema = pa.schema([*[table.schema.field(k) for k in (*keys, name)], ("ring", pa.list_(point))])
        return pa.Table.from_pylist([{**{k: r[k] for k in (*keys, name)}, "ring": _struct(m)} for r, m in zip(rows, made, strict=True)], schema)

    own = ", ".join(f"`{k}` {rings.schema[k].dataType.simpleString()}" for k in (*keys, name))
    return rings.select(*keys, name, "ring").groupBy(*keys).applyInArrow(work, f"{own}, ring {RING}")


