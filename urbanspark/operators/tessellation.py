"""Morphological tessellation as polygons: the part of the plane nearest to each footprint, no farther than a limit.

Outlines become points a segment apart; a point's cell is what the bisectors with its neighbours leave of a disc, and the sides
between cells of one footprint fall away. Points are dealt to the leaves of a quadtree with a halo. Whether what a leaf knows was wide
enough is known for each point: nobody farther than twice its cell's reach can cut it. Points for which it wasn't are done once more
with just that much around them. A leaf's points are cut together, a neighbour at a time, and a footprint that lies in one leaf is closed there.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiling
from .polygons import RING

#: Metres that a cell reaches, between two points of an outline, of the first halo; sides of the disc; points a tile.
LIMIT, SEGMENT, HALO, SIDES, CAPACITY = 100.0, 1.0, 30.0, 72, 4_000
#: Corners of neighbouring sides closer than this are one.
SNAP = 1e-5
#: Leaves a task, about; points and pairs of neighbours that are cut at once.
LEAVES, POINTS, PAIRS = 50, 4_096, 200_000


def _usable(ring: Column) -> Column:
    return F.filter(ring, lambda p: F.coalesce((F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")), F.lit(False)))


def _sides(p: Column) -> Column:
    return F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))


def _along(sides: DataFrame, segment: float) -> DataFrame:
    """Sides (x0 ... y1) cut into equal parts no longer than ``segment``: where each begins (x, y) and its number i."""
    s = sides.withColumn("len", F.expr("sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"))
    s = s.withColumn("k", F.greatest(F.ceil(F.col("len") / segment), F.lit(1)).cast("int")).withColumn("i", F.explode(F.expr("sequence(0, k - 1)")))
    return s.withColumns({"x": F.expr("x0 + (x1 - x0) * i / k"), "y": F.expr("y0 + (y1 - y0) * i / k")})


def outline_points(footprints: DataFrame, segment: float = SEGMENT) -> DataFrame:
    """(id, n, x, y): points along the outlines (id, ring), no two of a side farther apart than ``segment``, with their number in the outline.

    A point that outlines have in common belongs to the least id, whose cell has the other's side as well. Points that are null or not finite are passed over.
    """
    pts = footprints.where("ring is not null").select("id", _usable(F.col("ring")).alias("p")).where(F.size("p") > 1)
    at = _along(pts.select("id", F.posexplode(_sides(F.col("p"))).alias("part", "s")).select("id", "part", "s.*"), segment)
    at = at.select("id", (F.col("part").cast("long") * (1 << 32) + F.col("i")).alias("n"), "x", "y")
    return at.groupBy("x", "y").agg(F.min(F.struct("id", "n")).alias("f")).select("f.id", "f.n", "x", "y")


def _outlines(footprints: DataFrame) -> DataFrame:
    """(id, rings, ax, ay, bx, by): all usable outlines of an id with the box around them, dealt to all cores."""
    good = footprints.where("ring is not null").select("id", _usable(F.col("ring")).alias("p")).where(F.size("p") > 1)
    ends = [F.expr(f"cast(array_{f}(transform(flatten(rings), p -> p.{c})) as double) as {a}") for a, c, f in (("ax", "x", "min"), ("ay", "y", "min"), ("bx", "x", "max"), ("by", "y", "max"))]
    return good.groupBy("id").agg(F.collect_list("p").alias("rings")).select("id", "rings", *ends)


def _points(outlines: DataFrame, segment: float) -> DataFrame:
    """(id, x, y, ax, ay, bx, by): points along outlines, each of an outline's, with its box."""
    box = ["ax", "ay", "bx", "by"]
    sides = outlines.select("id", *box, F.explode("rings").alias("p")).select("id", *box, F.explode(_sides(F.col("p"))).alias("s"))
    return _along(sides.select("id", *box, "s.*"), segment).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *box)


class _Cells:
    """Convex polygons around points, a padded row each, corners relative to the point; tag[i] is of the side from corner i on, -1 for none.

    Numbers are relative to the point while it is cut, so large coordinates lose nothing.
    """

    def __init__(self, n: int, limit: float) -> None:
        self.x, self.y = np.tile([-limit, limit, limit, -limit], (n, 1)), np.tile([-limit, -limit, limit, limit], (n, 1))
        self.tag, self.count, self.limit = np.full((n, 4), -1, np.int64), np.full(n, 4), limit
        #: How far the farthest corner is, the limit at most.
        self.far = np.full(n, float(limit))

    def farthest(self, rows: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
        """The greatest nx x + ny y of the corners of each of ``rows``."""
        w = int(self.count.max())
        x, y = (np.where(np.arange(w) < self.count[:, None], v[:, :w], 0.0).T.copy() for v in (self.x, self.y))
        best = np.zeros(len(rows))
        for u, v in zip(x, y, strict=True):
            np.maximum(best, nx * u[rows] + ny * v[rows], out=best)
        return best

    def cut(self, rows: np.ndarray, nx: np.ndarray, ny: np.ndarray, c: np.ndarray, tag: np.ndarray) -> None:
        """Leaves of the polygons ``rows``, each named once, the part with nx x + ny y <= c."""
        if not len(rows):
            return
        n = self.count[rows][:, None]
        k = np.arange(int(n.max()))
        x, y = self.x[rows, : len(k)], self.y[rows, : len(k)]
        side = nx[:, None] * x + ny[:, None] * y - c[:, None]
        out = (side > 0) & (k < n)
        hit = out.any(1)
        if not hit.all():
            rows, n, x, y, side, out, tag = (v[hit] for v in (rows, n, x, y, side, out, tag))
            if not len(rows):
                return
        t = self.tag[rows, : len(k)]
        after = np.where(k + 1 < n, k + 1, 0)
        b = np.take_along_axis(side, after, 1)
        keep = (k < n) & ~out
        cross = np.where(out, b <= 0, keep & (b > 0))
        each = keep.astype(np.int64) + cross
        at = np.cumsum(each, 1)
        self.count[rows] = at[:, -1]
        wide = int(at[:, -1].max())
        at -= each
        if wide > self.x.shape[1]:
            more = ((0, 0), (0, wide + 2 - self.x.shape[1]))
            self.x, self.y, self.tag = np.pad(self.x, more), np.pad(self.y, more), np.pad(self.tag, more)
        u, v, w = np.zeros((len(rows), wide)), np.zeros((len(rows), wide)), np.zeros((len(rows), wide), np.int64)
        r, j = np.nonzero(keep)
        to = (r, at[r, j])
        u[to], v[to], w[to] = x[r, j], y[r, j], t[r, j]
        # A side that leaves ends there, and the new one begins; one that comes back begins there.
        r, j = np.nonzero(cross)
        a, q, leaves = side[r, j], after[r, j], keep[r, j]
        part, to = a / (a - b[r, j]), (r, at[r, j] + leaves)
        u[to], v[to], w[to] = x[r, j] + (x[r, q] - x[r, j]) * part, y[r, j] + (y[r, q] - y[r, j]) * part, np.where(leaves, tag[r], t[r, j])
        self.x[rows, :wide], self.y[rows, :wide], self.tag[rows, :wide] = u, v, w
        self.far[rows] = np.minimum(self.limit, np.sqrt((u * u + v * v).max(1)))


def _neighbours(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, wide: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, other): what lies in the cells of a grid around each point (px, py) as far as ``wide``, about ``PAIRS`` at once and the pairs of a row together."""
    # A little farther, since numbers are rounded.
    wide *= 1 + 1e-6
    x0, y0 = x.min(), y.min()
    g = max(wide / 2, (x.max() - x0) / 2**30, (y.max() - y0) / 2**30)
    high = int((y.max() - y0) / g) + 2
    key = np.floor((x - x0) / g).astype(np.int64) * high + np.floor((y - y0) / g).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    col = np.floor((px - wide - x0) / g).astype(np.int64)[:, None] + np.arange(int(2 * wide / g) + 2)
    low, top = (np.clip(np.floor((py + s - y0) / g), 0, high - 1).astype(np.int64)[:, None] for s in (-wide, wide))
    a, b = np.searchsorted(key, col * high + low), np.searchsorted(key, col * high + top, side="right")
    size = b - a
    total = np.cumsum(size.sum(1))
    begin = 0
    while begin < len(px):
        done = int(total[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
        n = size[begin:end].ravel()
        first = np.cumsum(n) - n
        other = order[np.arange(int(n.sum())) + np.repeat(a[begin:end].ravel() - first, n)]
        yield np.repeat(np.arange(begin, end), size[begin:end].sum(1)), other
        begin = end


def _cut_all(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, reach: np.ndarray, limit: float) -> _Cells:
    """The cells of points (px, py) among all (x, y), as far as ``reach`` tells; the limit's disc is left to the caller."""
    cells = _Cells(len(px), limit)
    open_, seen, wide = np.arange(len(px)), 0.0, min(8.0, 2 * limit)
    while len(open_):
        # Neighbours by distance, from rings that grow until they can't matter.
        for row, j in _neighbours(x, y, px[open_], py[open_], wide):
            row = open_[row]
            dx, dy = x[j] - px[row], y[j] - py[row]
            q = dx * dx + dy * dy
            pick = np.flatnonzero((q > seen * seen) & (q <= wide * wide) & (q <= 4 * cells.far[row] ** 2))
            if seen and len(pick):
                # Cells only shrink: what cuts no corner now never will.
                pick = pick[cells.farthest(row[pick], dx[pick], dy[pick]) > q[pick] / 2]
            pick = pick[np.lexsort((y[j[pick]], x[j[pick]], q[pick], row[pick]))]
            row, j, dx, dy, q = row[pick], j[pick], dx[pick], dy[pick], q[pick]
            new = np.flatnonzero(np.diff(row, prepend=-1))
            nth = np.arange(len(row)) - np.repeat(new, np.diff(new, append=len(row)))
            turn = np.argsort(nth, kind="stable")
            end = 0
            for n in np.bincount(nth).tolist():
                k, end = turn[end : end + n], end + n
                k = k[q[k] <= 4 * cells.far[row[k]] ** 2]
                cells.cut(row[k], dx[k], dy[k], q[k] / 2, j[k])
        need = np.minimum(2 * cells.far[open_], reach[open_])
        open_, need = open_[need > wide], need[need > wide]
        seen, wide = wide, min(2 * wide, float(need.max(initial=0.0)))
    return cells


def cells(x: np.ndarray, y: np.ndarray, mine: np.ndarray, reach: np.ndarray, limit: float, sides: int = SIDES) -> tuple[np.ndarray, ...]:
    """(sure, far, point, other, at) of the points numbered ``mine``, at places that differ: whether all that is within ``reach`` decides the
    cell and how far that goes, then the sides of the cells that are sure: the number of the point, of the one beyond (-1: the limit) and x0 ... y1.
    """
    low, out = limit * math.cos(math.pi / sides), []
    for begin in range(0, max(1, len(mine)), POINTS):
        i = mine[begin : begin + POINTS]
        px, py, far_enough = x[i], y[i], reach[begin : begin + POINTS]
        found = _cut_all(x, y, px, py, far_enough, limit)
        far = found.far.copy()
        sure = (2 * far <= far_enough) | (far_enough >= 2 * limit)
        rim = np.flatnonzero(sure & (far > low))
        for k in range(sides):
            turn = math.pi * (2 * k + 1) / sides
            found.cut(rim, *(np.full(len(rim), v) for v in (math.cos(turn), math.sin(turn), low)), np.full(len(rim), -1))
        count = np.where(sure, found.count, 0)
        row, k = np.nonzero(np.arange(found.x.shape[1]) < count[:, None])
        after = np.where(k + 1 < count[row], k + 1, 0)
        at = np.stack([px[row] + found.x[row, k], py[row] + found.y[row, k], px[row] + found.x[row, after], py[row] + found.y[row, after]], 1)
        out.append((sure, far, i[row], found.tag[row, k], at))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def rings_of(edges: list[tuple[float, float, float, float]], snap: float = SNAP) -> list[list[tuple[float, float]]]:
    """Closed rings of directed sides whose ends meet up to ``snap``; straight runs are one side."""
    places: dict[tuple[int, int], list[tuple[float, float]]] = defaultdict(list)

    def place(x: float, y: float) -> tuple[float, float]:
        kx, ky = math.floor(x / snap), math.floor(y / snap)
        for i in (0, -1, 1):
            for j in (0, -1, 1):
                for p in places.get((kx + i, ky + j), ()):
                    if abs(p[0] - x) <= snap and abs(p[1] - y) <= snap:
                        return p
        places[kx, ky].append((x, y))
        return x, y

    count: dict[tuple, int] = defaultdict(int)
    for x0, y0, x1, y1 in edges:
        a, b = place(x0, y0), place(x1, y1)
        if a == b:
            continue
        if count[b, a]:
            count[b, a] -= 1
        else:
            count[a, b] += 1
    follow: dict[tuple, list[tuple]] = defaultdict(list)
    for (a, b), n in sorted(count.items()):
        follow[a] += [b] * n
    rings = []
    for start in sorted(follow):
        while follow[start]:
            ring, at, to = [start], start, follow[start].pop()
            while to != start and follow[to]:
                ring.append(to)
                back = math.atan2(at[1] - to[1], at[0] - to[0])
                ends = follow[to]
                turn = min(range(len(ends)), key=lambda k: (math.atan2(ends[k][1] - to[1], ends[k][0] - to[0]) - back) % (2 * math.pi) or 2 * math.pi)
                at, to = to, ends.pop(turn)
            if to != start:
                raise ValueError("a cell's outline doesn't close")
            n = len(ring)
            bent = [p for k, p in enumerate(ring) if abs((p[0] - ring[k - 1][0]) * (ring[(k + 1) % n][1] - p[1]) - (p[1] - ring[k - 1][1]) * (ring[(k + 1) % n][0] - p[0])) > snap * snap]
            if len(bent) > 2:
                rings.append([*bent, bent[0]])
    return rings


def _facing(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sides between points a and b, numbered below n: those with a < b that are seen from b as well, how b sees them, and those that only one sees."""
    key = a * n + b
    order = np.argsort(key, kind="stable")
    order = order[np.diff(key[order], append=-1) != 0]
    known, back = key[order], b[order] * n + a[order]
    to = np.minimum(np.searchsorted(known, back), max(0, len(known) - 1))
    both = known[to] == back
    up = both & (a[order] < b[order])
    return order[up], order[to[up]], order[~both]


def _between(at: np.ndarray, there: np.ndarray, here: np.ndarray) -> np.ndarray:
    """What is left of sides that two cells of one outline have in common: they see them alike, but for where the limit's chords end them."""
    one, two = at[here], at[there]
    return np.concatenate([np.stack([two[:, 0], two[:, 1], one[:, 2], one[:, 3]], 1), np.stack([one[:, 0], one[:, 1], two[:, 2], two[:, 3]], 1)])


def closed_rings(code: np.ndarray, at: np.ndarray, n: int, snap: float = SNAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``rings_of`` for the sides of many cells at once, numbered below n: the cell of each ring, its number of corners, and the corners.

    Cells whose corners are all well apart and have one side in and one out are walked here; any other cell is left to ``rings_of``.
    """
    odd = np.zeros(n, bool)
    long = np.flatnonzero((np.abs(at[:, :2] - at[:, 2:]) > snap).any(1))
    if not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    who, e = code[long], at[long]
    pid, place = np.concatenate([who, who]), []
    for v in (np.concatenate([e[:, 0], e[:, 2]]), np.concatenate([e[:, 1], e[:, 3]])):
        # Numbers in a cell that are within the snap, one after the other; too long a run could be more than one.
        order = np.lexsort((v, pid))
        p, w = pid[order], v[order]
        first = np.flatnonzero(np.append(True, (np.diff(p) != 0) | (np.diff(w) > snap)))
        last = np.append(first[1:], len(p)) - 1
        odd[p[first][w[last] - w[first] > snap]] = True
        rank = np.empty(len(p), np.int64)
        rank[order] = np.repeat(np.arange(len(first)), last - first + 1)
        place.append(rank)
    # Numbers of corners follow the cell, then x, then y.
    _, where, corner = np.unique(place[0] * (len(pid) + 1) + place[1], return_index=True, return_inverse=True)
    x, y, of, m = np.concatenate([e[:, 0], e[:, 2]])[where], np.concatenate([e[:, 1], e[:, 3]])[where], pid[where], len(where)
    a, b = corner[: len(e)], corner[len(e) :]
    key, same = np.unique(np.minimum(a, b) * max(m, 1) + np.maximum(a, b), return_inverse=True)
    net = np.bincount(same, np.sign(b - a), len(key)).astype(np.int64)
    key, net = key[net != 0], net[net != 0]
    lo, hi = key // max(m, 1), key % max(m, 1)
    odd[of[lo[np.abs(net) > 1]]] = True
    start, end = np.where(net > 0, lo, hi), np.where(net > 0, hi, lo)
    leave, come = np.bincount(start, minlength=m), np.bincount(end, minlength=m)
    odd[of[(leave > 1) | (leave != come)]] = True
    follow = np.full(m, -1)
    fine = ~odd[of[start]]
    follow[start[fine]] = end[fine]
    seq, sizes, to = [], [], follow.tolist()
    for s in np.sort(start[fine]).tolist():
        if to[s] >= 0:
            begin = len(seq)
            while to[s] >= 0:
                seq.append(s)
                to[s], s = -1, to[s]
            sizes.append(len(seq) - begin)
    seq, sizes = np.array(seq, np.int64), np.array(sizes, np.int64)
    first = np.cumsum(sizes) - sizes
    k, ring = np.arange(len(seq)), np.repeat(np.arange(len(sizes)), sizes)
    before, after = k - 1, k + 1
    before[first], after[first + sizes - 1] = first + sizes - 1, first
    cx, cy = x[seq], y[seq]
    bent = np.abs((cx - cx[before]) * (cy[after] - cy) - (cy - cy[before]) * (cx[after] - cx)) > snap * snap
    kept = np.bincount(ring[bent], minlength=len(sizes))
    bent &= (kept > 2)[ring]
    owner, size, xs, ys = [of[seq[first]][kept > 2]], [kept[kept > 2]], [cx[bent]], [cy[bent]]
    pick = np.flatnonzero(odd[code])
    pick = pick[np.argsort(code[pick], kind="stable")]
    for part in np.split(pick, np.flatnonzero(np.diff(code[pick])) + 1) if len(pick) else []:
        for r in rings_of(list(map(tuple, at[part].tolist())), snap):
            owner.append(code[part[:1]])
            size.append(np.array([len(r) - 1]))
            xs.append(np.array([p[0] for p in r[:-1]]))
            ys.append(np.array([p[1] for p in r[:-1]]))
    return tuple(map(np.concatenate, (owner, size, xs, ys)))


def _closed(names: pa.Array, code: np.ndarray, at: np.ndarray) -> pa.Table:
    """(id, ring, holes, area) of cells numbered as their names: a row for each connected part."""
    owner, size, x, y = closed_rings(code, at, len(names))
    first = np.cumsum(size) - size
    ring = np.repeat(np.arange(len(size)), size)
    after = np.arange(len(x)) + 1
    after[first + size - 1] = first
    area = np.bincount(ring, x * y[after] - x[after] * y, len(size)) / 2
    # A ring ends where it began.
    ends = np.insert(np.arange(len(x)), first + size, first)
    rings = pa.ListArray.from_arrays(pa.array(np.append(first, len(x)) + np.arange(len(size) + 1), pa.int32()), pa.StructArray.from_arrays([pa.array(x[ends]), pa.array(y[ends])], ["x", "y"]))
    outer, inner = np.flatnonzero(area > 0), np.flatnonzero(area < 0)
    outer = outer[np.argsort(owner[outer], kind="stable")]
    a, b = np.searchsorted(owner[outer], owner[inner]), np.searchsorted(owner[outer], owner[inner], side="right")
    row, hole = [a[b - a == 1]], [inner[b - a == 1]]
    points = lambda r: list(zip(x[ends[first[r] + r :][: size[r] + 1]].tolist(), y[ends[first[r] + r :][: size[r] + 1]].tolist(), strict=True))
    for h, i, j in zip(inner.tolist(), a.tolist(), b.tolist(), strict=True):
        if j - i > 1:
            at_ = [k for k in range(i, j) if _inside((x[first[h]], y[first[h]]), points(outer[k]))]
            row.append(np.array(at_, np.int64))
            hole.append(np.full(len(at_), h))
    row, hole = np.concatenate(row), np.concatenate(hole)
    by = np.argsort(row, kind="stable")
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(outer))))
    holes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rings.take(pa.array(hole[by])))
    whole = area[outer] + np.bincount(row, area[hole], len(outer))
    return pa.table({"id": names.take(pa.array(owner[outer])), "ring": rings.take(pa.array(outer)), "holes": holes, "area": whole})


def _key(v) -> tuple:
    if isinstance(v, dict | list):
        return True, *map(_key, v.values() if isinstance(v, dict) else v)
    return (False,) if v is None else (True, v)


def _numbered(ids: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The different ids in order, and the number of each row's among them; -1 is of null, the least."""
    ids = ids.combine_chunks()
    if pa.types.is_nested(ids.type):
        # Arrow neither numbers nor sorts these.
        keys = [_key(v) for v in ids.to_pylist()]
        at = {k: i for i, k in enumerate(keys) if k[0]}
        number = {k: n for n, k in enumerate(sorted(at))}
        return ids.take(pa.array([at[k] for k in number], pa.int64())), np.array([number.get(k, -1) for k in keys], np.int64)
    coded = ids.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order) + 1, np.int64)
    rank[order.to_numpy()], rank[-1] = np.arange(len(order)), -1
    return coded.dictionary.take(order), rank[coded.indices.fill_null(len(order)).to_numpy(zero_copy_only=False)]


def _lists(code: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Rows of numbers, gathered for each code below n."""
    offsets = np.append(0, np.cumsum(np.bincount(code, minlength=n))) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[np.argsort(code, kind="stable")].ravel()))


def _dealt(tree: tiling.Tree, boxes: np.ndarray, span: float, own: bool):
    """Points to the leaves whose box holds them; a leaf's box goes no farther than ``span`` beyond the leaf.

    If ``own``, a leaf's own points are marked by 1, and by 2 if all their footprint lies in it.
    """
    sides, wanted = tree.boxes(), np.flatnonzero(np.isfinite(boxes).all(1))
    near = np.zeros(len(tree), bool)
    for part in np.array_split(wanted, len(wanted) // 256 + 1):
        near[tree.covering(*boxes[part].T)[1]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch["x"].to_numpy(), batch["y"].to_numpy()
            home = tree.of(x, y)
            row = np.flatnonzero(near[home])
            a, b, c, d = sides[home[row]].T
            deep = (x[row] - span > a) & (y[row] - span > b) & (x[row] + span < c) & (y[row] + span < d)
            inside, rest = row[deep], row[~deep]
            r, leaf = tree.covering(x[rest] - span, y[rest] - span, x[rest] + span, y[rest] + span)
            row, leaf = np.concatenate([inside, rest[r]]), np.concatenate([home[inside], leaf])
            a, b, c, d = boxes[leaf].T
            # A leaf has its own points, whatever rounding says of its box.
            mine = leaf == home[row] if own else np.zeros(len(row), bool)
            held = mine | (x[row] >= a) & (y[row] >= b) & (x[row] <= c) & (y[row] <= d)
            row, leaf, mine = row[held], leaf[held], mine[held]
            mark = mine.astype(np.int8)
            if own:
                ends = [batch[n].to_numpy() for n in ("ax", "ay", "bx", "by")]
                mark += (mine & (tree.of(*ends[:2]) == tree.of(*ends[2:]))[row]).astype(np.int8)
                mark[~batch["id"].is_valid().to_numpy(zero_copy_only=False)[row]] = 0
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), batch["id"].take(pa.array(row)), *(pa.array(v) for v in (x[row], y[row], mark))], ["leaf", "id", "x", "y", "own"])

    return run


def _meets(tree: tiling.Tree, boxes: np.ndarray, span: float):
    """Whether an envelope meets the box of any leaf; a leaf's box goes no farther than ``span`` beyond the leaf."""

    @F.pandas_udf("boolean")
    def meets(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        a, b, c, d = (v.to_numpy() for v in (ax, ay, bx, by))
        row, leaf = tree.covering(a - span, b - span, c + span, d + span)
        w, s, e, n = boxes[leaf].T
        out = np.zeros(len(a), bool)
        out[row[(a[row] <= e) & (c[row] >= w) & (b[row] <= n) & (d[row] >= s)]] = True
        return pd.Series(out)

    return meets("ax", "ay", "bx", "by")


def _tile(boxes: np.ndarray | None, limit: float):
    """Cells of a leaf's own points; all that its box holds is there, or all that matters if there are no boxes."""

    def run(table: pa.Table) -> pa.Table:
        names, code = _numbered(table["id"])
        x, y, own = (table[n].to_numpy() for n in ("x", "y", "own"))
        # A point that outlines have in common belongs to the least id.
        order = np.lexsort((-own, code, y, x))
        order = order[np.concatenate([[True], (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)])]
        x, y, own, code = x[order], y[order], own[order], code[order]
        mine, n = np.flatnonzero(own), len(names)
        leaf = table["leaf"][0].as_py()
        if boxes is None:
            reach = np.full(len(mine), np.inf)
        else:
            a, b, c, d = boxes[leaf]
            reach = np.minimum(np.minimum(x[mine] - a, c - x[mine]), np.minimum(y[mine] - b, d - y[mine]))
        sure, far, point, other, at = cells(x, y, mine, reach, limit)
        part = np.zeros(n, bool)
        part[code[mine[~sure | (own[mine] < 2)]]] = True
        inner = (other >= 0) & (code[other] == code[point])
        e, e_at = code[point[~inner]], at[~inner]
        i, j, i_at = point[inner], other[inner], at[inner]
        here, there, alone = _facing(i, j, len(x))
        gap = _between(i_at, there, here)
        gap_of = np.concatenate([code[i[here]]] * 2)
        some = (gap[:, :2] != gap[:, 2:]).any(1)
        e, e_at = np.concatenate([e, gap_of[some]]), np.concatenate([e_at, gap[some]])
        i, j, i_at = i[alone], j[alone], i_at[alone]
        ends = ~part[code[i]]
        whole = ~part[e]
        done = _closed(names, np.concatenate([e[whole], code[i[ends]]]), np.concatenate([e_at[whole], i_at[ends]]))
        i, j, i_at = i[~ends], j[~ends], i_at[~ends]
        left = np.flatnonzero(np.bincount(np.concatenate([e[~whole], code[i]]), minlength=n))
        to = np.zeros(n, np.int64)
        to[left] = np.arange(len(left))
        edges = _lists(to[e[~whole]], e_at[~whole], len(left))
        pairs = _lists(to[code[i]], np.column_stack([x[i], y[i], x[j], y[j], i_at]), len(left))
        pieces = pa.table({"id": names.take(pa.array(left)), "edges": edges, "inner": pairs})
        m = mine[~sure]
        todo = pa.table({"leaf": pa.array(np.full(len(m), leaf, np.int32)), "id": names.take(pa.array(code[m])), "x": x[m], "y": y[m], "far": far[~sure]})
        return pa.concat_tables([done, pieces, todo], promote_options="default").select(["leaf", "id", "x", "y", "far", "edges", "inner", "ring", "holes", "area"])

    return run


def _joined(table: pa.Table) -> pa.Table:
    """Closes cells of which leaves gave pieces."""
    names, code = _numbered(table["id"])
    flat = lambda n, w: (np.repeat(code, pc.list_value_length(table[n]).to_numpy() // w), pc.list_flatten(table[n]).to_numpy().reshape(-1, w))
    (e, e_at), (of, i_at) = flat("edges", 4), flat("inner", 8)
    if len(of):
        ends = np.concatenate([i_at[:, :2], i_at[:, 2:4]])
        order = np.lexsort(ends.T)
        number = np.empty(len(ends), np.int64)
        number[order] = np.cumsum(np.append(False, (np.diff(ends[order], axis=0) != 0).any(1)))
        here, there, alone = _facing(number[: len(of)], number[len(of) :], len(ends))
        e, e_at = np.concatenate([e, of[here], of[here], of[alone]]), np.concatenate([e_at, _between(i_at[:, 4:], there, here), i_at[alone, 4:]])
    return _closed(names, e, e_at)


def tessellation(footprints: DataFrame, limit: float = LIMIT, segment: float = SEGMENT, halo: float = HALO, capacity: int = CAPACITY) -> DataFrame:
    """(id, ring, holes, area) of each footprint's cell (id, ring): a row for each connected part, with the area of its own.

    Distances are to the outline's points, so a finer ``segment`` follows outlines closer. A footprint without a usable outline has
    no cell, and an empty table none; footprints that share points share none of their cells' area. The outline of the limit is of ``SIDES`` chords.
    """
    outlines = _outlines(footprints).checkpoint()
    points = _points(outlines, segment)
    tree = tiling.tree_of(points.select("x", "y"), capacity)
    kind = dict(footprints.dtypes)["id"]
    row = f"leaf int, id {kind}, x double, y double, own byte"
    schema = f"leaf int, id {kind}, x double, y double, far double, edges array<double>, inner array<double>, ring {RING}, holes array<{RING}>, area double"
    # Tasks follow the leaves, whose few bytes say little of the work.
    tasks = max(2 * footprints.sparkSession.sparkContext.defaultParallelism, len(tree) // LEAVES)
    span = min(halo, 2 * limit)
    boxes = tree.boxes() + [-span, -span, span, span]
    dealt = points.mapInArrow(_dealt(tree, boxes, span, True), row)
    found = dealt.repartition(tasks, "leaf").groupBy("leaf").applyInArrow(_tile(boxes, limit), schema).checkpoint()
    # Nobody farther than twice the reach of a cell cuts it: that much around the points of a leaf that are left decides them.
    todo = found.where("far is not null")
    some = todo.groupBy("leaf").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.max("far")).collect()
    if some:
        boxes = np.full((len(tree), 4), np.nan)
        for leaf, *box, far in some:
            span = 2 * far * (1 + 1e-9)
            boxes[leaf] = np.array(box) + [-span, -span, span, span]
        span = max(2 * r[5] for r in some) * (1 + 1e-9)
        around = _points(outlines.where(_meets(tree, boxes, span)), segment).mapInArrow(_dealt(tree, boxes, span, False), row)
        dealt = around.unionByName(todo.select("leaf", "id", "x", "y", F.lit(1).cast("byte").alias("own")))
        found = found.unionByName(dealt.repartition(tasks, "leaf").groupBy("leaf").applyInArrow(_tile(None, limit), schema).checkpoint())
    out = ["id", "ring", "holes", "area"]
    pieces = found.where("edges is not null").select("id", "edges", "inner").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, len(tree) // 4))))
    joined = pieces.repartition(tasks, "part").groupBy("part").applyInArrow(_joined, f"id {kind}, ring {RING}, holes array<{RING}>, area double")
    return found.where("area is not null").select(*out).unionByName(joined)


def _inside(p: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > p[1]) != (by > p[1]) and p[0] < ax + (bx - ax) * (p[1] - ay) / (by - ay):
            hit = not hit
    return hit
