"""Set algebra of polygons: union, clip, difference and repair, by tiles that adapt to density.

A feature's rings are handed to the tiles that its envelope meets. A tile cuts its plane into slabs between the
heights of the vertices and crossings in it; no two sides cross inside a slab, so a slab's part of a result is a row
of trapezoids between sides. Areas are exact, and no feature or parcel, however large, has to fit into one task.

Where features lie thick, most of a tile's rows can't tell in it: one rectangle that covers the whole tile is the union there, hides what is
lighter in an overlay, and leaves a feature as it is in a clip. These are found by joins before any ring goes to a tile, and a tile is
never much smaller than the features, so rows a tile follow from the plane and not from the number of features.

``as_polygons`` makes rings of them: inside a tile what trapezoids of a piece share falls away; along the tiles' borders
the two sides' intervals cancel, and where they do the pieces are linked. Linked pieces (components found by rounds of
joins) are one polygon each, whose remaining sides close to an outer ring and holes.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import shuffled
from ..functions import geometry as G
from . import tiling
from .graphs import connected
from .spatialjoin import counted

RING = "array<struct<x:double,y:double>>"
#: Parts below this area are left out: what remains of them is rounding.
LEAST_AREA = 1e-9
#: Features a tile, about, where no tile size is given: of one plane, and of many keys that are looked at one by one.
CAPACITY, KEYED_CAPACITY = 300, 2000
#: Steps of a unit to which the corners of rings are rounded; tiles begin and end on such steps.
GRID = 1_000_000
#: The least side of a tile: the finest halving of a unit that is whole in these steps.
LEAST_TILE = 1 / 64
#: Pairs of tile and key, of two numbers each, that are broadcast once they are counted.
FEW_PAIRS = 200_000

Box = tuple[float, float, float, float]
#: What a slab has: owner, begin and end (numbers of crossings) of each polygon's intervals; gives (label, begin, end) of its runs.
Rule = Callable[[np.ndarray, np.ndarray, np.ndarray, int], list[tuple[int, int, int]]]


def _heights(side: np.ndarray, box: Box) -> np.ndarray:
    """Where slabs begin and end: ends and crossings of the sides that meet the box, and its own bounds."""
    x0, y0, x1, y1 = box
    ax, ay, bx, by = side.T
    meets = (np.minimum(ax, bx) <= x1) & (np.maximum(ax, bx) >= x0) & (np.minimum(ay, by) <= y1) & (np.maximum(ay, by) >= y0)
    ax, ay, bx, by = side[meets].T
    found = [np.array([y0, y1]), ay, by]
    dx, dy = bx - ax, by - ay
    level = np.flatnonzero(dy != 0)
    for i in level[(dx != 0)[level]].tolist():  # upright sides don't cross each other
        o = level[(level > i) | (dx[level] == 0)]
        det = dx[i] * dy[o] - dy[i] * dx[o]
        ox, oy = ax[o] - ax[i], ay[o] - ay[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, s = (ox * dy[o] - oy * dx[o]) / det, (ox * dy[i] - oy * dx[i]) / det
            cross = (det != 0) & (t > 0) & (t < 1) & (s > 0) & (s < 1)
        found.append(np.where(dx[o] == 0, ay[o] + s * dy[o], ay[i] + t * dy[i])[cross])
        # Where it leaves the tile to the left or right, seen alike from both tiles.
        edge = np.array([x0, x1])
        t = (edge - ax[i]) / dx[i]
        found.append((ay[i] + t * dy[i])[(t > 0) & (t < 1)])
    y = np.unique(np.concatenate(found))
    return y[(y >= y0) & (y <= y1)]


def slabs(polygons: list[list[np.ndarray]], box: Box) -> Iterator[tuple[float, float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For every slab of a box: its heights, the crossings' places at the bottom and the top from left to right, the sides they are on, where the box begins and ends, and the polygons' intervals of crossings.

    A point is in a polygon if a ray from it crosses its rings an odd number of times; sides left of the box count for that alone.
    """
    x0, y0, x1, y1 = box
    sides, owner = [np.array([[x0, y0, x0, y1], [x1, y0, x1, y1]])], [np.array([-1, -1])]
    for n, rings in enumerate(polygons):
        for r in rings:
            if len(r) > 2:
                sides.append(np.hstack([r[:-1], r[1:]]))
                owner.append(np.full(len(r) - 1, n))
    side, own = np.vstack(sides), np.concatenate(owner)
    heights = _heights(side, box)
    keep = (side[:, 1] != side[:, 3]) & (np.minimum(side[:, 0], side[:, 2]) <= x1) | (own < 0)
    side, own = side[keep], own[keep]
    low, high = np.minimum(side[:, 1], side[:, 3]), np.maximum(side[:, 1], side[:, 3])
    # Sides that end right of the box were dropped; the rest of a polygon's crossings there is made even by the box's end.
    for a, b in zip(heights[:-1].tolist(), heights[1:].tolist(), strict=True):
        mid = (a + b) / 2
        here = np.flatnonzero((low < mid) & (high > mid))
        ax, ay, bx, by = side[here].T
        at = lambda y: np.where(ax == bx, ax, ax + (bx - ax) * (y - ay) / (by - ay))  # noqa: E731, B023
        order = np.argsort(at(mid), kind="stable")
        who = own[here][order]
        first, last = np.flatnonzero(who < 0).tolist()
        by_owner = np.argsort(who, kind="stable")[2:]
        owners = who[by_owner]
        # Begin, end, begin, end ... of each owner; an odd one out goes on to the box's end.
        nth = np.arange(len(owners)) - np.searchsorted(owners, owners, side="left")
        begin = np.flatnonzero(nth % 2 == 0)
        paired = np.zeros(len(begin), bool)
        paired[begin + 1 < len(owners)] = owners[begin[begin + 1 < len(owners)] + 1] == owners[begin[begin + 1 < len(owners)]]
        end = np.where(paired, by_owner[np.minimum(begin + 1, max(0, len(owners) - 1))] if len(owners) else 0, last)
        start = np.maximum(by_owner[begin], first)
        end = np.minimum(end, last)
        some = start < end
        yield a, b, at(a)[order], at(b)[order], side[here][order], who, (first, last), (owners[begin][some], start[some], end[some])


def _runs(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _cover(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    return (np.cumsum(np.bincount(start, minlength=n + 1)) - np.cumsum(np.bincount(end, minlength=n + 1)))[:n] > 0


def union_rule(owner: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    return [(0, a, b) for a, b in _runs(_cover(start, end, n))]


def first_rule(owner: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """What several polygons cover belongs to the first of them."""
    label = np.full(n, -1)
    for k in np.argsort(-owner, kind="stable").tolist():
        label[start[k] : end[k]] = owner[k]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(label)) + 1, [n]])
    return [(int(label[a]), a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if a < b and label[a] >= 0]


def clip_rule(masks: int, outside: bool) -> Rule:
    """Polygons from number ``masks`` on are cut to those before it, or to what these leave."""

    def rule(owner: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> list[tuple[int, int, int]]:
        mask = owner < masks
        open_ = _cover(start[mask], end[mask], n) != outside
        return [(o, a + s, a + e) for o, a, b in zip(owner[~mask].tolist(), start[~mask].tolist(), end[~mask].tolist(), strict=True) for s, e in _runs(open_[a:b])]

    return rule


def trapezoids(polygons: list[list[np.ndarray]], rule: Rule, box: Box) -> list[tuple[int, list[tuple[float, float]]]]:
    """(label, closed ring): they cover the part of a box to which a rule gives a label."""
    out = []
    for a, b, bottom, top, _, _, _, intervals in slabs(polygons, box):
        for what, i, k in rule(*intervals, len(bottom)):
            l0, l1, r0, r1 = (float(v) for v in (bottom[i], top[i], bottom[k], top[k]))
            if (r0 - l0 + r1 - l1) * (b - a) / 2 > LEAST_AREA:
                out.append((what, [(l0, a), (r0, a), (r1, b), (l1, b), (l0, a)]))
    return out


def pieces(polygons: list[list[np.ndarray]], rule: Rule, box: Box) -> tuple[list[tuple], list[tuple]]:
    """Connected pieces of a tile's result on the grid of rounded corners.

    Sides (label, piece, x0, y0, x1, y1, line) with the piece on their left, and what lies on the tile's border, as
    (label, piece, axis, line, from, to): along x for axis 0, along y for axis 1, backwards where ``to`` is less. Sides of
    one line go on from each other without a corner.
    """
    whole = lambda v: int(round(v * GRID))
    x0, y0, x1, y1 = map(whole, box)
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sides: list[tuple] = []
    flat: dict[tuple[int, int], list[tuple[int, int, int, int]]] = defaultdict(list)  # (label, height): from, to, +1 or -1, piece
    below: dict[int, list[tuple[int, int, int]]] = {}
    for a, b, bottom, top, side, who, (first, last), intervals in slabs(polygons, box):
        ya, yb = whole(a), whole(b)
        if ya == yb:
            continue
        rows: dict[int, list[list]] = defaultdict(list)
        for what, i, k in rule(*intervals, len(bottom)):
            row = [whole(bottom[i]), whole(top[i]), whole(bottom[k]), whole(top[k]), i, k]
            if row[0] >= row[2] and row[1] >= row[3]:
                continue
            before = rows[what][-1] if rows[what] else None
            if before and before[2] == row[0] and before[3] == row[1]:
                before[2], before[3], before[5] = row[2], row[3], k
            else:
                rows[what].append(row)
        now: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for what, found in rows.items():
            under, j = below.get(what, []), 0
            for l0, l1, r0, r1, i, k in found:
                me = len(parent)
                parent.append(me)
                while j < len(under) and under[j][1] <= l0:
                    j += 1
                m = j
                while m < len(under) and under[m][0] < r0:
                    if under[m][1] > l0:
                        parent[root(under[m][2])] = root(me)
                    m += 1
                flat[what, ya].append((l0, r0, 1, me))
                flat[what, yb].append((l1, r1, -1, me))
                now[what].append((l1, r1, me))
                for x_at, x_to, y_at, y_to, n in ((r0, r1, ya, yb, k), (l1, l0, yb, ya, i)):
                    sides.append((what, me, x_at, y_at, x_to, y_to, None if n in (first, last) else tuple(side[n].tolist())))
        below = dict(now)
    inner, border = [], []
    for what, me, ax, ay, bx, by, line in sides:
        if ax == bx and ax in (x0, x1):
            border.append((what, root(me), 1, ax, ay, by))
        else:
            inner.append((what, root(me), ax, ay, bx, by, line))
    for (what, y), found in flat.items():
        for p, q, sign, me in _balance([(p, q, sign, root(me)) for p, q, sign, me in found])[0]:
            p, q = (p, q) if sign > 0 else (q, p)
            if y in (y0, y1):
                border.append((what, me, 0, y, p, q))
            else:
                inner.append((what, me, p, y, q, y, None))
    return inner, border


def _balance(found: list[tuple[int, int, int, int]]) -> tuple[list[tuple[int, int, int, int]], set[tuple[int, int]]]:
    """What is left of signed intervals (from, to, sign, piece) of a line where opposite ones cancel, and the pairs of pieces that meet there."""
    cuts = sorted({v for p, q, _, _ in found for v in (p, q)})
    place = {v: i for i, v in enumerate(cuts)}
    up: list[list[int]] = [[] for _ in cuts]
    down: list[list[int]] = [[] for _ in cuts]
    for p, q, sign, me in found:
        for i in range(place[min(p, q)], place[max(p, q)]):
            ((up if sign > 0 else down)[i] if p < q else (down if sign > 0 else up)[i]).append(me)
    left, met = [], set()
    for i in range(len(cuts) - 1):
        n = min(len(up[i]), len(down[i]))
        met |= {(min(p), max(p)) for p in zip(up[i], down[i], strict=False) if p[0] != p[1]}
        for sign, rest in ((1, up[i][n:]), (-1, down[i][n:])):
            for me in rest:
                if left and left[-1][1] == cuts[i] and left[-1][2:] == (sign, me):
                    left[-1] = (left[-1][0], cuts[i + 1], sign, me)
                else:
                    left.append((cuts[i], cuts[i + 1], sign, me))
    return left, met


def linked(sides: list[tuple[int, int, int, int, tuple | None]]) -> tuple[list, list[list]]:
    """(outer ring, holes) of one polygon's sides, which have it on their left; corners as doubles.

    Where rings touch, the way on is the sharpest turn to the right: what is outside stays together, and rings apart.
    """
    count: dict[tuple, int] = defaultdict(int)
    line_of = {}
    for ax, ay, bx, by, line in sides:
        if (ax, ay) == (bx, by):
            continue
        if count.get((bx, by, ax, ay), 0) > 0:
            count[bx, by, ax, ay] -= 1
        else:
            count[ax, ay, bx, by] += 1
            line_of[ax, ay, bx, by] = line
    follow: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for (ax, ay, bx, by), n in sorted(count.items()):
        follow[ax, ay] += [(bx, by)] * n
    rings = []
    for start in sorted(follow):
        while follow[start]:
            ring, at, to = [start], start, follow[start].pop()
            while True:
                ring.append(to)
                if to == start:
                    break
                back = np.arctan2(at[1] - to[1], at[0] - to[0])
                ends = follow[to]
                turns = [(np.arctan2(e[1] - to[1], e[0] - to[0]) - back) % (2 * np.pi) or 2 * np.pi for e in ends]
                at, to = to, ends.pop(int(np.argmin(turns)))
            # A corner is where the way turns: not on one and the same side, nor along an axis.
            lines = [line_of[(*p, *q)] for p, q in zip(ring[:-1], ring[1:], strict=True)]
            kept = []
            for i, p in enumerate(ring[:-1]):
                o, q = ring[i - 1 if i else -2], ring[i + 1]
                same = lines[i] is not None and lines[i] == lines[i - 1]
                straight = (p[0] - o[0]) * (q[1] - p[1]) == (p[1] - o[1]) * (q[0] - p[0])
                if not (same or straight):
                    kept.append(p)
            if len(kept) > 2:
                area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(kept, kept[1:] + kept[:1], strict=True))
                low = kept.index(min(kept))
                kept = kept[low:] + kept[:low]
                if area:
                    rings.append((area, [{"x": x / GRID, "y": y / GRID} for x, y in [*kept, kept[0]]]))
    outer = max(rings, key=lambda r: r[0], default=(0, []))
    # What isn't the outer ring is a hole, or by rounding a speck.
    return outer[1], [r for a, r in rings if a < 0]


def bad_rings(features: DataFrame) -> DataFrame:
    """Features (id, ring) that the operators here leave out, with the reason: no ring, fewer than three corners, a coordinate that is null or not finite, or no end at the beginning."""
    r = F.col("ring")
    odd = F.exists(r, lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull() | ~(F.abs(p["x"]) < float("inf")) | ~(F.abs(p["y"]) < float("inf")))
    why = (
        F.when(r.isNull(), "no ring").when(F.size(r) < 4, "fewer than three corners").when(odd, "a coordinate is missing or not finite")
        .when((r[0]["x"] != F.element_at(r, -1)["x"]) | (r[0]["y"] != F.element_at(r, -1)["y"]), "not closed")
    )
    return features.select("*", why.alias("reason")).where("reason is not null")


def _good(features: DataFrame) -> DataFrame:
    """Without the features that ``bad_rings`` names; a ring that isn't closed counts as it is."""
    finite = F.forall("ring", lambda p: F.coalesce((F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")), F.lit(False)))
    return features.where(F.col("ring").isNotNull() & (F.size("ring") > 3) & finite)


def _rectangle() -> Column:
    """Whether ring is a rectangle along the axes, without holes."""
    p = [F.get("ring", F.lit(i)) for i in range(5)]
    same = lambda i, j, c: p[i][c] == p[j][c]
    straight = [same(i, i + 1, "x") != same(i, i + 1, "y") for i in range(4)]
    found = (F.size("ring") == 5) & same(0, 4, "x") & same(0, 4, "y") & (F.coalesce(F.size("holes"), F.lit(0)) < 1)
    for c in [*straight, *(~same(i, i + 2, c) for i in (0, 1) for c in "xy")]:
        found = found & c
    return F.coalesce(found, F.lit(False))


class _Plane:
    """Tiles of a size, or of a tree of places in the features; a tile is a number, and its box can be told from it.

    Tiles of a tree are no smaller than about half a feature: smaller ones would hold no fewer features, and each would lie in more of them.
    """

    def __init__(self, features: DataFrame, tile: float | None, capacity: int):
        self.size = tile
        if tile is None:
            e = G.envelope(F.col("ring"))
            # Any place in it stands for a feature: centres alone would leave the rim of a thick plane to wide tiles.
            within = lambda a, b, seed: F.col(a) + (F.col(b) - F.col(a)) * F.rand(seed)
            mid = features.select(e.alias("e")).select("e.*").withColumns({"x": within("min_x", "max_x", 1), "y": within("min_y", "max_y", 2)})
            side = mid.agg(F.avg(F.col("max_x") - F.col("min_x") + F.col("max_y") - F.col("min_y"))).first()[0]
            least = 2.0 ** math.floor(math.log2(side / 4)) if side and math.isfinite(side) else 0.0
            self.tree = tiling.tree_of(mid, capacity, least=max(LEAST_TILE, least))
        else:
            self.tree = None
        if tile is not None and abs(tile * GRID - round(tile * GRID)) > 1e-6:
            raise ValueError(f"a tile's side has to be a multiple of 1/{GRID}")

    def dealt(self, features: DataFrame) -> DataFrame:
        """Features once for each tile that their envelope covers: tile, shares (an area of the envelope), covered (the whole tile lies in the feature, which is a rectangle)."""
        rows = features.withColumn("e", G.envelope(F.col("ring")))
        sides = [F.col(f"e.{n}") for n in ("min_x", "min_y", "max_x", "max_y")]
        if self.tree is not None:
            rows = rows.withColumn("at", F.explode(tiling.leaves_of(self.tree, *sides, marked=True)))
            rows = rows.withColumns({"tile": F.shiftright("at", 2).cast("long"), "shares": F.col("at").bitwiseAND(1) == 1, "covered": (F.col("at").bitwiseAND(2) == 2) & _rectangle()})
            return rows.drop("e", "at")
        span = lambda lo, hi: F.sequence(F.floor(lo / self.size), F.greatest(F.ceil(hi / self.size) - 1, F.floor(lo / self.size)))
        rows = rows.withColumn("tx", F.explode(span(sides[0], sides[2]))).withColumn("ty", F.explode(span(sides[1], sides[3])))
        low, high = [F.col(t) * self.size for t in ("tx", "ty")], [(F.col(t) + 1) * self.size for t in ("tx", "ty")]
        shares = (sides[0] < high[0]) & (sides[2] > low[0]) & (sides[1] < high[1]) & (sides[3] > low[1]) & (sides[0] < sides[2]) & (sides[1] < sides[3])
        whole = (sides[0] <= low[0]) & (sides[2] >= high[0]) & (sides[1] <= low[1]) & (sides[3] >= high[1])
        return rows.withColumns({"tile": (F.col("tx") + (1 << 30)) * (1 << 31) + F.col("ty") + (1 << 30), "shares": shares, "covered": whole & _rectangle()}).drop("e", "tx", "ty")

    def box(self, tile: int) -> Box:
        if self.tree is not None:
            return self.tree.box(tile)
        tx, ty = (tile >> 31) - (1 << 30), (tile & (1 << 31) - 1) - (1 << 30)
        return tx * self.size, ty * self.size, (tx + 1) * self.size, (ty + 1) * self.size

    @property
    def block(self) -> float:
        return self.size if self.tree is None else self.tree.widest


def _rings(row) -> list[np.ndarray]:
    as_array = lambda ring: np.array([(p["x"], p["y"]) for p in ring], float)
    return [as_array(row.ring), *(as_array(h) for h in (row.holes if row.holes is not None else []))]


def _with_holes(rows: DataFrame) -> DataFrame:
    return rows if "holes" in rows.columns else rows.withColumn("holes", F.lit(None).cast(f"array<{RING}>"))


def _points(shape: list[tuple[float, float]]) -> list[dict]:
    return [{"x": x, "y": y} for x, y in shape]


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each group from batches that are sorted by it."""
    open_: list[pd.DataFrame] = []
    name: tuple | None = None
    for pdf in batches:
        number = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                mine = tuple(None if pd.isna(v) else v for v in (pdf[c].iloc[a] for c in by))
                if open_ and mine != name:
                    yield pd.concat(open_, ignore_index=True)
                    open_ = []
                name = mine
                open_.append(pdf.iloc[a:b])
    if open_:
        yield pd.concat(open_, ignore_index=True)


def _filled(pdf: pd.DataFrame, box: Box) -> pd.DataFrame:
    """Rows without a ring stand for the whole tile."""
    if not pdf["ring"].isna().any():
        return pdf
    x0, y0, x1, y1 = box
    whole = _points([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])
    return pdf.assign(ring=[whole if r is None else r for r in pdf["ring"]])


def _told_by(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a tile (and key) side by side. The number of tasks is set, since much is made of few bytes, by which Spark would put all into a few tasks."""
    spark = rows.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, *by).sortWithinPartitions(*by)


#: A tile's job: its rows as (polygons, rule, key of each label).
Each = Callable[[pd.DataFrame], Iterator[tuple[list[list[np.ndarray]], Rule, Callable[[int], object]]]]


#: Rows that a worker hands on at once.
BATCH = 2000
#: What is left of the good features in their tiles, and the envelopes (key, e) of rectangles that stay whole.
Reduced = tuple[DataFrame, DataFrame | None]


class Parts:
    """A result of set algebra: as trapezoids (``trapezoids``) or as polygons with holes (``polygons``), both lazy but for the tiles.

    ``by`` names what a job is: a tile, or a tile and a key. ``reduced`` takes out rows that can't tell in their tiles.
    """

    def __init__(self, rows: DataFrame, each: Each, key: str, by: list[str], reduced: Callable[[_Plane, DataFrame], Reduced], tile: float | None, capacity: int):
        rows = _good(rows)
        self.plane, self.each, self.key, self.by, self.kind = _Plane(rows, tile, capacity), each, key, by, dict(rows.dtypes)[key]
        self.rows, self.whole = reduced(self.plane, rows)

    def trapezoids(self) -> DataFrame:
        each, plane, key, by = self.each, self.plane, self.key, self.by

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: list[tuple] = []
            for pdf in _groups(batches, by):
                box = plane.box(int(pdf["tile"].iloc[0]))
                found += [(name(n), _points(s)) for polygons, rule, name in each(_filled(pdf, box)) for n, s in trapezoids(polygons, rule, box)]
                if len(found) >= BATCH:
                    yield pd.DataFrame(found, columns=[key, "ring"])
                    found = []
            yield pd.DataFrame(found, columns=[key, "ring"])

        out = _told_by(self.rows, by).mapInPandas(run, f"{key} {self.kind}, ring {RING}")
        if self.whole is None:
            return out
        return out.unionByName(self.whole.select(key, G.rectangle(*[F.col(f"e.{n}") for n in ("min_x", "min_y", "max_x", "max_y")]).alias("ring")).where(G.area(F.col("ring")) > LEAST_AREA))

    def polygons(self) -> DataFrame:
        """(key, ring, holes): a row for each connected polygon, rings with the inside on their left. Corners are rounded to ``GRID`` steps a unit.

        The tiles' pieces are written once, as a checkpoint, since they are read for links and for sides.
        """
        each, plane, key, by = self.each, self.plane, self.key, self.by
        side = "struct<x0:long,y0:long,x1:long,y1:long,line:array<double>>"
        edge = "struct<axis:int,at:long,p:long,q:long>"
        columns = [key, "tile", "n", "sides", "border"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, out = ["x0", "y0", "x1", "y1", "line"], []
            # Pieces are numbered in their task, since the keys of a tile may be in several.
            n = TaskContext.get().partitionId() << 36
            for pdf in _groups(batches, by):
                tile = int(pdf["tile"].iloc[0])
                box = plane.box(tile)
                for polygons, rule, name in each(_filled(pdf, box)):
                    inner, border = pieces(polygons, rule, box)
                    found: dict[tuple, tuple[list, list]] = defaultdict(lambda: ([], []))
                    for what, me, *rest in inner:
                        found[what, me][0].append(dict(zip(names, rest, strict=True)))
                    for what, me, *rest in border:
                        found[what, me][1].append(dict(zip(("axis", "at", "p", "q"), rest, strict=True)))
                    for (what, _), (inside, outside) in found.items():
                        out.append((name(what), tile, n, inside, outside))
                        n += 1
                if len(out) >= BATCH:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

        found = _told_by(self.rows, by).mapInPandas(run, f"{key} {self.kind}, tile long, n long, sides array<{side}>, border array<{edge}>")
        found = found.withColumn("piece", F.struct("tile", "n")).drop("tile", "n").checkpoint()
        step = float(plane.block * GRID)
        edges = found.select(key, "piece", F.explode("border").alias("b")).select(key, "piece", "b.*", F.floor(F.least("b.p", "b.q") / step).alias("block"))

        def meet(pdf: pd.DataFrame) -> pd.DataFrame:
            axis, at, out = int(pdf["axis"].iloc[0]), int(pdf["at"].iloc[0]), []
            for name, rows in pdf.groupby(key, dropna=False):
                ids = [(p["tile"], p["n"]) for p in rows["piece"]]
                number = {v: i for i, v in enumerate(dict.fromkeys(ids))}
                back = list(number)
                left, met = _balance([(p, q, 1, number[i]) for p, q, i in zip(rows["p"].tolist(), rows["q"].tolist(), ids, strict=True)])
                as_piece = lambda i: {"tile": back[i][0], "n": back[i][1]}  # noqa: B023, E731
                for p, q, sign, me in left:
                    p, q = (p, q) if sign > 0 else (q, p)
                    ends = (p, at, q, at) if axis == 0 else (at, p, at, q)
                    out.append((name, as_piece(me), None, dict(zip(("x0", "y0", "x1", "y1"), ends, strict=True)) | {"line": None}))
                out += [(name, as_piece(a), as_piece(b), None) for a, b in sorted(met)]
            return pd.DataFrame(out, columns=[key, "piece", "other", "side"])

        piece = "struct<tile:long,n:long>"
        met = edges.groupBy("axis", "at", "block").applyInPandas(meet, f"{key} {self.kind}, piece {piece}, other {piece}, side {side}").checkpoint()
        roots = connected(met.where("other is not null").select(F.col("piece").alias("a"), F.col("other").alias("b")))
        sides = found.select(key, "piece", F.col("sides")).unionByName(met.where("side is not null").select(key, "piece", F.array("side").alias("sides")))
        whole = sides.join(roots.withColumnRenamed("node", "piece"), "piece", "left").withColumn("root", F.coalesce("root", "piece"))

        def close(pdf: pd.DataFrame) -> pd.DataFrame:
            plain = [(s["x0"], s["y0"], s["x1"], s["y1"], None if s["line"] is None else tuple(s["line"])) for part in pdf["sides"] for s in part]
            ring, holes = linked(plain)
            return pd.DataFrame([(pdf[key].iloc[0], ring, holes)] if ring else [], columns=[key, "ring", "holes"])

        out = whole.groupBy("root").applyInPandas(close, f"{key} {self.kind}, ring {RING}, holes array<{RING}>")
        if self.whole is None:
            return out
        # As ``linked`` would tell them: corners on the grid, from the least one on.
        x0, y0, x1, y1 = (F.rint(F.col(f"e.{n}") * GRID) / GRID for n in ("min_x", "min_y", "max_x", "max_y"))
        return out.unionByName(self.whole.where((x0 < x1) & (y0 < y1)).select(key, G.rectangle(x0, y0, x1, y1).alias("ring"), F.array().cast(f"array<{RING}>").alias("holes")))


def _by_key(pdf: pd.DataFrame) -> Iterator[tuple[object, pd.DataFrame]]:
    for name, rows in pdf.groupby("key", dropna=False):
        yield (None if pd.isna(name) else name), rows


def _covered(dealt: DataFrame) -> DataFrame:
    """(tile, key) where one row covers the whole tile."""
    return dealt.where("covered").select("tile", "key").distinct().checkpoint()


_SAME = "__rows.tile = __full.tile and __rows.key <=> __full.key"


def _beside(dealt: DataFrame, full: DataFrame) -> DataFrame:
    """Rows of other tiles and keys than the covered ones."""
    return dealt.alias("__rows").join(counted(full, FEW_PAIRS).alias("__full"), F.expr(_SAME), "left_anti")


def _union_reduced(plane: _Plane, rows: DataFrame) -> Reduced:
    """Of a covered tile's rows one is left, without a ring."""
    dealt = plane.dealt(rows)
    full = _covered(dealt)
    return _beside(dealt, full).select("tile", "key", "ring", "holes").unionByName(full, allowMissingColumns=True), None


def _clip_reduced(outside: bool) -> Callable[[_Plane, DataFrame], Reduced]:
    """Masks as in a union. Rectangles that lie in covered tiles alone stay as they are, or outside go."""

    def reduced(plane: _Plane, rows: DataFrame) -> Reduced:
        mine, masks = rows.where("role = 0").drop("role"), plane.dealt(rows.where("role = 1"))
        full = _covered(masks)
        seen = plane.dealt(mine.withColumn("plain", _rectangle())).select("id", "key", "tile", "shares", "plain")
        seen = seen.alias("__rows").join(counted(full.withColumn("hit", F.lit(True)), FEW_PAIRS).alias("__full"), F.expr(_SAME), "left")
        sure = seen.groupBy("id").agg(F.bool_and(F.expr("plain and (hit is not null or not shares)")).alias("sure")).where("sure").select("id").checkpoint()
        left = plane.dealt(mine.join(shuffled(sure), "id", "left_anti"))
        whole = None if outside else mine.join(shuffled(sure), "id", "left_semi").select("id", G.envelope(F.col("ring")).alias("e"))
        columns = ["tile", "key", "id", "ring", "holes", "role"]
        out = _beside(masks, full).select(columns).unionByName((_beside(left, full) if outside else left).withColumn("role", F.lit(0)).select(columns))
        if not outside:  # where its key has no mask, nothing of a feature is left
            met = masks.select("tile", "key").distinct()
            out = out.alias("__rows").join(shuffled(met).alias("__full"), F.expr(_SAME), "left_semi")
        # Outside of a covered tile's mask there is nothing, so its mask isn't needed.
        return out if outside else out.unionByName(full.withColumn("role", F.lit(1)), allowMissingColumns=True), whole

    return reduced


def _overlay_reduced(plane: _Plane, rows: DataFrame) -> Reduced:
    """What comes after the first row that covers the whole tile is hidden there."""
    dealt = plane.dealt(rows)
    covers = dealt.where("covered and ord is not null").where(~F.isnan(F.col("weight").cast("double")) & F.col("weight").isNotNull())
    best = covers.groupBy("tile", "weight").agg(F.min("ord").alias("ord")).groupBy("tile").agg(F.max(F.struct("weight", "ord")).alias("best")).checkpoint()
    seen = dealt.join(counted(best, FEW_PAIRS), "tile", "left").where("best is null or weight > best.weight or (weight = best.weight and ord <= best.ord)")
    return seen.select("tile", "id", "weight", "ord", "ring", "holes"), None


def union_parts(features: DataFrame, key: str, tile: float | None = None, capacity: int = KEYED_CAPACITY) -> Parts:
    """The union of each key's features (ring, maybe holes)."""

    def each(pdf: pd.DataFrame) -> Iterator[tuple]:
        for name, rows in _by_key(pdf):
            yield [_rings(r) for r in rows.itertuples()], union_rule, lambda _, name=name: name

    return Parts(_with_holes(features).select(F.col(key).alias("key"), "ring", "holes"), each, "key", ["tile", "key"], _union_reduced, tile, capacity)


def clip_parts(features: DataFrame, masks: DataFrame, key: str | None = None, tile: float | None = None, outside: bool = False, capacity: int = KEYED_CAPACITY) -> Parts:
    """The part of each feature (id, ring, maybe holes) in the union of the masks of its key, or with ``outside`` in none; without a key all masks count."""
    pick = lambda t, role, i: _with_holes(t).select((F.col(key) if key else F.lit(0)).alias("key"), i.alias("id"), "ring", "holes", F.lit(role).alias("role"))
    both = pick(features, 0, F.col("id").cast("long")).unionByName(pick(masks, 1, F.lit(None).cast("long")))

    def each(pdf: pd.DataFrame) -> Iterator[tuple]:
        for _, rows in _by_key(pdf):
            masks = [_rings(r) for r in rows[rows["role"] == 1].itertuples()]
            mine = rows[rows["role"] == 0]
            if len(mine) and (masks or outside):
                ids, n = mine["id"].tolist(), len(masks)
                yield masks + [_rings(r) for r in mine.itertuples()], clip_rule(n, outside), lambda k, ids=ids, n=n: int(ids[k - n])

    return Parts(both, each, "id", ["tile", "key"], _clip_reduced(outside), tile, capacity)


def overlay_parts(features: DataFrame, tile: float | None = None, capacity: int = CAPACITY) -> Parts:
    """Each feature (id, weight, ord, ring) without what heavier ones cover; of equal weight the smaller ord goes first."""

    def each(pdf: pd.DataFrame) -> Iterator[tuple]:
        rows = pdf.sort_values(["weight", "ord"], ascending=[False, True])
        ids = rows["id"].tolist()
        yield [_rings(r) for r in rows.itertuples()], first_rule, lambda k: int(ids[k])

    return Parts(_with_holes(features).select(F.col("id").cast("long").alias("id"), "weight", "ord", "ring", "holes"), each, "id", ["tile"], _overlay_reduced, tile, capacity)


def dissolved(features: DataFrame, key: str, tile: float | None = None) -> DataFrame:
    """(key, ring): trapezoids of the union of each key's features (ring, maybe holes); they don't overlap, so their areas add up."""
    return union_parts(features, key, tile).trapezoids().withColumnRenamed("key", key)


def dissolved_polygons(features: DataFrame, key: str, tile: float | None = None) -> DataFrame:
    """(key, ring, holes): the same as polygons, one for each connected part."""
    return union_parts(features, key, tile).polygons().withColumnRenamed("key", key)


def clipped(features: DataFrame, masks: DataFrame, key: str | None = None, tile: float | None = None, outside: bool = False) -> DataFrame:
    """(id, ring): trapezoids of what ``clip_parts`` says; what is left of nothing has no row."""
    return clip_parts(features, masks, key, tile, outside).trapezoids()


def clipped_polygons(features: DataFrame, masks: DataFrame, key: str | None = None, tile: float | None = None, outside: bool = False) -> DataFrame:
    """The features' other columns with (ring, holes) of their parts in the masks, a row for each connected part. ``id`` names one feature."""
    parts = clip_parts(features, masks, key, tile, outside).polygons()
    return features.drop("ring", "holes").join(parts, "id")


def overlay(features: DataFrame, tile: float | None = None) -> DataFrame:
    """(id, ring): trapezoids of what ``overlay_parts`` says."""
    return overlay_parts(features, tile).trapezoids()


def overlay_polygons(features: DataFrame, tile: float | None = None) -> DataFrame:
    """(id, ring, holes): the same as polygons."""
    return overlay_parts(features, tile).polygons()


def _alike(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, ring) of one id of all that have the same rings, and (id, own) with that id for each."""
    every = _good(features.select("id", "ring")).groupBy("id").agg(F.sort_array(F.collect_list("ring")).alias("rings")).checkpoint()
    first = every.groupBy("rings").agg(F.min("id").alias("own"))
    named = every.join(counted(first), "rings").select("id", "own")
    return first.select(F.col("own").alias("id"), F.explode("rings").alias("ring")), named


def repaired(features: DataFrame, tile: float | None = None) -> DataFrame:
    """(id, ring): trapezoids of the area that features (id, ring) enclose, whatever loops their rings make; equal rings are repaired once."""
    first, named = _alike(features)
    parts = dissolved(first, "id", tile).withColumnRenamed("id", "own")
    return named.alias("__n").join(shuffled(parts).alias("__p"), F.expr("__n.own <=> __p.own")).select("__n.id", "__p.ring")


def repaired_polygons(features: DataFrame, tile: float | None = None) -> DataFrame:
    """(id, ring, holes): the same as polygons without crossings."""
    first, named = _alike(features)
    parts = dissolved_polygons(first, "id", tile).withColumnRenamed("id", "own")
    return named.alias("__n").join(shuffled(parts).alias("__p"), F.expr("__n.own <=> __p.own")).select("__n.id", "__p.ring", "__p.holes")


def areas(parts: DataFrame, key: str) -> DataFrame:
    """Area of each key's parts; keys without one, or with nothing but slivers, have no row."""
    return parts.groupBy(key).agg(F.sum(G.area(F.col("ring"))).alias("area")).where(F.col("area") > LEAST_AREA)


def exploded(features: DataFrame, kind: str = "kind", coordinates: str = "coordinates") -> DataFrame:
    """A row for each polygon of features whose coordinates are JSON text: part (from 0), ring, holes; other kinds have none."""
    one = F.from_json(F.col(coordinates), "array<array<array<double>>>")
    many = F.from_json(F.col(coordinates), "array<array<array<array<double>>>>")
    polygons = F.when(F.col(kind) == "Polygon", F.array(one)).when(F.col(kind) == "MultiPolygon", many)
    as_ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rows = features.select("*", F.posexplode(polygons).alias("part", "rings")).where(F.size("rings") > 0)
    return rows.withColumns({"ring": as_ring(F.col("rings")[0]), "holes": F.transform(F.slice("rings", 2, 1 << 30), as_ring)}).drop("rings")


def cell_rings(labelled: DataFrame, x_min: float, y_max: float, res: float) -> DataFrame:
    """(label, value, ring): boundary rings of labelled cells (row, col, value, label), corners only; outer ones run one way and holes the other.

    Sides that two cells of a label share fall away before any label's sides are brought together to be linked.
    """
    r, c = F.col("row"), F.col("col")
    side = lambda a, b, d, e: F.struct(a.alias("r0"), b.alias("c0"), d.alias("r1"), e.alias("c1"))
    four = F.array(side(r, c, r, c + 1), side(r, c + 1, r + 1, c + 1), side(r + 1, c + 1, r + 1, c), side(r + 1, c, r, c))
    sides = labelled.select("label", "value", F.explode(four).alias("s"))
    ends = [F.struct(F.col(f"s.r{i}").alias("r"), F.col(f"s.c{i}").alias("c")) for i in (0, 1)]
    low, high = F.least(*ends), F.greatest(*ends)
    alone = sides.groupBy("label", "value", low.alias("a"), high.alias("b")).agg(F.count("*").alias("n"), F.first("s").alias("s")).where("n = 1").select("label", "value", "s.*")

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        follow: dict[tuple, list[tuple]] = {}
        for a, b, d, e in pdf[["r0", "c0", "r1", "c1"]].sort_values(["r0", "c0", "r1", "c1"]).itertuples(index=False):
            follow.setdefault((a, b), []).append((d, e))
        found = []
        for start in sorted(follow):
            while follow[start]:
                ring, at = [start], follow[start].pop()
                way = (at[0] - start[0], at[1] - start[1])
                while at != start:
                    # Where two rings touch the way on is a right turn, which keeps cells that meet in a corner apart.
                    ends = follow[at]
                    turn = max(range(len(ends)), key=lambda k: way[1] * (ends[k][0] - at[0]) - way[0] * (ends[k][1] - at[1]))
                    to = ends.pop(turn)
                    if (to[0] - at[0], to[1] - at[1]) != way:
                        ring.append(at)
                    at, way = to, (to[0] - at[0], to[1] - at[1])
                ring.append(start)
                found.append([{"x": x_min + p[1] * res, "y": y_max - p[0] * res} for p in ring])
        return pd.DataFrame({"label": pdf["label"].iloc[0], "value": pdf["value"].iloc[0], "ring": found})

    kinds = dict(labelled.dtypes)
    return alone.groupBy("label", "value").applyInPandas(linked, f"label {kinds['label']}, value {kinds['value']}, ring {RING}")


def _tiled(features: DataFrame, tile: float) -> DataFrame:
    """Features once for each tile that their envelope covers: tx, ty."""
    e = G.envelope(F.col("ring"))
    span = lambda lo, hi: F.sequence(F.floor(lo / tile), F.greatest(F.ceil(hi / tile) - 1, F.floor(lo / tile)))
    rows = features.where(F.size("ring") > 2).withColumn("e", e)
    return rows.withColumn("tx", F.explode(span(F.col("e.min_x"), F.col("e.max_x")))).withColumn("ty", F.explode(span(F.col("e.min_y"), F.col("e.max_y")))).drop("e")


def in_any(points: DataFrame, shapes: DataFrame, tile: float = 100.0) -> DataFrame:
    """Points (x, y and others) that lie in at least one shape (ring): the semi-join with a union, by tiles."""
    keyed = points.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})
    # Equal shapes are one; an envelope is cheaper to look at than a ring.
    near = _tiled(shapes.select("ring").distinct(), tile).withColumn("e", G.envelope(F.col("ring")))
    meets = F.expr("__points.tx = __shapes.tx and __points.ty = __shapes.ty and __points.x between __shapes.e.min_x and __shapes.e.max_x and __points.y between __shapes.e.min_y and __shapes.e.max_y")
    inside = meets & G.contains(F.col("__shapes.ring"), F.col("__points.x"), F.col("__points.y"))
    return keyed.alias("__points").join(counted(near).alias("__shapes"), inside, "left_semi").drop("tx", "ty")
