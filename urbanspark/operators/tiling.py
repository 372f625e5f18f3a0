"""Tiles that adapt to density: a quadtree of a bounded sample, whose leaves deal points and envelopes to tasks.

A leaf splits while it stands for more rows than its capacity; a spot too dense to split (many rows at one place)
gets several slots, among which its points are dealt and to each of which envelopes are copied. The sample decides
about balance alone, never about a result. The tree has some thousand leaves (a bound follows from the sample) and goes to the tasks with
their function.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a tree is built from, at most about so many; a leaf of the sample has 8 of them at least.
SAMPLE = 100_000
DEPTH = 24


@dataclass
class Tree:
    """Leaves in the order of their places along a Z-curve at the finest depth."""

    x: float
    y: float
    side: float
    depth: int
    first: np.ndarray  # where each leaf begins on the curve
    level: np.ndarray
    slots: np.ndarray

    def __len__(self) -> int:
        return len(self.first)

    def _cells(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = 1 << self.depth
        at = lambda v, o: np.clip(np.floor((v - o) * (n / self.side)), 0, n - 1).astype(np.int64)
        return at(x, self.x), at(y, self.y)

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The leaf of each point; points outside count as on the rim, and any without a number as in the first leaf."""
        return np.searchsorted(self.first, _curve(*self._cells(np.nan_to_num(x), np.nan_to_num(y)), self.depth), side="right") - 1

    def covering(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs of envelopes and the leaves that they meet, sides included."""
        (a, b), (c, d) = self._cells(x0, y0), self._cells(x1, y1)
        row, kx, ky, out = np.arange(len(a)), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), []
        for level in range(self.depth + 1):
            shift = self.depth - level
            meets = (kx <= c[row] >> shift) & (kx >= a[row] >> shift) & (ky <= d[row] >> shift) & (ky >= b[row] >> shift)
            row, kx, ky = row[meets], kx[meets], ky[meets]
            begin = _curve(kx << shift, ky << shift, self.depth)
            leaf = np.searchsorted(self.first, begin, side="right") - 1
            done = self.level[leaf] <= level
            out.append((row[done], leaf[done]))
            row, kx, ky = (np.repeat(v[~done], 4) for v in (row, kx, ky))
            k = np.tile(np.arange(4), len(row) // 4)
            kx, ky = kx * 2 + (k & 1), ky * 2 + (k >> 1)
        rows, leaves = np.concatenate([r for r, _ in out]), np.concatenate([v for _, v in out])
        order = np.lexsort((leaves, rows))
        return rows[order], leaves[order]

    def box(self, leaf: int) -> tuple[float, float, float, float]:
        kx, ky = _place(int(self.first[leaf]), self.depth)
        w, cell = self.side / 2 ** int(self.level[leaf]), self.side / 2**self.depth
        return self.x + kx * cell, self.y + ky * cell, self.x + kx * cell + w, self.y + ky * cell + w

    def boxes(self) -> np.ndarray:
        """The box of every leaf."""
        return np.array([self.box(i) for i in range(len(self))], float)

    @property
    def widest(self) -> float:
        return self.side / 2 ** int(self.level.min())


def _spread(v: np.ndarray) -> np.ndarray:
    """A zero between any two bits."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | v << shift) & mask
    return v


def _curve(kx: np.ndarray, ky: np.ndarray, depth: int) -> np.ndarray:
    return _spread(kx) | _spread(ky) << 1


def _place(code: int, depth: int) -> tuple[int, int]:
    bits = lambda shift: sum((code >> 2 * i + shift & 1) << i for i in range(depth))
    return bits(0), bits(1)


def build(x: np.ndarray, y: np.ndarray, rows: float, box: tuple[float, float, float, float], capacity: int, depth: int = DEPTH, least: float = 0.0) -> Tree:
    """A tree over a box for sampled points that stand for ``rows`` rows; corners of leaves are exact doubles."""
    x0, y0 = float(math.floor(box[0])), float(math.floor(box[1]))
    side = 2.0 ** math.ceil(math.log2(max(box[2] - x0, box[3] - y0, 1.0) * (1 + 1e-9)))
    depth = min(depth, max(0, math.floor(math.log2(side / least)))) if least else depth
    tree = Tree(x0, y0, side, depth, np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64))
    codes = np.sort(_curve(*tree._cells(x, y), depth))
    each = rows / max(1, len(codes)) or 1.0
    most = max(capacity / each, 8.0)
    found, todo = [], [(0, 0, 0, len(codes))]
    while todo:
        level, begin, a, b = todo.pop()
        if b - a <= most or level == depth:
            found.append((begin, level, max(1, math.ceil((b - a) / most))))
            continue
        size = 1 << 2 * (depth - level - 1)
        cuts = [a, *(int(np.searchsorted(codes[a:b], begin + size * k)) + a for k in (1, 2, 3)), b]
        todo += [(level + 1, begin + size * k, cuts[k], cuts[k + 1]) for k in range(4)]
    first, level, slots = np.array(sorted(found), np.int64).T
    return Tree(x0, y0, side, depth, first, level, slots)


def tree_of(points: DataFrame, capacity: int, sample: int = SAMPLE, depth: int = DEPTH, least: float = 0.0) -> Tree:
    """The tree of a table's points (x, y), its leaves no smaller than ``least``; those with a coordinate that is null or not finite don't count. An empty table has one leaf.

    With columns min_x, min_y, max_x, max_y the tree covers these envelopes, and not the points alone.
    """
    wide = "min_x" in points.columns
    rows = points.select(*[F.col(c).cast("double").alias(c) for c in (*"xy", *(("min_x", "min_y", "max_x", "max_y") if wide else ()))]).where("abs(x) < double('Infinity') and abs(y) < double('Infinity')")
    ends = [F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")] if wide else [F.min("x"), F.min("y"), F.max("x"), F.max("y")]
    n, *box = rows.agg(F.count("*"), *ends).first()
    if not n:
        return build(np.zeros(0), np.zeros(0), 0, (0.0, 0.0, 1.0, 1.0), capacity, depth, least)
    some = (rows if n <= sample else rows.sample(sample / n, seed=1)).collect()
    x, y = (np.array([r[i] for r in some], float) for i in (0, 1))
    return build(x, y, n, tuple(map(float, box)), capacity, depth, least)


def leaf_of(tree: Tree, x: Column, y: Column) -> Column:
    @F.pandas_udf("int")
    def leaf(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(tree.of(x.to_numpy(float), y.to_numpy(float)).astype(np.int32))

    return leaf(x.cast("double"), y.cast("double"))


def leaves_of(tree: Tree, x0: Column, y0: Column, x1: Column, y1: Column, marked: bool = False) -> Column:
    """All leaves that an envelope meets; none where it isn't finite.

    If marked, numbers are four times the leaf's, with 1 more where they share an area and 2 more where the envelope holds the whole leaf.
    """
    boxes = tree.boxes() if marked else None

    @F.pandas_udf("array<int>")
    def leaves(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        sides = [v.to_numpy(float) for v in (x0, y0, x1, y1)]
        good = np.isfinite(np.stack(sides)).all(0)
        row, leaf = tree.covering(*(v[good] for v in sides))
        if boxes is not None:
            (a, b, c, d), (e, f, g, h) = (v[good][row] for v in sides), boxes[leaf].T
            share = (a < g) & (c > e) & (b < h) & (d > f) & (a < c) & (b < d)
            leaf = leaf * 4 + share + 2 * ((a <= e) & (b <= f) & (c >= g) & (d >= h))
        parts = np.split(leaf.astype(np.int32), np.searchsorted(row, np.arange(1, good.sum())))
        out = np.empty(len(good), object)
        out[:] = [np.zeros(0, np.int32)] * len(good)
        for i, p in zip(np.flatnonzero(good).tolist(), parts, strict=False):
            out[i] = p
        return pd.Series(out)

    return leaves(*(c.cast("double") for c in (x0, y0, x1, y1)))


def _slots(tree: Tree, leaf: Column) -> Column:
    dense = np.flatnonzero(tree.slots > 1).tolist()
    if not dense:
        return F.lit(1)
    known = F.create_map(*[F.lit(v) for i in dense for v in (i, int(tree.slots[i]))])
    return F.coalesce(F.try_element_at(known, leaf), F.lit(1))


def dealt_points(points: DataFrame, tree: Tree) -> DataFrame:
    """Points (x, y, ...) with their leaf and, in a dense one, a slot by the row's own content."""
    rows = points.withColumn("leaf", leaf_of(tree, F.col("x"), F.col("y")))
    return rows.withColumn("slot", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in points.dtypes if not t.startswith("map")], F.monotonically_increasing_id()), _slots(tree, F.col("leaf"))).cast("int"))


def dealt_boxes(boxes: DataFrame, tree: Tree) -> DataFrame:
    """Boxes (min_x, min_y, max_x, max_y, ...) once for each leaf that they meet and each slot there."""
    rows = boxes.withColumn("leaf", F.explode(leaves_of(tree, F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"))))
    return rows.withColumn("slot", F.explode(F.sequence(F.lit(0), (_slots(tree, F.col("leaf")) - 1).cast("int"))))
