"""Rings of set algebra across tiles of any size, adaptive tiles, and rings that are left out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanspark.operators import polygons, spatialjoin, tiling

RING = polygons.RING
ROW = f"id long, parcel string, weight int, ord int, ring {RING}, holes array<{RING}>"


def ring(points):
    points = [*points, points[0]]
    return [{"x": float(x), "y": float(y)} for x, y in points]


def shapes(n, seed, whole=False):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x, y = rng.integers(0, 20, 2) if whole else rng.uniform(0, 20, 2)
        if whole or i % 3 == 0:
            w, h = rng.integers(1, 7, 2)
            points = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        else:
            k = int(rng.integers(3, 7))
            angle = np.sort(rng.uniform(0, 2 * np.pi, k))
            points = list(zip(x + rng.uniform(1, 5, k) * np.cos(angle), y + rng.uniform(1, 5, k) * np.sin(angle), strict=True))
        out.append((i, "ab"[i % 2], int(rng.integers(0, 4)), i, ring(points[:: 1 if i % 2 else -1]), None))
    return out


def canonical(rows, key):
    """Each polygon as (key, corners rounded); rings begin at their least corner by construction."""
    as_text = lambda r: tuple((round(p["x"], 4), round(p["y"], 4)) for p in r)
    return sorted(((r[key], as_text(r["ring"]), tuple(sorted(map(as_text, r["holes"])))) for r in rows.collect()), key=str)


def total(rows):
    def shoelace(r):
        return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(r, r[1:], strict=False)) / 2

    out = {}
    for r in rows if isinstance(rows, list) else rows.collect():
        k = r[0]
        out[k] = out.get(k, 0.0) + shoelace(r["ring"]) + sum(shoelace(h) for h in r["holes"])
    return {k: round(v, 3) for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_polygons_do_not_depend_on_tiles(spark, seed):
    df = spark.createDataFrame(shapes(24, seed), ROW)
    few = spark.createDataFrame(shapes(5, seed + 50), ROW)
    for make, key in (
        (lambda t: polygons.dissolved_polygons(df, "parcel", t), "parcel"), (lambda t: polygons.overlay_polygons(df, t), "id"),
        (lambda t: polygons.clipped_polygons(df, few, None, t).select("id", "ring", "holes"), "id"),
    ):
        whole = canonical(make(64.0), key)
        areas = total(make(64.0))
        assert whole
        for tile in (5.0, 3.3):
            got = make(tile)
            assert total(got) == pytest.approx(areas, abs=2e-3)
            told = canonical(got, key)
            assert [(k, len(r), len(h)) for k, r, h in told] == [(k, len(r), len(h)) for k, r, h in whole]


def test_tree_tiles_give_the_same(spark):
    df = spark.createDataFrame(shapes(60, 7), ROW)
    parts = polygons.union_parts(df, "parcel", None, 8)
    assert len(parts.plane.tree) > 4
    assert canonical(parts.polygons(), "key") == canonical(polygons.union_parts(df, "parcel", 64.0).polygons(), "key")


def test_polygons_and_holes_against_flood_fill(spark):
    rows = shapes(40, 11, whole=True)
    got = polygons.dissolved_polygons(spark.createDataFrame(rows, ROW), "parcel", 4.0).collect()
    for key in "ab":
        grid = np.zeros((40, 40), bool)
        for _, parcel, _, _, r, _ in rows:
            if parcel == key:
                xs, ys = [p["x"] for p in r], [p["y"] for p in r]
                grid[int(min(ys)) + 1 : int(max(ys)) + 1, int(min(xs)) + 1 : int(max(xs)) + 1] = True

        def parts(mask):
            left, n = {(int(a), int(b)) for a, b in zip(*np.nonzero(mask), strict=True)}, 0
            while left:
                todo, n = [left.pop()], n + 1
                while todo:
                    a, b = todo.pop()
                    for c in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if c in left:
                            left.remove(c)
                            todo.append(c)
            return n

        mine = [r for r in got if r["parcel"] == key]
        assert len(mine) == parts(grid) and sum(len(r["holes"]) for r in mine) == parts(~grid) - 1
        assert total(mine)[key] == grid.sum()


def test_an_eight_becomes_two_triangles(spark):
    df = spark.createDataFrame([(1, "p", 0, 0, ring([(0, 0), (4, 4), (4, 0), (0, 4)]), None)], ROW)
    got = canonical(polygons.repaired_polygons(df, 3.0), "id")
    assert [(k, len(r), len(h)) for k, r, h in got] == [(1, 4, 0), (1, 4, 0)]


def test_bad_rings_are_named_and_left_out(spark):
    good = ring([(0, 0), (1, 0), (1, 1)])
    rows = [(1, "p", 0, 0, good, None), (2, "p", 0, 0, None, None), (3, "p", 0, 0, good[:2], None), (4, "p", 0, 0, [*good[:3], {"x": float("nan"), "y": 0.0}], None), (5, "p", 0, 0, [*good[:3], None], None), (6, "p", 0, 0, good[:3] + [{"x": 5.0, "y": 5.0}], None)]
    df = spark.createDataFrame(rows, ROW)
    assert {r["id"]: r["reason"] for r in polygons.bad_rings(df).collect()} == {2: "no ring", 3: "fewer than three corners", 4: "a coordinate is missing or not finite", 5: "a coordinate is missing or not finite", 6: "not closed"}
    assert polygons.dissolved_polygons(df.where("id < 6"), "id").collect()[0]["id"] == 1
    assert polygons.dissolved_polygons(df.limit(0), "parcel").count() == 0 and polygons.overlay_polygons(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="multiple"):
        polygons.dissolved_polygons(df, "id", 1 / 3)


# Adaptive tiles


def test_leaves_split_where_points_are_dense():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.uniform(0, 1000, 2000), rng.normal(500, 0.001, 2000)])
    y = np.concatenate([rng.uniform(-50, 300, 2000), rng.normal(100, 0.001, 2000)])
    tree = tiling.build(x, y, 4000, (x.min(), y.min(), x.max(), y.max()), 100, 12)
    leaf = tree.of(x, y)
    for i in range(0, 4000, 97):
        b = tree.box(int(leaf[i]))
        assert b[0] <= x[i] < b[2] and b[1] <= y[i] < b[3]
    assert sum((tree.box(k)[2] - tree.box(k)[0]) ** 2 for k in range(len(tree))) == tree.side**2
    assert tree.slots.max() > 1 and (np.bincount(leaf, minlength=len(tree)) / tree.slots).max() <= 100
    a, b, w, h = rng.uniform(-100, 1100, 200), rng.uniform(-100, 400, 200), rng.uniform(0, 200, 200), rng.uniform(0, 100, 200)
    row, found = tree.covering(a, b, a + w, b + h)
    far = tree.side * (1 - 1e-12)
    clip = lambda v, o: np.clip(v, o, o + far)
    for i in range(200):
        boxes = np.array([tree.box(k) for k in range(len(tree))])
        want = (boxes[:, 0] <= clip(a[i] + w[i], tree.x)) & (boxes[:, 2] > clip(a[i], tree.x)) & (boxes[:, 1] <= clip(b[i] + h[i], tree.y)) & (boxes[:, 3] > clip(b[i], tree.y))
        assert found[row == i].tolist() == np.flatnonzero(want).tolist()


def test_half_of_all_points_in_one_place(spark):
    k = F.col("id")
    points = spark.range(20_000).select("id", F.when(k % 2 == 0, F.lit(3.0)).otherwise((k * 37 % 997).cast("double")).alias("x"), F.when(k % 2 == 0, F.lit(4.0)).otherwise((k * 61 % 991).cast("double")).alias("y"))
    boxes = spark.range(200).select(F.col("id").alias("box"), (F.col("id") * 5.0).alias("min_x"), (F.col("id") * 3.0).alias("min_y"), (F.col("id") * 5.0 + 20).alias("max_x"), (F.col("id") * 3.0 + 30).alias("max_y"))
    tree = tiling.tree_of(points, 500)
    per = [r["count"] for r in tiling.dealt_points(points, tree).groupBy("leaf", "slot").count().collect()]
    assert max(per) <= 2 * 500 and sum(per) == 20_000
    same = lambda rows: sorted((r["id"], r["box"]) for r in rows.select("id", "box").collect())
    assert same(spatialjoin.quadtree_join(points, boxes, 500)) == same(spatialjoin.range_join(points, boxes, 50.0))
    odd = spark.createDataFrame([(1, float("nan"), 1.0), (2, None, 1.0), (3, 1e300, 5.0), (4, 5.0, 5.0)], "id long, x double, y double")
    assert [r["id"] for r in spatialjoin.quadtree_join(odd, boxes).where("box = 0").collect()] == [4]
    assert spatialjoin.quadtree_join(points.limit(0), boxes).count() == 0
