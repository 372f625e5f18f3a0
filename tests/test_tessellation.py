"""Cells of footprints against a fine raster and against all bisectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from urbanspark.operators import tessellation as T

ROW = "id long, ring array<struct<x:double,y:double>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


def box(x, y, w, h):
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def shoelace(r):
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(r, r[1:], strict=False)) / 2


ROWS = [(1, box(0, 0, 10, 8)), (2, box(20, 3, 6, 12)), (3, ring((5, 25), (15, 22), (12, 34))), (4, box(60, 60, 5, 5)), (5, box(27, 3, 4, 4)), (7, None), (8, box(1e6, 1e6, 3, 3))]


@pytest.mark.parametrize(("halo", "capacity"), [(3.0, 10), (500.0, 10_000)])
def test_cells_against_a_raster_of_nearest_points(spark, halo, capacity):
    limit, segment, step = 12.0, 2.0, 0.25
    df = spark.createDataFrame(ROWS, ROW)
    got = T.tessellation(df, limit, segment, halo, capacity).collect()
    points = T.outline_points(df, segment).collect()
    area = {}
    for r in got:
        assert abs(shoelace(r["ring"]) + sum(map(shoelace, r["holes"])) - r["area"]) < 1e-6 and shoelace(r["ring"]) > 0
        area[r["id"]] = area.get(r["id"], 0.0) + r["area"]
    px = np.array([(p["x"], p["y"]) for p in points if p["id"] != 8])
    owner = np.array([p["id"] for p in points if p["id"] != 8])
    gx, gy = np.meshgrid(np.arange(-15, 85, step) + step / 2, np.arange(-15, 85, step) + step / 2)
    at = np.stack([gx.ravel(), gy.ravel()], 1)
    best, who = np.full(len(at), np.inf), np.zeros(len(at), int)
    for p, o in zip(px, owner, strict=True):
        d = ((at - p) ** 2).sum(1)
        near = d < best
        best[near], who[near] = d[near], o
    for i in (1, 2, 3, 4, 5):
        want = ((who == i) & (best <= limit**2)).sum() * step**2
        assert area[i] == pytest.approx(want, rel=0.02)  # chords for arcs, squares for cells
    assert set(area) == {1, 2, 3, 4, 5, 8}


def test_halves_of_the_way_between_equal_houses(spark):
    rows = [(r * 5 + c, box(c * 30.0 + 1e5, r * 24.0 + 2e6, 10, 8)) for r in range(5) for c in range(5)]
    got = {r["id"]: r for r in T.tessellation(spark.createDataFrame(rows, ROW), 100.0, 2.0, 10.0, 50).collect()}
    for r in range(1, 4):
        for c in range(1, 4):
            cell = got[r * 5 + c]
            assert cell["area"] == pytest.approx(720.0, abs=1e-4) and len(cell["ring"]) == 5 and not cell["holes"]
    assert T.tessellation(spark.createDataFrame([], ROW)).count() == 0


def test_a_disc_around_a_lone_point_like_house(spark):
    got = T.tessellation(spark.createDataFrame([(1, box(0, 0, 1e-3, 1e-3))], ROW), 10.0, 1.0).collect()
    assert got[0]["area"] == pytest.approx(72 * 100 * math.sin(2 * math.pi / 72) / 2, rel=1e-3)
