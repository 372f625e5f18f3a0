"""Shapes, shared walls and distances of footprints in cases that the queries' tables don't hold."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.operators import urban

SCHEMA = "id long, ring array<struct<x:double,y:double>>"


def closed(*points):
    return [*points, points[0]]


def test_smallest_rectangle_equals_a_search_over_angles():
    rng = np.random.default_rng(5)
    for _ in range(20):
        p = rng.normal(size=(rng.integers(3, 12), 2)) * (1, 3)
        _, short, long = urban._hull_area_and_sides(p)
        turns = np.linspace(0, np.pi, 7201)
        spans = [np.ptp(p @ np.stack([np.cos(turns + q), np.sin(turns + q)]), axis=0) for q in (0, np.pi / 2)]
        least = (spans[0] * spans[1]).min()
        assert short * long <= least + 1e-9 and short * long == pytest.approx(least, rel=2e-2)
        hull = urban.hull(p)
        edge = np.roll(hull, -1, axis=0) - hull
        side = edge[:, None, 0] * (p[None, :, 1] - hull[:, None, 1]) - edge[:, None, 1] * (p[None, :, 0] - hull[:, None, 0])
        assert (side > -1e-9).all()


def test_shapes_without_area_are_null_and_other_columns_stay(spark):
    rows = [(1, closed((0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)), 7), (2, closed((0.0, 0.0), (1.0, 1.0)), 7), (3, None, 7), (4, [], 7)]
    got = {r["id"]: r for r in urban.shape_measures(spark.createDataFrame(rows, SCHEMA + ", __hull int")).collect()}
    assert got[1]["convexity"] == pytest.approx(1.0) and got[1]["elongation"] == pytest.approx(3 / 4)
    assert all(got[i]["convexity"] is None and got[i]["elongation"] is None for i in (2, 3, 4)) and all(r["__hull"] == 7 for r in got.values())


def test_shared_walls_along_turned_and_long_fronts(spark):
    turn = np.radians(37.0)
    at = lambda x, y: (float(650000 + x * np.cos(turn) - y * np.sin(turn)), float(6800000 + x * np.sin(turn) + y * np.cos(turn)))
    house = lambda x0, y0, x1, y1: closed(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1))
    rows = [(1, house(0, 0, 300, 10)), (2, house(20, 10, 220, 20)), (3, house(300, 5, 320, 15)), (4, house(400, 0, 410, 10)), (5, [])]
    got = {r["id"]: r["shared"] for r in urban.shared_walls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == pytest.approx({1: 205.0, 2: 200.0, 3: 5.0, 4: 0.0, 5: 0.0}, abs=1e-3)


def test_distance_of_rings(spark):
    a, far = closed((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)), closed((7.0, 8.0), (9.0, 8.0), (9.0, 9.0))
    inside, point = closed((1.0, 1.0), (2.0, 1.0), (2.0, 2.0)), closed((2.0, 6.0), (2.0, 6.0))
    df = spark.createDataFrame([(i, a, b) for i, b in enumerate((far, inside, point))], "id long, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    got = [r["d"] for r in df.select("id", G.distance(F.col("a"), F.col("b")).alias("d")).orderBy("id").collect()]
    assert got == pytest.approx([5.0, 0.0, 2.0])
