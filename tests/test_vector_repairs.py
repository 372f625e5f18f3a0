"""Cases in which the library's own operators once lost data or left the stated rule."""

from __future__ import annotations

import math
from xml.etree import ElementTree

import numpy as np
import pytest

from urbanspark.core import BBox
from urbanspark.operators import graphs, polygons, solver, spatialjoin
from urbanspark.sources import requests


def test_paths_of_any_number_of_edges(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(50)], "a long, b long, length double")
    got = {r["node"]: r["dist"] for r in graphs.within_reach(chain, 100.0).where("source = 0").collect()}
    assert got == {i: float(i) for i in range(1, 51)}
    with pytest.raises(ValueError):
        graphs.within_reach(spark.createDataFrame([(1, 2, None)], "a long, b long, length double"), 1.0)


def test_neighbours_with_nulls_outliers_and_repeated_ids(spark):
    rows = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, None, 0.0), (4, float("nan"), 1.0), (5, 3.0, 0.0), (6, 1e6, 1e6), (5, 3.0, 0.0)]
    got = spatialjoin.knn(spark.createDataFrame(rows, "id long, x double, y double"), 2, 1.0).collect()
    near = {(r["id"], r["rank"]): r["other"] for r in got}
    assert near == {(1, 1): 2, (1, 2): 5, (2, 1): 1, (2, 2): 5, (5, 1): 2, (5, 2): 1, (6, 1): 5, (6, 2): 2}


def plain_solver(u, v, w, solid, h, rounds, alpha1, alpha2):
    """The stated sweep, a cell at a time."""
    n, lam = u.shape, np.zeros_like(u)
    diag = -2 * sum(1 / x**2 for x in h)
    for _ in range(rounds):
        for colour in (0, 1):
            old = lam.copy()
            for i in range(1, n[0] - 1):
                for j in range(1, n[1] - 1):
                    for k in range(1, n[2] - 1):
                        if (i + j + k) % 2 != colour or solid[i, j, k]:
                            continue
                        total = -2 * alpha1**2 * ((u[i + 1, j, k] - u[i - 1, j, k]) / (2 * h[0]) + (v[i, j + 1, k] - v[i, j - 1, k]) / (2 * h[1]) + (w[i, j, k + 1] - w[i, j, k - 1]) / (2 * h[2]))
                        for ax, d in ((0, 1), (0, -1), (1, 1), (1, -1), (2, 1), (2, -1)):
                            at = tuple(x + d * (a == ax) for a, x in enumerate((i, j, k)))
                            total += (old[i, j, k] if solid[at] else old[at]) / h[ax] ** 2
                        lam[i, j, k] = total / diag
    g = np.gradient(lam, *h)
    return [np.where(solid, 0.0, f + x / (2 * a * a)) for f, x, a in zip((u, v, w), g, (alpha1, alpha1, alpha2), strict=True)]


def test_solver_next_to_inner_solids():
    rng = np.random.default_rng(6)
    u, v, w = (rng.normal(size=(7, 6, 6)) for _ in range(3))
    solid = np.zeros(u.shape, bool)
    solid[3:5, 2:4, 1:4] = True
    want = plain_solver(u, v, w, solid, (2.0, 3.0, 1.5), 6, 1.0, 0.7)
    got = solver.solve_block(u, v, w, solid, 2.0, 3.0, 1.5, eps=0.0, rounds=6, alpha1=1.0, alpha2=0.7)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(got, want, strict=True))


def test_filter_is_read_by_a_parser():
    top = ElementTree.fromstring(requests.bbox_filter_xml(BBox(-1.5, 46.0, -1.25, 46.5)))
    assert top.tag == f"{{{requests.OGC}}}Filter" and top[0][0].text == "Geometry"
    envelope = top[0][1]
    assert envelope.attrib == {"srsName": "EPSG:4326"} and [x.text for x in envelope] == ["46 -1.5", "46.5 -1.25"]
    assert [requests.plain_number(x) for x in (12.0, 0.5, 1e21, -0.0)] == ["12", "0.5", "1000000000000000000000", "-0"]


def _ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


def test_polygon_algebra_on_slanted_shapes(spark):
    """Areas against a fine sampling of the plane."""
    shapes = {1: _ring((0, 0), (10, 2), (4, 9)), 2: _ring((2, 1), (9, 8), (1, 7)), 3: _ring((5, 0), (12, 5), (6, 6), (7, 3))}
    rows = spark.createDataFrame([(i, "p", float(i), i, r) for i, r in shapes.items()], "id long, parcel string, weight double, ord long, ring array<struct<x:double,y:double>>")
    step = 0.02
    x, y = np.meshgrid(np.arange(step / 2, 13, step), np.arange(step / 2, 10, step))

    def inside(ring):
        out = np.zeros(x.shape, bool)
        for a, b in zip(ring[:-1], ring[1:], strict=True):
            if a["y"] != b["y"]:
                out ^= ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
        return out

    a, b, c = (inside(r) for r in shapes.values())
    area = lambda m: m.sum() * step * step
    told = lambda parts, key: {r[key]: r["area"] for r in polygons.areas(parts, key).collect()}
    near = lambda got, want: got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.05 for k in want)
    for tile in (3.0, 100.0):
        assert near(told(polygons.dissolved(rows, "parcel", tile), "parcel"), {"p": area(a | b | c)})
        assert near(told(polygons.clipped(rows.where("id = 1"), rows.where("id > 1"), None, tile), "id"), {1: area(a & (b | c))})
        assert near(told(polygons.clipped(rows.where("id = 1"), rows.where("id > 1"), None, tile, outside=True), "id"), {1: area(a & ~(b | c))})
        assert near(told(polygons.overlay(rows, tile), "id"), {3: area(c), 2: area(b & ~c), 1: area(a & ~b & ~c)})
    assert polygons.dissolved(rows.limit(0), "parcel").count() == 0


def test_rings_of_cells_that_meet_in_a_corner(spark):
    cells = spark.createDataFrame([(0, 0, 1, 0), (1, 1, 1, 3), (2, 0, 1, 6), (2, 1, 1, 6), (2, 2, 1, 6), (3, 0, 1, 6), (3, 2, 1, 6), (4, 0, 1, 6), (4, 1, 1, 6), (4, 2, 1, 6)], "row int, col int, value int, label long")
    got = [(r["label"], len(r["ring"])) for r in polygons.cell_rings(cells, 0.0, 5.0, 1.0).collect()]
    assert sorted(got) == [(0, 5), (3, 5), (6, 5), (6, 5)]


def test_neighbours_of_points_out_of_all_range(spark):
    rows = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1e300, 0.0), (4, -1e250, 5.0), (5, 1e9, 1e9), (6, 0.0, 2.5)]
    got = spatialjoin.knn(spark.createDataFrame(rows, "id long, x double, y double"), 2, 1.0).collect()
    want = {}
    near = [r for r in rows if abs(r[1]) < 2.0**52]
    for i, x, y in near:
        others = sorted((math.hypot(x - a, y - b), j) for j, a, b in near if j != i)[:2]
        want[i] = [j for _, j in others]
    assert {i: [r["other"] for r in sorted(got, key=lambda r: r["rank"]) if r["id"] == i] for i in want} == want and {r["id"] for r in got} == set(want)
