"""Street graphs from lines, and neighbourhoods, against brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from urbanspark.operators import neighbourhoods, streets

LINE = "id long, line array<struct<x:double,y:double>>"


def line(*points):
    return [None if p is None else {"x": float(p[0]), "y": float(p[1])} for p in points]


def drawn(spark, rows, **options):
    nodes, edges = streets.graph(spark.createDataFrame(rows, LINE), **options)
    at = {r["node"]: (round(r["x"], 6), round(r["y"], 6)) for r in nodes.collect()}
    assert len(at) == len(set(at.values()))
    return at, sorted((r["id"], *sorted((at[r["a"]], at[r["b"]])), round(r["length"], 6)) for r in edges.collect())


def test_a_cross_a_touch_and_a_bend(spark):
    rows = [(1, line((0, 0), (10, 0))), (2, line((5, -5), (5, 5))), (3, line((8, 0), (8, 4), (12, 4)))]
    at, edges = drawn(spark, rows)
    assert len(at) == 8 and len(edges) == 3 + 2 + 2 and sum(e[3] for e in edges) == 10 + 10 + 8
    assert (3, (8.0, 0.0), (8.0, 4.0), 4.0) in edges


def test_near_ends_are_one_node_and_overlaps_are_cut(spark):
    rows = [(1, line((0, 0), (4, 0))), (2, line((4.0004, 0.0003), (4, 5))), (3, line((1, 0), (6, 0))), (4, None), (5, line((1, 1))), (6, line((2, 2), (2, 2))), (7, line((0, 9), None, (float("nan"), 1), (3, 9)))]
    at, edges = drawn(spark, rows)
    assert len([e for e in edges if e[0] == 1]) == 2 and len([e for e in edges if e[0] == 3]) == 2
    assert {e[0] for e in edges} == {1, 2, 3, 7} and len(at) == 7
    assert [v.count() for v in streets.graph(spark.createDataFrame([], LINE))] == [0, 0]


def test_random_segments_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, line(*rng.uniform(0, 30, (2, 2)))) for i in range(60)]
    at, edges = drawn(spark, rows, tolerance=1e-6)
    want = {i: 1 for i, _ in rows}
    for (i, p), (j, q) in itertools.combinations(rows, 2):
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = ((v["x"], v["y"]) for v in (*p, *q))
        d = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
        t, s = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / d, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / d
        if 0 <= t <= 1 and 0 <= s <= 1:
            want[i] += 1
            want[j] += 1
    got = {}
    for e in edges:
        got[e[0]] = got.get(e[0], 0) + 1
    assert got == want and len(at) == 120 + (sum(want.values()) - 60) // 2


def test_false_nodes_go(spark):
    rows = [(1, line((0, 0), (1, 0), (2, 0), (3, 1))), (2, line((3, 1), (4, 4))), (3, line((1.5, 0), (1.5, 3))), (9, line((20, 0), (21, 0), (21, 1), (20, 0)))]
    nodes, edges = streets.graph(spark.createDataFrame(rows, LINE))
    got = sorted((r["parts"], round(r["length"], 6), r["a"] == r["b"]) for r in streets.simplified(edges).collect())
    assert got == sorted([(1, 3.0, False), (2, 1.5, False), (3, round(0.5 + 2**0.5 + 10**0.5, 6), False), (3, round(2 + 2**0.5, 6), True)])


def brute_rings(edges, k):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = []
    for s in near:
        seen, front = {s}, {s}
        for n in range(1, k + 1):
            front = {y for x in front for y in near[x]} - seen
            seen |= front
            out += [(s, y, n) for y in front]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 2, 4])
def test_rings_against_breadth_first_search(spark, k):
    rng = np.random.default_rng(k)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 40, (45, 2))] + [(1, None), (3, 3), (1, 2), (2, 1)]
    got = neighbourhoods.rings(spark.createDataFrame(edges, "a long, b long"), k)
    assert sorted(map(tuple, got.collect())) == brute_rings(edges, k)
    with pytest.raises(ValueError, match="1 or more"):
        neighbourhoods.rings(got, 0)


def test_distances_inside_a_neighbourhood(spark):
    square = lambda x: [{"x": x + dx, "y": dy} for dx, dy in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))]
    b = spark.createDataFrame([(i, square(float(x))) for i, x in enumerate((0, 3, 5, 20))], "id long, ring array<struct<x:double,y:double>>")
    adjacency = spark.createDataFrame([(0, 1), (2, 1), (2, 3)], "a long, b long")
    near = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 3)], "id long, node long")
    got = {r["id"]: r["distance"] for r in neighbourhoods.interbuilding_distance(b, adjacency, near).collect()}
    assert got == {0: 2.0, 1: 1.5, 2: 14.0, 3: None}
    share = {r["id"]: r["adjacency"] for r in neighbourhoods.adjacency_share(adjacency.where("a = 0"), near, b).collect()}
    assert share == {0: 1.0, 1: 1.0, 2: 1.0, 3: None}
    weighted = {r["id"]: tuple(r)[1:] for r in neighbourhoods.weighted_neighbours(adjacency, b).collect()}
    assert weighted == {0: (1, 0.25), 1: (2, 0.5), 2: (2, 0.5), 3: (1, 0.25)}
