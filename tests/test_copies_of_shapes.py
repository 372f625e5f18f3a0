"""Many shapes at one place: none of the joins may list a pair for each point and copy."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.operators import polygons, spatialjoin

N, COPIES = 20_000, 100_000


@pytest.fixture(scope="module")
def points(spark):
    return spark.range(N).selectExpr("id", "id % 100 / 8d x", "floor(id / 100) / 16d y", "cast(id as double) z").cache()


def _boxes(spark):
    # Two kinds of copies, and some of their own.
    return spark.range(COPIES).selectExpr("id box", "if(id < 40, id / 7d, id % 2 * 1d) min_x", "if(id < 40, id / 9d, 0d) min_y", "if(id < 40, id / 7d + 3, 12.5d) max_x", "if(id < 40, id / 9d + 2, 12.5d) max_y")


def _brute(points, boxes):
    own = boxes.where("box < 42")
    return {r["box"]: (r["n"], r["z"]) for r in points.join(own, F.expr("x between min_x and max_x and y between min_y and max_y")).groupBy("box").agg(F.count("*").alias("n"), F.sum("z").alias("z")).collect()}


@pytest.mark.parametrize("how", ["grid", "tree"])
def test_totals_of_copied_boxes(spark, points, how):
    boxes = _boxes(spark)
    if how == "grid":
        got = spatialjoin.range_aggregate(points, boxes, 2.0, F.count("*").alias("n"), F.sum("z").alias("total"))
    else:
        got = spatialjoin.quadtree_totals(points, boxes, "z", 50)
    rows = {r["box"]: (r["n"], r["total"]) for r in got.select("box", "n", "total").collect()}
    want = _brute(points, boxes)
    assert len(rows) == COPIES and {k: v for k, v in rows.items() if k < 42} == want and rows[99_999] == want[41]


def test_first_of_copied_shapes_and_points_in_them(spark, points):
    shapes = _boxes(spark).select((F.col("box") + 5).alias("shape_idx"), G.rectangle(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]).alias("ring"))
    got = spatialjoin.first_match(points.select("id", "x", "y"), shapes, 4.0)
    own = shapes.where("shape_idx < 47")
    want = points.join(own, G.strictly_contains(F.col("ring"), F.col("x"), F.col("y"))).groupBy("id").agg(F.min("shape_idx").alias("w"))
    assert got.count() == N and got.join(want, "id", "left").where("not (shape_idx <=> w)").count() == 0
    inside = points.join(own, G.contains(F.col("ring"), F.col("x"), F.col("y")), "left_semi")
    assert polygons.in_any(points, shapes).select("id").exceptAll(inside.select("id")).count() == 0 and polygons.in_any(points, shapes).count() == inside.count()


def test_points_at_one_place_meet_the_shapes_once(spark, monkeypatch):
    looked, real = spark.sparkContext.accumulator(0), G.strictly_contains

    @F.udf("boolean")
    def noted(x):
        looked.add(1)
        return True

    noted = noted.asNondeterministic()
    monkeypatch.setattr(G, "strictly_contains", lambda ring, x, y: real(ring, x, y) & noted(x))
    places = spark.range(4000).selectExpr("id", "case when id % 9 = 8 then null else id % 9 + 0.1d end x", "id % 5 * 2 + 0.1d y")
    shapes = spark.range(30).selectExpr("id box", "id % 6 * 1d min_x", "id % 5 * 1d min_y").select(F.col("box").alias("shape_idx"), G.rectangle(F.col("min_x"), F.col("min_y"), F.col("min_x") + 4, F.col("min_y") + 3).alias("ring"))
    got = spatialjoin.first_match(places, shapes, 4.0).collect()
    want = lambda x, y: next((i for i in range(30) if x is not None and i % 6 < x < i % 6 + 4 and i % 5 < y < i % 5 + 3), None)
    assert len(got) == 4000 and all(r["shape_idx"] == want(r["x"], r["y"]) for r in got) and any(r["shape_idx"] is None for r in got)
    assert 0 < looked.value <= 8 * 5 * 30


def test_tasks_of_contiguity_follow_the_shapes(spark, monkeypatch):
    monkeypatch.setattr(spatialjoin, "SHAPES", 20, raising=False)
    k = F.col("id")
    x, y = (k % 20).cast("double"), F.floor(k / 20).cast("double")
    pairs = spatialjoin.contiguity(spark.range(400).select("id", G.rectangle(x, y, x + 1, y + 1).alias("ring")))
    assert pairs.rdd.getNumPartitions() == 20
    near = lambda a, b: abs(a % 20 - b % 20) <= 1 and abs(a // 20 - b // 20) <= 1
    assert sorted(map(tuple, pairs.collect())) == [(a, b) for a in range(400) for b in range(a + 1, 400) if near(a, b)]
