"""Joins of tables with rings or copies made of small files: sizes by files must not lead to a broadcast."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["building_adjacency", "interbuilding_distance", "wall_weighted_mean", "shared_walls", "knn_buildings"])
def test_plan_has_no_broadcast(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rounds_of_neighbours_have_no_broadcast(spark, monkeypatch):
    from urbanspark.operators import graphs, spatialjoin, tessellation

    plans = []
    kind = next(k for k in type(spark.range(1)).__mro__ if "checkpoint" in vars(k))
    real = kind.checkpoint

    def noted(self, *a, **k):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return real(self, *a, **k)

    monkeypatch.setattr(kind, "checkpoint", noted)
    points = spark.range(30).selectExpr("id", "cast(id % 6 as double) x", "cast(floor(id / 6) as double) y")
    assert spatialjoin.knn(points, 3, 2.0).count() == 90
    assert graphs.connected(spark.range(9).selectExpr("id a", "id + 1 b")).where("root = 0").count() == 10
    ring = "array(named_struct('x', id * 30d, 'y', 0d), named_struct('x', id * 30d + 10, 'y', 0d), named_struct('x', id * 30d + 10, 'y', 8d), named_struct('x', id * 30d, 'y', 0d))"
    assert tessellation.tessellation(spark.range(3).selectExpr("id", f"{ring} ring"), 20.0, 5.0).count() == 3
    assert len(plans) > 5 and not [p for p in plans if "BroadcastHashJoin" in p]
