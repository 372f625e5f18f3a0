"""Polygon algebra where many features lie over each other: rows that can't tell in their tile don't get there."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.operators import polygons


def thick(spark, n):
    """Rectangles of whole corners, ten deep and more."""
    k = F.col("id")
    x, y = (k * 7 % 13).cast("double"), (k * 11 % 9).cast("double")
    return spark.range(n).select("id", (k % 2).alias("parcel"), (k % 5).cast("int").alias("weight"), k.alias("ord"), G.rectangle(x, y, x + 4 + k % 3, y + 3 + k % 4).alias("ring"))


def cells(df):
    """Each feature's unit cells."""
    out = {}
    for r in df.collect():
        xs, ys = [p["x"] for p in r["ring"]], [p["y"] for p in r["ring"]]
        out[r["id"]] = (r, {(x, y) for x in range(int(min(xs)), int(max(xs))) for y in range(int(min(ys)), int(max(ys)))})
    return out


def area(rows, key):
    return {r[key]: round(r["area"], 6) for r in polygons.areas(rows, key).collect()}


@pytest.mark.parametrize("tile", [None, 2.0])
def test_overlay_hands_on_what_can_tell(spark, tile):
    df = thick(spark, 1500)
    want, taken = {}, set()
    for r, own in sorted(cells(df).values(), key=lambda v: (-v[0]["weight"], v[0]["ord"])):
        if own - taken:
            want[r["id"]] = float(len(own - taken))
        taken |= own
    parts = polygons.overlay_parts(df, tile, 50)
    assert area(parts.trapezoids(), "id") == want == area(parts.polygons().select("id", "ring"), "id")
    assert parts.rows.count() < 1500


def test_equal_rings_are_repaired_once(spark):
    eight = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (4.0, 2.0), (4.0, 0.0), (0.0, 2.0), (0.0, 0.0))])
    df = spark.range(400).select("id", F.transform(eight, lambda p: G.point(p["x"] * (1 + F.col("id") % 2), p["y"])).alias("ring"))
    first, named = polygons._alike(df)
    assert first.count() == 2 and named.count() == 400
    want = {i: 4.0 * (1 + i % 2) for i in range(400)}
    assert area(polygons.repaired(df, 64.0), "id") == want == area(polygons.repaired_polygons(df, 64.0).select("id", "ring"), "id")


@pytest.mark.parametrize("outside", [False, True])
@pytest.mark.parametrize("tile", [None, 2.0])
def test_clip_leaves_whole_rectangles_alone(spark, tile, outside):
    df = thick(spark, 900)
    mine, masks = df.where("id % 3 <> 0"), df.where("id % 3 = 0")
    own = cells(df)
    under = {p: set().union(*[c for r, c in own.values() if r["id"] % 3 == 0 and r["parcel"] == p]) for p in (0, 1)}
    left = {i: (c - under[r["parcel"]] if outside else c & under[r["parcel"]]) for i, (r, c) in own.items() if i % 3}
    want = {i: float(len(c)) for i, c in left.items() if c}
    parts = polygons.clip_parts(mine, masks, "parcel", tile, outside, 50)
    got = parts.polygons()
    assert area(parts.trapezoids(), "id") == want
    assert {r["id"]: r["a"] for r in got.groupBy("id").agg(F.round(F.sum(G.area(F.col("ring"), F.col("holes"))), 6).alias("a")).collect()} == want
    assert parts.rows.where("role = 0").select("id").distinct().count() < 600
    # A rectangle that stays whole is told as any other ring.
    assert all(r["ring"][0] == min(r["ring"]) and len(r["ring"]) >= 5 for r in got.collect())


def test_rectangles_are_dealt_to_all_cores(spark, small):
    from urbanspark.plans import more

    assert more._rectangles(spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_jobs_of_few_bytes_are_dealt_to_all_cores(spark):
    parts = polygons.union_parts(thick(spark, 300), "parcel", 2.0)
    assert parts.trapezoids().rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_features_beside_their_masks_go_to_no_tile(spark):
    square = lambda x: G.rectangle(*[F.lit(v) for v in (x, 0.0, x + 3.0, 3.0)])
    mine = spark.range(9).select("id", (F.col("id") % 3).alias("parcel"), square(0.0).alias("ring"))
    masks = spark.range(1).select(F.lit(0).cast("long").alias("parcel"), square(1.0).alias("ring"))
    parts = polygons.clip_parts(mine, masks, "parcel", 4.0)
    assert {r["id"] for r in parts.rows.where("role = 0").collect()} == {0, 3, 6}
    assert area(parts.trapezoids(), "id") == {0: 6.0, 3: 6.0, 6: 6.0}
