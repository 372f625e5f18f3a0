"""Published check points, round trips, datum shifts, and rasters in another projection."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanspark.core import Grid
from urbanspark.functions import crs
from urbanspark.functions import geometry as G
from urbanspark.operators import warp

L = F.lit


def told(spark, v):
    return tuple(spark.range(1).select(v["x"], v["y"]).first())


def test_published_points(spark):
    airy = crs.Transverse.of(27700)
    assert told(spark, crs._transverse_forward(L(1 + 43 / 60 + 4.5177 / 3600), L(52 + 39 / 60 + 27.2531 / 3600), airy)) == pytest.approx((651409.903, 313177.270), abs=1e-3)
    assert told(spark, crs._transverse_inverse(L(651409.903), L(313177.270), airy)) == pytest.approx((1 + 43 / 60 + 4.5177 / 3600, 52 + 39 / 60 + 27.2531 / 3600), abs=1e-8)
    # A quarter of the meridian at 45 degrees has 4984944.378 m.
    assert told(spark, crs._forward(L(3.0), L(45.0), 25831)) == pytest.approx((500000.0, 0.9996 * 4984944.378), abs=1e-3)
    clarke = crs.Datum(6378206.4, 1 / 294.97869821)
    cone = crs.Cone.at(18.0, -77.0, 1.0, 250000.0, 150000.0, clarke)
    assert told(spark, crs._cone_forward(L(-(76 + 56 / 60 + 37.26 / 3600)), L(17 + 55 / 60 + 55.8 / 3600), cone)) == pytest.approx((255966.58, 142493.51), abs=5e-3)


@pytest.mark.parametrize("srid", [2154, 3942, 3946, 3950, 27572, 27700, 25831, 32631, 32733, 3857])
def test_round_trips(spark, srid):
    places = [(2.2945, 48.8584), (-1.15, 46.18), (8.9, 41.9), (0.0, 50.0)]
    rows = spark.createDataFrame(places, "lon double, lat double")
    p = rows.withColumn("p", crs.transform_point(F.col("lon"), F.col("lat"), 4326, srid))
    got = p.select("lon", "lat", crs.transform_point(F.col("p.x"), F.col("p.y"), srid, 4326).alias("q")).select("lon", "lat", "q.*").collect()
    assert all(abs(r["x"] - r["lon"]) < 2e-8 and abs(r["y"] - r["lat"]) < 2e-8 for r in got)  # two millimetres


def test_shifts_are_each_other_s_inverse(spark):
    for datum in (crs.NTF, crs.OSGB36):
        there = crs.shifted(L(2.0), L(49.0), crs.GRS80, datum)
        back = crs.shifted(there["x"], there["y"], datum, crs.GRS80)
        assert told(spark, back) == pytest.approx((2.0, 49.0), abs=2e-8)
        assert abs(told(spark, there)[0] - 2.0) > 1e-4


def test_nulls_boxes_and_unknown_systems(spark):
    assert told(spark, crs.transform_point(L(None).cast("double"), L(46.0), 4326, 25831))[0] is None
    box = F.struct(L(-1.2).alias("min_x"), L(46.1).alias("min_y"), L(-1.1).alias("max_x"), L(46.2).alias("max_y"))
    e = spark.range(1).select(crs.transform_box(box, 4326, 2154).alias("e")).first()["e"]
    corners = [told(spark, crs.transform_point(L(x), L(y), 4326, 2154)) for x in (-1.2, -1.1) for y in (46.1, 46.2)]
    assert e["min_x"] <= min(c[0] for c in corners) and e["max_y"] >= max(c[1] for c in corners) and e["max_x"] - e["min_x"] < 9000
    with pytest.raises(ValueError, match="4326"):
        crs.forward(L(0.0), L(0.0), 9999)


def brute(values, source, x, y):
    fx, fy = (x - source.x_min) / source.res - 0.5, (source.y_max - y) / source.res - 0.5
    c, r = int(np.floor(fx)), int(np.floor(fy))
    total = weight = 0.0
    for i in (0, 1):
        for j in (0, 1):
            v, w = values.get((r + i, c + j)), (fy - r if i else 1 - fy + r) * (fx - c if j else 1 - fx + c)
            if v is not None and w > 0:
                total, weight = total + v * w, weight + w
    return total / weight if weight else None


@pytest.mark.parametrize("tile", [3, 256])
def test_warp_between_grids_against_brute_force(spark, tile):
    source, target = Grid(10.0, 30.0, 2.0, 9, 7), Grid(8.3, 31.1, 1.3, 17, 15)
    rng = np.random.default_rng(2)
    values = {(r, c): float(rng.integers(0, 50)) for r in range(7) for c in range(9) if rng.random() < 0.8}
    rows = [(r, c, v, "x") for (r, c), v in values.items()] + [(r, c, None if r % 2 else float("nan"), "x") for r in range(7) for c in range(9) if (r, c) not in values]
    df = spark.createDataFrame(rows, "row int, col int, v double, fx string")
    got = {(r["row"], r["col"]): r["v"] for r in warp.warp(df, source, target, "v", tile=tile).collect()}
    want = {}
    for r in range(15):
        for c in range(17):
            v = brute(values, source, 8.3 + (c + 0.5) * 1.3, 31.1 - (r + 0.5) * 1.3)
            if v is not None:
                want[r, c] = v
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    near = {(r["row"], r["col"]): r["v"] for r in warp.warp(df, source, target, "v", method="nearest", tile=tile).collect()}
    for r in range(15):
        for c in range(17):
            k = int((30.0 - (31.1 - (r + 0.5) * 1.3)) // 2.0), int((8.3 + (c + 0.5) * 1.3 - 10.0) // 2.0)
            assert near.get((r, c)) == values.get(k)


def test_warp_clips_and_stands_empty_tables(spark):
    grid = Grid(0.0, 4.0, 1.0, 4, 4)
    df = grid.cells(spark).withColumn("v", F.lit(1.0))
    mask = spark.range(1).select(G.rectangle(L(0.0), L(0.0), L(2.0), L(3.0)).alias("ring"))
    assert warp.warp(df, grid, grid, "v", mask=mask).count() == 6 and warp.clip(df, grid, mask).columns == ["row", "col", "v"] and warp.clip(df, grid, mask).count() == 6
    assert warp.warp(df.limit(0), grid, grid, "v").count() == 0 and warp.warp(df, grid, grid, "v", mask=mask.limit(0)).count() == 0
    with pytest.raises(ValueError, match="method"):
        warp.warp(df, grid, grid, "v", method="cubic")
