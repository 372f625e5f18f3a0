from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanspark import api
from urbanspark.core import Grid
from urbanspark.functions import geometry as G
from urbanspark.sources import las


def geojson(tmp_path):
    square = lambda x, y: [[[x, y], [x + 1e-4, y], [x + 1e-4, y + 1e-4], [x, y + 1e-4], [x, y]]]
    feature = lambda x, y, **p: {"type": "Feature", "properties": p, "geometry": {"type": "Polygon", "coordinates": square(x, y)}}
    path = tmp_path / "b.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature(-1.15095, 46.1843, hauteur=12.0, contenance=5), feature(3.0, 46.5, etages=5)]}))
    return str(path)


def test_building_layer(spark, tmp_path):
    layer = api.Building(spark, geojson(tmp_path)).set_bbox(-2, 46, 4, 47).set_crs(2154).run()
    rows = layer.df().orderBy("id").collect()
    assert [r["hauteur"] for r in rows] == [12.0, 15.0] and all(r["area"] > 1 for r in rows)
    assert 3e5 < rows[0]["centroid_x"] < 5e5 and 6e6 < rows[0]["centroid_y"] < 7e6
    assert json.loads(layer.to_geojson().first()[0])["type"] == "FeatureCollection" and layer.geometry().first()["geometry"][:1] == b"\x01"
    with pytest.raises(ValueError, match="run first"):
        api.Building(spark, "x").df()


def test_vector_layer_box(spark, tmp_path):
    path = geojson(tmp_path)
    assert api.Cadastre(spark, path).run().stats().first()["contenance"] == 5.0
    assert api.Iris(spark, path).set_bbox(2, 46, 4, 47).run().df().count() == 1
    assert "TYPENAMES=road" in api.Road(spark, path).set_bbox(2, 46, 4, 47).request_url()


def test_lidar_layer(spark, tmp_path):
    rng = np.random.default_rng(0)
    x, y = rng.random(4000) * 20, rng.random(4000) * 10
    (tmp_path / "a.las").write_bytes(las.las_bytes(x, y, 2 + rng.random(4000), np.where(np.arange(4000) % 2, 2, 5)))
    layer = api.Lidar(spark, str(tmp_path / "a.las")).set_bbox(0, 0, 20, 10).run()
    assert layer.df().count() == 200 and layer.df().where("chm < 0").count() == 0 and layer.to_geotiff()[:2] == b"II"


def test_wind_field_and_tessellation(spark):
    grid = Grid(0.0, 60.0, 2.0, 40, 30)
    lit = lambda v: F.lit(float(v))
    ring = G.rectangle(lit(20), lit(20), lit(30), lit(35))
    houses = spark.range(1).select(F.col("id"), ring.alias("ring"), F.lit(10.0).alias("hauteur"), F.lit(None).cast("double").alias("nombre_d_etages"), F.lit(None).cast("double").alias("hauteur_2"))
    flat = grid.cells(spark)
    speed, zones = api.WindField(api.WindConfig(), grid).run(houses, flat.withColumn("dsm", F.lit(0.0)), flat.withColumn("dem", F.lit(0.0)))
    assert speed.count() == 1200 and {r["zone"] for r in zones.distinct().collect() for r in [r]} >= {0, 1} and speed.where("speed < 0 or speed is null").count() == 0
    two = houses.unionByName(houses.withColumn("id", F.lit(7).cast("long")).withColumn("ring", G.rectangle(lit(60), lit(20), lit(70), lit(35))))
    cells = api.tessellation(two, grid)
    assert cells.count() == 1200 and cells.where("id = 0 and col > 30").count() == 0 and cells.where("id = 7").count() > 300


def test_aligned(spark):
    grid = Grid(0.0, 10.0, 1.0, 10, 10)
    plane = grid.cells(spark).withColumn("v", F.col("col") * 2.0 + F.col("row"))
    rows = api.aligned(plane, grid, Grid(2.25, 8.0, 0.5, 6, 6), "v").where("v is not null").collect()
    assert len(rows) == 36 and all(r["v"] == pytest.approx((2.25 + (r["col"] + 0.5) * 0.5 - 0.5) * 2 + (2 + (r["row"] + 0.5) * 0.5 - 0.5)) for r in rows)
