"""The biotope layer from files and tables, and the mask's shapefile."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from urbanspark import api, dims
from urbanspark.core import BBox, Context
from urbanspark.functions import crs
from urbanspark.functions import geometry as G
from urbanspark.sources import files, vector

RING = "ring array<struct<x:double,y:double>>"


def box(x, y, w, h):
    return [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]


def test_scores_of_a_parcel(spark):
    parcel = spark.createDataFrame([(box(0, 0, 10, 10),), (box(5, 0, 15, 10),)], RING)
    green, grey = list(dims.COSIA_BFF)[0], list(dims.BFF)[-1]
    land = spark.createDataFrame([(box(-10, 0, 20, 10), green), (box(30, 0, 5, 5), green), (None, green)], f"{RING}, classe string")
    plan = spark.createDataFrame([(box(0, 0, 20, 10), grey)], f"{RING}, bff_class string")
    state = api.Biotope(parcel).load_existing(land).load_project(plan)
    r = state.compute().collect()
    want = dims.BFF[dims.COSIA_BFF[green]] * 100 / 200
    assert len(r) == 1 and r[0]["cbs_existant"] == pytest.approx(want) and r[0]["cbs_projet"] == pytest.approx(dims.BFF[grey]) and r[0]["alert"] == (dims.BFF[grey] < want)
    assert {x["color"] for x in state.existing.collect()} == {dims.COSIA_COLOUR.get(green, dims.COSIA_DEFAULT_COLOUR)}
    lone = api.Biotope(parcel).load_project(plan).compute().collect()[0]
    assert lone["cbs_existant"] is None and lone["delta"] is None and lone["alert"] is None
    with pytest.raises(ValueError, match="classe"):
        api.Biotope(parcel).load_existing(plan)


def test_a_drawing_in_another_system(spark, tmp_path):
    # A square of 100 m about a place, drawn in the zone's own coordinates.
    lon, lat = F.lit(-1.15), F.lit(46.18)
    own, drawn = (spark.range(1).select(crs.transform_point(lon, lat, 4326, s).alias("p")).first()["p"] for s in (2154, 3946))
    layer = next(k for k, v in dims.LAYERS.items() if "arbres" not in k and v[1] is None)
    shapes = spark.createDataFrame([(layer, box(drawn["x"] - 20, drawn["y"] - 20, 40, 40)), ("unheard of", box(drawn["x"], drawn["y"], 5, 5))], f"layer string, {RING}")
    files.write_files(vector.dxf_document(vector.dxf_lines(shapes.coalesce(1))), str(tmp_path / "plan"))
    parcel = spark.createDataFrame([(box(own["x"] - 50, own["y"] - 50, 100, 100),)], RING)
    state = api.Biotope(parcel).load_drawing(spark, str(tmp_path / "plan"))
    got = state.project.collect()
    assert len(got) == 1 and got[0]["surface"] == pytest.approx(1600, rel=2e-3)
    assert state.compute().collect()[0]["cbs_projet"] == pytest.approx(dims.BFF[dims.LAYERS[layer][0]] * got[0]["surface"] / 10_000)


def test_mask_as_a_shapefile(spark, tmp_path):
    dem = api.Dem(spark, "unused.tif", context=Context(bbox=BBox(0.0, 0.0, 100.0, 40.0)))
    assert dem.write_mask(str(tmp_path / "mask")) == 3
    r = vector.read_shapefile(spark, str(tmp_path / "mask")).select("properties", G.area(F.col("parts")[0]).alias("a")).collect()
    assert r[0]["properties"] == {"name": "mask"} and r[0]["a"] == pytest.approx(0.85**2 * 4000)
