"""Files that a task writes are bounded, whatever its rows; bytes of shapes and triangles are computed once."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.operators import graphs, urban
from urbanspark.sources import files, las, vector


def test_las_files_of_a_task_are_bounded(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        points = spark.range(1000).coalesce(1).selectExpr("cast(id as double) x", "cast(id % 7 as double) y", "1d z", "cast(2 as int) classification")
        made = las.write_las(points, most=250)
        assert made.count() > 3 and made.select("part").distinct().count() == made.count()
        files.write_files(made.select(F.concat(F.lit("part-"), F.col("part").cast("string"), F.lit(".las")).alias("name"), "content"), str(tmp_path))
        assert las.read_las(spark, str(tmp_path)).agg(F.count("*"), F.sum("x")).first()[:] == (1000, 499500.0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shapefiles_of_a_task_are_bounded(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        x = F.col("id").cast("double")
        rows = spark.range(300).coalesce(1).select("id", G.rectangle(x, x, x + 1, x + 2).alias("ring"))
        made = vector.shapefiles(rows, "id", most=100)
        assert made.where("name like '%.shp'").count() == 3
        files.write_files(made, str(tmp_path))
        back = vector.read_shapefile(spark, str(tmp_path))
        assert sorted(int(r[0]) for r in back.select(F.col("properties")["id"]).collect()) == list(range(300))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bits_of_a_double_are_computed_once(spark):
    values = [0.0, 1.0, -1.5, 0.1, 1e300, -3e-7, 2.0**52 + 1, 1234567.891]
    blob = files.ewkb(F.transform("v", lambda v: G.point(v, -v)), 2154)
    rows = spark.createDataFrame([(values,)], "v array<double>").select(blob.alias("b"))
    assert bytes(rows.first()["b"])[17:] == b"".join(struct.pack("<2d", v, -v + 0.0) for v in values)
    assert len(rows._jdf.queryExecution().analyzed().toString()) < 20_000


def test_triangles_have_empty_circles():
    xy = np.random.default_rng(4).uniform(0, 10, (60, 2))
    found = graphs.triangles(xy)
    assert len(found) >= 60
    for t in found:
        (ax, ay), (bx, by), (cx, cy) = xy[list(t)]
        u = np.linalg.solve([[2 * (bx - ax), 2 * (by - ay)], [2 * (cx - ax), 2 * (cy - ay)]], [bx**2 + by**2 - ax**2 - ay**2, cx**2 + cy**2 - ax**2 - ay**2])
        others = np.delete(xy, list(t), axis=0)
        assert (np.hypot(*(others - u).T) > np.hypot(ax - u[0], ay - u[1]) - 1e-9).all()


def test_clusters_keep_what_they_need(spark, monkeypatch):
    kept, kind = [], next(k for k in type(spark.range(1)).__mro__ if "persist" in vars(k))
    real = kind.persist
    monkeypatch.setattr(kind, "persist", lambda self, *a: (kept.append(self.columns), real(self, *a))[1])
    rows = spark.range(40).selectExpr("id", "cast(id % 4 as double) a", "array(1, 2, 3) ring")
    assert urban.clusters(rows, ["a"], 4, starts=1).count() == 40
    assert kept[0] == ["id", "features"]
