"""Relations with geometry derived from the driver's tables; each has its SQL beside it for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import BBox, Grid, spread
from ..functions import geometry as G

BOX = BBox(0.0, 0.0, 200.0, 100.0)
GRID = Grid.over(BOX, 4.0)

PTS = """pts AS (SELECT CAST(l_partkey % 200 AS DOUBLE) + (l_extendedprice - floor(l_extendedprice)) AS x, CAST(l_suppkey % 100 AS DOUBLE) + l_discount AS y, l_quantity + l_tax AS z,
  CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 WHEN 6 THEN 9 ELSE 1 END AS classification, l_orderkey FROM lineitem)"""
HOLEY = f"""{PTS}, hp AS (SELECT * FROM pts WHERE classification IN (2, 3, 6) AND NOT (classification = 2 AND z <= 30e0)),
cells AS (SELECT CAST(floor((100e0 - y) / 4e0) AS INT) AS "row", CAST(floor(x / 4e0) AS INT) AS col, max(z) AS dsm, max(CASE WHEN classification = 2 THEN z END) AS dtm
  FROM hp WHERE x BETWEEN 0 AND 200 AND y BETWEEN 0 AND 100 GROUP BY 1, 2),
cell AS (SELECT * FROM cells WHERE "row" BETWEEN 0 AND 24 AND col BETWEEN 0 AND 49),
g AS (SELECT CAST(r AS INT) AS "row", CAST(c AS INT) AS col FROM range(25) a(r), range(50) b(c))"""
BLD = """bld AS (SELECT p_partkey AS id, CAST(p_partkey % 50 AS DOUBLE) * 30e0 AS x0, floor(p_partkey / 50e0) * 30e0 AS y0, 4e0 + p_size % 12 AS w, 5e0 + p_size % 9 AS l,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) END AS hauteur, CASE WHEN p_partkey % 4 = 1 THEN CAST(p_size % 8 + 1 AS DOUBLE) END AS nombre_d_etages,
  CASE WHEN p_partkey % 4 IN (1, 2) THEN CAST(p_size % 20 + 2 AS DOUBLE) END AS hauteur_2 FROM part)"""
WEATHER = "weather AS (SELECT event_id, ts, value - 360e0 * floor(value / 360e0) AS wdir, value FROM events)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 WHEN 6 THEN 9 ELSE 1 END")
    price = F.col("l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(
        ((F.col("l_partkey") % 200).cast("double") + (price - F.floor(price))).alias("x"), ((F.col("l_suppkey") % 100).cast("double") + F.col("l_discount")).alias("y"),
        (F.col("l_quantity") + F.col("l_tax")).alias("z"), kind.alias("classification"), "l_orderkey",
    )


def holey_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("classification IN (2, 3, 6) AND NOT (classification = 2 AND z <= 30)")


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = spread(read(spark, sf_dir, "part").select("p_partkey", "p_size")).select(
        key.alias("id"), ((key % 50).cast("double") * 30).alias("x0"), (F.floor(key / 50.0) * 30.0).alias("y0"), (F.lit(4.0) + size % 12).alias("bw"), (F.lit(5.0) + size % 9).alias("bl"),
        F.when(key % 4 == 0, size.cast("double")).alias("hauteur"), F.when(key % 4 == 1, (size % 8 + 1).cast("double")).alias("nombre_d_etages"), F.when((key % 4).isin(1, 2), (size % 20 + 2).cast("double")).alias("hauteur_2"),
    )
    ring = G.rectangle(F.col("x0"), F.col("y0"), F.col("x0") + F.col("bw"), F.col("y0") + F.col("bl"))
    return rows.withColumns({"ring": ring, "area": F.col("bw") * F.col("bl"), "noHauteur": F.col("hauteur").isNull()})


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return read(spark, sf_dir, "events").select("event_id", "ts", (v - 360.0 * F.floor(v / 360.0)).alias("wdir"), "value", "event_type", "user_id")
