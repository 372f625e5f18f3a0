"""Queries over files that they write themselves from the given tables and read back through the library's sources; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import api, dims
from ..core import BBox, Context, shared_folder
from ..functions import crs
from ..functions import geometry as G
from ..operators import features, mapalgebra
from ..sources import files, las, vector
from .fixtures import BLD, BOX, GRID, PTS, holey_points, points, read
from .fixtures import buildings as bld
from .more import _RECT, _rectangles
from .queries import _CELLS, _FILLED, _cells, query, values


def _folder(spark, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


_SHOWN = "id, round(w * l, 6) AS area, round(x0 + w / 2, 6) AS cx, round(y0 + l / 2, 6) AS cy"


def _collections(spark, d, properties):
    """A FeatureCollection of a hundred footprints a row of text; properties is a Column."""
    rows = bld(spark, d)
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    each = rows.select("id", F.floor(F.col("id") / 100).alias("k"), F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), shape.alias("geometry"))).alias("f"))
    return each.groupBy("k").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("content"))


def _documents(spark, d, properties) -> str:
    folder = _folder(spark, "geojson")
    files.write_files(_collections(spark, d, properties).select(F.concat(F.lit("part-"), F.col("k").cast("string"), F.lit(".geojson")).alias("name"), F.encode("content", "UTF-8").alias("content")), folder)
    return folder


# Vector files


@query(f"WITH {BLD} SELECT id, round(w * l, 6) AS area, hauteur, nombre_d_etages, hauteur_2, hauteur IS NULL AS \"noHauteur\" FROM bld")
def geojson_buildings(spark, d):
    folder = _documents(spark, d, F.struct("id", F.col("hauteur").alias("HAUTEUR"), F.col("nombre_d_etages").alias("Etages"), F.col("hauteur_2").alias("HAUTEUR_2")))
    rows = features.read_features(spark.read.text(folder, wholetext=True))
    out = features.buildings_of(rows.withColumn("id", F.get_json_object("properties", "$.id").cast("long")))
    return out.select("id", F.round(G.area(F.col("ring")), 6).alias("area"), "hauteur", "nombre_d_etages", "hauteur_2", "noHauteur")


@query(f"WITH {BLD} SELECT count(*) AS count, round(sum(CASE WHEN id % 5 > 0 THEN w END), 6) AS contenance FROM bld WHERE x0 <= 600 AND x0 + w >= 100 AND y0 <= 400 AND y0 + l >= 50")
def cadastre_stats(spark, d):
    # Some parcels have words for their size.
    e = G.envelope(F.col("ring"))
    folder = _documents(spark, d, F.struct(F.when(F.col("id") % 5 > 0, (e["max_x"] - e["min_x"]).cast("string")).otherwise("unknown").alias("contenance")))
    return api.Cadastre(spark, folder, context=Context(bbox=BBox(100.0, 50.0, 600.0, 400.0))).run().stats().select("count", F.round("contenance", 6).alias("contenance"))


@query(f"WITH {BLD} SELECT {_SHOWN}, CAST(id % 17 + 1 AS INT) AS lcz_int FROM bld")
def shapefile_round_trip(spark, d):
    folder = _folder(spark, "shapes")
    rows = bld(spark, d).withColumn("lcz", F.col("id") % 17 + 1)
    files.write_files(vector.shapefiles(rows.repartition(3), "id", "lcz"), folder)
    back = vector.lcz_rows(vector.read_shapefile(spark, folder), "lcz")
    ring = F.col("parts")[0]
    e = G.envelope(ring)
    return back.select(F.col("properties")["id"].cast("long").alias("id"), F.round(G.area(ring), 6).alias("area"), F.round((e["min_x"] + e["max_x"]) / 2, 6).alias("cx"), F.round((e["min_y"] + e["max_y"]) / 2, 6).alias("cy"), "lcz_int")


@query(f"WITH {BLD} SELECT layer, count(*) AS n, round(sum(w * l), 6) AS area FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 'MUR' ELSE 'TOITURE' END AS layer FROM bld) GROUP BY 1")
def drawing_round_trip(spark, d):
    folder = _folder(spark, "drawing")
    rows = bld(spark, d).withColumn("layer", F.when(F.col("id") % 3 == 0, "MUR").otherwise("TOITURE"))
    files.write_files(vector.dxf_document(vector.dxf_lines(rows.repartition(3))), folder)
    back = vector.read_dxf(spark, folder).where("kind = 'LWPOLYLINE'")
    return back.groupBy("layer").agg(F.count("*").alias("n"), F.round(F.sum(G.area(F.col("ring"))), 6).alias("area"))


@query(f"WITH {BLD} SELECT id, 97 AS bytes, '0103000020' || '6A080000' || '01000000' || '05000000' AS head FROM bld")
def ewkb_bytes(spark, d):
    rows = bld(spark, d).select("id", files.ewkb(F.col("ring"), 2154).alias("blob"))
    return rows.select("id", F.octet_length("blob").alias("bytes"), F.substring(F.hex("blob"), 1, 34).alias("head"))


@query(f"WITH {BLD} SELECT id, round(w * l, 4) AS area, round(x0 + w / 2, 4) AS cx FROM bld")
def rings_reprojected(spark, d):
    # To the transverse zone and back, about 700 km, 6600 km of the conical system.
    moved = bld(spark, d).select("id", F.transform("ring", lambda p: G.point(p["x"] + 700000, p["y"] + 6600000)).alias("ring"))
    there = moved.select("id", crs.transform_ring(F.col("ring"), 2154, 25831).alias("ring"))
    back = there.select("id", crs.transform_ring(F.col("ring"), 25831, 2154).alias("ring"))
    e = G.envelope(F.col("ring"))
    return back.select("id", F.round(G.area(F.col("ring")), 4).alias("area"), F.round((e["min_x"] + e["max_x"]) / 2 - 700000, 4).alias("cx"))


@query("SELECT p_partkey AS id, left(sha256(u), 16) || '-' || regexp_replace(p_partkey || '_' || p_name || '.laz', '[^A-Za-z0-9.-]', '_', 'g') AS name FROM (SELECT *, 'https://example.org/tiles/' || p_partkey || '_' || p_name || '.laz?token=' || p_size AS u FROM part)")
def cached_names(spark, d):
    url = F.concat(F.lit("https://example.org/tiles/"), F.col("p_partkey").cast("string"), F.lit("_"), F.col("p_name"), F.lit(".laz?token="), F.col("p_size").cast("string"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), features.cache_name(url).alias("name"))


# Point clouds


@query(f"WITH {PTS} SELECT classification, count(*) AS n, round(sum(x), 2) AS x, round(sum(y), 2) AS y, round(min(z), 2) AS low, round(max(z), 2) AS high FROM pts GROUP BY 1")
def las_round_trip(spark, d):
    folder = _folder(spark, "cloud")
    files.write_files(las.write_las(points(spark, d).repartition(4)).select(F.concat(F.lit("part-"), F.col("part").cast("string"), F.lit(".las")).alias("name"), "content"), folder)
    back = las.read_las(spark, folder)
    return back.groupBy(F.col("classification").cast("int").alias("classification")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("x"), F.round(F.sum("y"), 2).alias("y"), F.round(F.min("z"), 2).alias("low"), F.round(F.max("z"), 2).alias("high"))


@query(f'{_FILLED} SELECT "row", col, round(dsm, 4) AS dsm, round(dtm, 4) AS dtm, round(CASE WHEN dsm IS NULL THEN 0e0 ELSE greatest(dsm - dtm, 0e0) END, 4) AS chm FROM f')
def lidar_layer(spark, d):
    # The public layer, from files to canopy.
    folder = _folder(spark, "cloud")
    files.write_files(las.write_las(holey_points(spark, d).repartition(4)).select(F.concat(F.lit("part-"), F.col("part").cast("string"), F.lit(".las")).alias("name"), "content"), folder)
    layer = api.Lidar(spark, folder, resolution=GRID.res, context=Context(bbox=BOX)).run()
    return layer.df().select("row", "col", *[F.round(c, 4).alias(c) for c in ("dsm", "dtm", "chm")])


@query(f"WITH {PTS} SELECT classification, count(*) AS n, round(sum(z), 2) AS z FROM pts WHERE round(x, 2) BETWEEN 20.5 AND 77.25 AND round(y, 2) >= 30 AND round(y, 2) < 60 AND round(z, 2) > 10 GROUP BY 1")
def las_scan(spark, d):
    # A file a strip of x: those beside the box are left out by their heads.
    folder = _folder(spark, "strips")
    strips = points(spark, d).repartitionByRange(8, "x")
    files.write_files(las.write_las(strips).select(F.concat(F.lit("part-"), F.col("part").cast("string"), F.lit(".las")).alias("name"), "content"), folder)
    cloud = las.scan_las(spark, folder, slice=20_000).where("x >= 20.495 and x <= 77.255 and y >= 29.995 and y < 59.995 and z > 10.005")
    return cloud.groupBy(F.col("classification").cast("int").alias("classification")).agg(F.count("*").alias("n"), F.round(F.sum("z"), 2).alias("z"))


# Weather and wind files


@query("SELECT event_id, make_timestamp(2021, CAST(event_id % 12 + 1 AS BIGINT), CAST(event_id % 28 + 1 AS BIGINT), CAST(event_id % 24 AS BIGINT), 0, 0e0) AS ts, round(value, 2) AS ta, CAST(user_id % 360 AS DOUBLE) AS wdir FROM events")
def epw_round_trip(spark, d):
    # An hour a line: 35 columns, hours from 1; the pressure column carries the event's number.
    n = F.col("event_id")
    zero = F.lit("0")
    columns = [F.lit("2021"), (n % 12 + 1).cast("string"), (n % 28 + 1).cast("string"), (n % 24 + 1).cast("string"), zero, zero, F.round("value", 2).cast("string"), zero, zero, n.cast("string"), *[zero] * 10, (F.col("user_id") % 360).cast("string"), *[zero] * 14]
    folder = _folder(spark, "weather")
    read(spark, d, "events").select(F.concat_ws(",", *columns)).write.text(folder)
    return files.read_epw(spark, folder).select(F.col("pressure").cast("long").alias("event_id"), "ts", "ta", "wdir")


@query("""WITH c AS (SELECT CAST(s_suppkey % 10 AS INT) AS col, CAST(floor(s_suppkey / 10e0) AS INT) AS "row", (s_suppkey + 1) / 8e0 AS u FROM supplier) SELECT CAST(col AS DOUBLE) AS x, CAST("row" AS DOUBLE) AS y, 2e0 AS z, round(u, 3) AS u, round(-u, 3) AS v FROM c""")
def wind_file_round_trip(spark, d):
    k = F.col("s_suppkey")
    cells = read(spark, d, "supplier").select((k % 10).cast("int").alias("col"), F.floor(k / 10).cast("int").alias("row"), (k % 10).cast("double").alias("x"), F.floor(k / 10).cast("double").alias("y"), F.lit(2.0).alias("z"), ((k + 1) / 8.0).alias("u"), (-(k + 1) / 8.0).alias("v"))
    n = cells.count()
    folder = _folder(spark, "wind")
    files.wind_lines(cells, n, 1, 2.0).select("value").write.text(folder)
    return files.read_wind_lines(spark.read.text(folder))


# Layers' own rules


@query(f"""{_CELLS}, v AS (SELECT "row", col, CASE WHEN dsm > 49.5e0 THEN 0 ELSE 1 END AS value, CAST("row" * 50 + col AS BIGINT) AS i FROM base),
  e AS (SELECT a.i AS p, b.i AS q FROM v a JOIN v b ON a.value = b.value AND abs(a."row" - b."row") + abs(a.col - b.col) = 1),
  r AS (WITH RECURSIVE w(i, root) AS (SELECT i, i FROM v UNION SELECT e.q, w.root FROM w JOIN e ON e.p = w.i WHERE e.q > w.root) SELECT i, min(root) AS label FROM w GROUP BY 1)
  SELECT r.label, round(count(*) * 16e0, 6) AS area FROM v JOIN r USING (i) WHERE value = 0 GROUP BY 1 HAVING count(*) * 16e0 > 32""")
def vegetation_areas(spark, d):
    # Infrared and red bands whose index is below a tenth off the green, and a half on it.
    green = F.col("dsm") > 49.5
    bands = _cells(spark, d).select("row", "col", F.when(green, 30.0).otherwise(10.0).alias("nir"), F.when(green, 10.0).otherwise(30.0).alias("red"))
    cells = bands.select("row", "col", F.when(mapalgebra.ndvi(F.col("nir"), F.col("red")) > 0.2, 0).otherwise(1).alias("value"))
    areas = mapalgebra.component_areas(mapalgebra.components(cells, GRID), GRID.res**2)
    return areas.where((F.col("value") == 0) & (F.col("area") > 32.0)).select("label", F.round("area", 6).alias("area"))


@query("SELECT DISTINCT p_size AS value FROM part")
def distinct_classes(spark, d):
    return mapalgebra.distinct_classes(read(spark, d, "part").select(F.col("p_size").alias("value")))


@query(f"WITH {BLD} SELECT id, row_number() OVER (ORDER BY id) AS \"uID\" FROM bld WHERE id % 3 <> 0")
def buildings_numbered(spark, d):
    rows = bld(spark, d).where("id % 3 <> 0").select("id", F.lit(1).alias("all"))
    return features.numbered_subset(rows, "all", [1], "id", "uID").select("id", "uID")




_COVERS, _STATES = list(dims.COSIA_BFF), list(dims.BFF)
_NAMES = lambda names: "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


@query(f"""WITH {_RECT}, c(classe, bff, o1) AS (VALUES {values(dims.COSIA_BFF)}), b(bff, coef, o2) AS (VALUES {values(dims.BFF)}),
  s AS (SELECT *, greatest(0, least(x1, 40) - greatest(x0, 10)) * greatest(0, least(y1, 40) - greatest(y0, 10)) AS area, {_NAMES(_COVERS)}[id % {len(_COVERS)} + 1] AS classe, {_NAMES(_STATES)}[id % {len(_STATES)} + 1] AS bff FROM f),
  e AS (SELECT parcel, sum(area * b.coef) / 900 AS cbs FROM s JOIN c USING (classe) JOIN b ON b.bff = c.bff WHERE id % 2 = 0 GROUP BY 1), p AS (SELECT parcel, sum(area * b.coef) / 900 AS cbs FROM s JOIN b USING (bff) WHERE id % 2 = 1 GROUP BY 1),
  k AS (SELECT parcel, coalesce(e.cbs, 0) AS a, coalesce(p.cbs, 0) AS b FROM (SELECT DISTINCT parcel FROM f) LEFT JOIN e USING (parcel) LEFT JOIN p USING (parcel))
  SELECT parcel, round(a, 6) AS cbs_existant, round(b, 6) AS cbs_projet, round(b - a, 6) AS delta, b < a AS alert FROM k""")
def biotope_scores(spark, d):
    # Every parcel is the same square; land cover is of even numbers, the project of odd ones.
    rows = _rectangles(spark, d).drop("weight", "ord")
    square = [F.lit(v) for v in (10.0, 10.0, 40.0, 40.0)]
    parcels = rows.select("parcel").distinct().select("parcel", G.rectangle(*square).alias("ring"))
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int"))
    state = api.Biotope(parcels, "parcel")
    state.load_existing(rows.where("id % 2 = 0").withColumn("classe", pick(_COVERS)).drop("id"))
    state.load_project(rows.where("id % 2 = 1").withColumn("bff_class", pick(_STATES)).drop("id"))
    return state.compute().select("parcel", *[F.round(c, 6).alias(c) for c in ("cbs_existant", "cbs_projet", "delta")], "alert")


@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY p_name || '-' || p_partkey || '.tif') AS n FROM part")
def sorted_paths(spark, d):
    paths = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".tif")).alias("path"), F.lit(1).alias("all"))
    return features.numbered_subset(paths, "all", [1], "path", "n").select("id", "n")
