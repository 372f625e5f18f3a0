"""Exact vectors of the geospatial operators."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanspark.core import BBox, Context, Grid, jfa_steps
from urbanspark.functions import crs
from urbanspark.functions import geometry as G
from urbanspark.functions import wind as W
from urbanspark.operators import biotope, buildings, comfort, features, mapalgebra, points, solver, spatialjoin, trees
from urbanspark.sources import files, geotiff, las, requests

POINTS = "x double, y double, z double, classification int"


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("v")).first()["v"]


def square(x, y, side=1.0):
    lit = lambda v: F.lit(float(v))
    return G.rectangle(lit(x), lit(y), lit(x + side), lit(y + side))


# Points


def test_binning(spark):
    rows = [(0.5, 1.5, 10.0, 2), (0.5, 1.5, 12.0, 1), (1.5, 1.5, 8.0, 2), (0.5, 0.5, 5.0, 6), (-0.2, 1.5, 99.0, 1), (float("nan"), 1.0, 5.0, 2), (0.5, 1.5, float("nan"), 2)]
    grid = Grid(0.0, 2.0, 1.0, 2, 2)
    table = spark.createDataFrame(rows, POINTS)
    cells = {(r["row"], r["col"]): (r["dsm"], r["dtm"]) for r in points.max_z(table, grid).collect()}
    assert cells == {(0, 0): (12.0, 10.0), (0, 1): (8.0, 8.0), (1, 0): (5.0, None)}
    ground = {(r["row"], r["col"]): r["dsm"] for r in points.max_z(points.class_filter(table, [2]), grid).collect()}
    assert ground == {(0, 0): 10.0, (0, 1): 8.0}


def test_class_filter(spark):
    table = spark.createDataFrame([(0.0, 0.0, 0.0, c) for c in (2, 6, 66, 255, 1)], POINTS)
    assert [points.class_filter(table, c).count() for c in (None, [2, 6, 66, 255], [])] == [5, 4, 0]


def test_closed_box(spark):
    table = spark.createDataFrame([(float(i), float(i), float(i), 2) for i in range(100)], POINTS)
    assert points.bbox_filter(table, BBox(25, 25, 75, 75)).count() == 51


def test_fills_and_canopy(spark):
    w, h = 7, 5
    border = [(r, c, 120.0, 100.0 + r * w + c if r in (0, h - 1) or c in (0, w - 1) else None) for r in range(h) for c in range(w)]
    cells = spark.createDataFrame(border, "row int, col int, dsm double, dtm double")
    grid = Grid(0.0, float(h), 1.0, w, h)
    small = {(r["row"], r["col"]): r["dtm"] for r in points.fill_3x3(cells, grid).collect()}
    assert small[2, 3] == 0.0 and small[1, 1] == 100.0
    near = points.fill_nearest(cells, grid)
    assert all(r["dtm"] >= 100 for r in near.collect())
    assert all(r["chm"] < 20 + 1e-9 for r in points.chm(near).collect())


def test_nearest_fill_is_exact(spark):
    w, h = 23, 17
    ground = [(r, c) for r in range(h) for c in range(w) if (31 * r + 17 * c) % 11 == 0 and not (5 < r < 11 and 6 < c < 15)]
    cells = spark.createDataFrame([(r, c, 0.0, float(r * w + c)) for r, c in ground], "row int, col int, dsm double, dtm double")
    got = {(r["row"], r["col"]): r["dtm"] for r in points.fill_nearest(cells, Grid(0.0, float(h), 1.0, w, h)).collect()}
    for r in range(h):
        for c in range(w):
            assert got[r, c] == min(((r - a) ** 2 + (c - b) ** 2, a * w + b) for a, b in ground)[1]


def test_no_ground_is_zero(spark):
    cells = spark.createDataFrame([(0, 0, 5.0, None)], "row int, col int, dsm double, dtm double")
    grid = Grid(0.0, 2.0, 1.0, 2, 2)
    for fill in (points.fill_3x3, points.fill_nearest):
        assert {r["dtm"] for r in fill(cells, grid).collect()} == {0.0}


def test_flood_schedule():
    assert [jfa_steps(*s) for s in ((1, 1), (8, 4), (5, 5))] == [[1], [4, 2, 1, 1], [4, 2, 1, 1]]


def test_tile_coverage_error(spark):
    tiles = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    cloud = lambda *urls: spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r["url"]: r["n"] for r in points.tile_coverage(cloud("a", "a", "b"), tiles).collect()} == {"a": 2, "b": 1, "c": 0}
    with pytest.raises(Exception, match="too few tiles"):
        points.tile_coverage(cloud("a"), tiles).collect()


# Buildings


def houses(spark, rows):
    table = spark.createDataFrame(rows, "id long, hauteur double, nombre_d_etages double, hauteur_2 double")
    return table.withColumn("area", F.lit(1.0))


def test_heights(spark):
    known = houses(spark, [(1, 10.0, None, None), (2, 20.0, None, None)])
    assert buildings.mean_height(known).first()[0] == pytest.approx(15.0)
    filled = buildings.process_heights(houses(spark, [(1, None, 5.0, None), (2, 12.0, None, None), (3, None, None, 7.5), (4, None, None, None)]))
    assert [r["hauteur"] for r in filled.orderBy("id").collect()] == [15.0, 12.0, 7.5, 12.0]
    ladder = houses(spark, [(1, None, 4.0, None), (2, None, None, 7.5), (3, None, None, None)])
    assert [r[0] for r in ladder.orderBy("id").select(buildings.get_height()).collect()] == [12.0, 7.5, 0.0]
    nothing = buildings.process_heights(houses(spark, [(1, None, None, None)]))
    assert [r["hauteur"] for r in nothing.collect()] == [0.0]
    assert buildings.stats(known.where("false")).first().asDict() == {"count": 0, "total_area": 0.0, "mean_height": 0.0, "with_height": 0, "min_height": 0.0, "max_height": 0.0}


def test_context_keeps_the_rest():
    c = Context(output="out").with_bbox(0, 0, 1, 1).with_crs(4326)
    assert (c.epsg, c.bbox, c.output) == (4326, BBox(0, 0, 1, 1), "out")
    with pytest.raises(ValueError):
        BBox(1, 0, 0, 1).validated()


# Geometry and projections


def test_geometry(one):
    assert value(one, G.area(square(3e5, 6e6, 10))) == pytest.approx(100.0)
    assert tuple(value(one, G.centroid(square(2, 4, 2)))) == (3.0, 5.0)
    assert value(one, G.perimeter(square(0, 0, 2))) == pytest.approx(8.0)
    lit = F.lit
    assert value(one, G.contains(square(0, 0), lit(0.5), lit(0.5))) and not value(one, G.contains(square(0, 0), lit(1.5), lit(0.5)))
    assert not value(one, G.strictly_contains(square(0, 0), lit(0.0), lit(0.5))) and value(one, G.strictly_contains(square(0, 0), lit(0.2), lit(0.5)))
    box = lambda a, b, c, d: F.struct(lit(a).alias("min_x"), lit(b).alias("min_y"), lit(c).alias("max_x"), lit(d).alias("max_y"))
    assert value(one, G.area(G.clip_to_box(square(0, 0, 4), box(1.0, 1.0, 2.0, 9.0)))) == pytest.approx(3.0)
    assert value(one, G.intersects_box(square(2, 2, 2), box(0.0, 0.0, 10.0, 10.0))) and not value(one, G.intersects_box(square(20, 20, 2), box(0.0, 0.0, 10.0, 10.0)))
    ring = value(one, G.circle(lit(0.0), lit(0.0), 2.0))
    assert len(ring) == 37 and ring[0] == ring[-1] and all(math.hypot(*p) == pytest.approx(2.0) for p in ring)


def test_projection(one):
    x, y = crs.forward(F.lit(-1.15095), F.lit(46.18430))
    assert (value(one, F.round(x, 3)), value(one, F.round(y, 3))) == (379969.090, 6573354.243)
    x, y = crs.forward(F.lit(-1.15095), F.lit(46.18430), 3946)
    assert (value(one, F.round(x, 3)), value(one, F.round(y, 3))) == (1379693.755, 5228832.243)
    x, y = crs.forward(F.lit(3.0), F.lit(46.5))
    assert value(one, x) == pytest.approx(700000.0) and value(one, y) == pytest.approx(6600000.0)
    lon, lat = crs.inverse(F.lit(379969.090), F.lit(6573354.243))
    assert value(one, lon) == pytest.approx(-1.15095, abs=1e-7) and value(one, lat) == pytest.approx(46.18430, abs=1e-7)
    with pytest.raises(ValueError, match="27700"):
        crs.Cone.of(27700)


# Wind


def test_zone_lengths_and_codes(one):
    lit = lambda v: F.lit(float(v))
    h, w, length = lit(10), lit(20), lit(15)
    assert value(one, W.upwind_length(h, w)) == pytest.approx(11.538461538)
    assert value(one, W.upwind_vortex_length(h, w)) == pytest.approx(4.615384615)
    assert value(one, W.cavity_length(h, w, length)) == pytest.approx(23.438845411)
    assert value(one, W.wake_length(h, w, length)) == pytest.approx(70.316536232)
    assert value(one, W.displacement_height(h, w)) == pytest.approx(2.926)
    lf, lfv, lr, lw = 11.538461538, 4.615384615, 23.438845411, 70.316536232
    b = F.struct(*[lit(v).alias(n) for n, v in {"h": 10, "w": 20, "l": 15, "weff": 20, "leff": 15, "lu": lf, "lfv": lfv, "lr": lr, "lw": lw}.items()])
    at = lambda a, c: value(one, W.zone_code(lit(a), lit(c), b))
    assert [at(0, 0), at(-100, 0), at(100, 100), at(-7.5 - lf / 2, 0), at(7.5 + lr / 2, 0), at(7.5 + lr + (lw - lr) / 2, 0), at(-7.5 - lfv / 2, 0)] == [W.INSIDE, W.FREE, W.FREE, W.UPWIND, W.CAVITY, W.WAKE, W.UPWIND_VORTEX]


def test_profiles(one):
    lit = lambda v: F.lit(float(v))
    urban = lambda z: value(one, W.urban_profile(lit(z), lit(10), lit(1), lit(5), lit(12), lit(0.2)))
    assert urban(10) == pytest.approx(1.0, abs=1e-9) and 0 < urban(1.5) < 1
    log = lambda z: value(one, W.log_profile(lit(z), lit(10), lit(0.5)))
    assert log(10) == pytest.approx(1.0) and log(20) > 1 and 0 < log(5) < 1
    a, c = W.to_wind_frame(lit(100), lit(200), 225.0)
    back = W.from_wind_frame(a, c, 225.0)
    assert value(one, back[0]) == pytest.approx(100.0) and value(one, back[1]) == pytest.approx(200.0)
    veg = lambda z: value(one, W.vegetation_factor(lit(z), lit(8), lit(0.2), lit(0), lit(2), True))
    assert 0 < veg(2) < 1 and veg(8) == 1.0


def test_solver_uniform_and_solid():
    solid = np.zeros((5, 5, 5), bool)
    u, v, w = solver.solve_block(np.ones((5, 5, 5)), np.zeros((5, 5, 5)), np.zeros((5, 5, 5)), solid, 1, 1, 1, 1e-4, 100)
    assert np.abs(u[1:-1, 1:-1, 1:-1] - 1).max() < 1e-3
    solid[2, 2, 2] = True
    for form in ("reference", "poisson"):
        u, v, w = solver.solve_block(np.full((5, 5, 5), 2.0), np.full((5, 5, 5), 3.0), np.full((5, 5, 5), 4.0), solid, 1, 1, 1, 1e-4, 100, form)
        assert u[2, 2, 2] == v[2, 2, 2] == w[2, 2, 2] == 0


# Biotope


def parcel(spark, rows, names="classe string, surface double"):
    return spark.createDataFrame(rows, names)


def test_biotope(spark, one):
    area = spark.createDataFrame([(10000.0,)], "parcel_area double")
    cbs = lambda rows: biotope.score(biotope.by_class(biotope.annotate(rows)), area).first()["cbs"]
    half = parcel(spark, [("Pelouse", 5000.0), ("Zone imperméable", 5000.0)])
    assert cbs(half) == pytest.approx(0.5)
    hard = parcel(spark, [("surface_totalement_impermeable_sans_vegetation", 10000.0)], "bff_class string, surface double")
    assert cbs(hard) == 0.0
    assert cbs(parcel(spark, [(1, 10000.0)], "type_plui int, surface double")) == pytest.approx(1.0)
    tree = parcel(spark, [("vegetation_pleine_terre_contact_direct_sol", 2, 10.0, 500.0), ("surface_totalement_impermeable_sans_vegetation", None, None, 9500.0)], "bff_class string, n_arbres int, forfait_arbre_m2 double, surface double")
    assert cbs(tree) == pytest.approx(20 / 10000)
    assert cbs(half.where("false")) == 0.0
    got = biotope.compare(area.selectExpr("0.5 AS cbs"), area.selectExpr("0.0 AS cbs")).first()
    assert float(got["delta"]) == -0.5 and got["alert"]
    ladder = lambda m, roof=None: value(one, biotope.thickness_class(F.lit(m), None if roof is None else F.lit(roof)))
    assert ladder(0.9) == "vegetation_hors_sol_substrat_81_150cm" and ladder(0.15) == "toiture_vegetalisee_extensive_substrat_moins_20cm"
    assert ladder(0.3) == "vegetation_hors_sol_substrat_20_40cm" and ladder(0.6, True) == "toiture_vegetalisee_intensive_substrat_plus_50cm"
    with pytest.raises(Exception, match="no biotope class"):
        biotope.annotate(parcel(spark, [("Lune", 1.0)])).collect()
    with pytest.raises(Exception, match="without area"):
        biotope.score(biotope.by_class(biotope.annotate(half)), spark.createDataFrame([(0.0,)], "parcel_area double")).collect()


# Features


def test_geojson(spark):
    ring = "[[[0,0],[1,0],[1,1],[0,1],[0,0]]]"
    text = f'{{"type":"FeatureCollection","features":[{{"type":"Feature","properties":{{"hauteur":8}},"geometry":{{"type":"Point","coordinates":[1,2]}}}},{{"type":"Feature","properties":{{"HAUTEUR":8,"nature":"x"}},"geometry":{{"type":"Polygon","coordinates":{ring}}}}}]}}'
    rows = features.buildings_from_geojson(spark.createDataFrame([(text,)], "value string")).collect()
    assert len(rows) == 1 and rows[0]["hauteur"] == 8.0 and rows[0]["metadata"] == {"nature": "x"} and len(rows[0]["ring"]) == 5
    out = features.feature_json(buildings.with_shape(features.buildings_from_geojson(spark.createDataFrame([(text,)], "value string")))).first()[0]
    assert '"hauteur":8.0' in out and '"area":1.0' in out and "HAUTEUR_2" not in out
    with pytest.raises(Exception, match="not a FeatureCollection"):
        features.read_features(spark.createDataFrame([('{"type":"Topology"}',)], "value string")).collect()


def test_small_text_functions(spark):
    urls = [("http://a/x.copc.laz", True), ("x.copc.something", True), ("x.laz", False), ("x.las", False)]
    rows = spark.createDataFrame(urls, "url string, want boolean").select("want", features.is_copc(F.col("url")).alias("got"), features.cache_name(F.col("url")).alias("name")).collect()
    assert all(r["want"] == r["got"] for r in rows) and len({r["name"] for r in rows}) == 4
    assert spark.range(1).select(features.truncated(F.lit("éàüö"), 2)).first()[0] == "éà…"


# Spatial joins, map algebra, trees, comfort


def test_thinning_is_greedy(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(y), float(h)) for i, (x, y, h) in enumerate(zip(rng.random(120) * 40, rng.random(120) * 40, rng.integers(2, 20, 120), strict=True))]
    kept = []
    for i, x, y, _h in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all((x - a) ** 2 + (y - b) ** 2 >= 16 for _, a, b in kept):
            kept.append((i, x, y))
    got = spatialjoin.thin(spark.createDataFrame(rows, "id long, x double, y double, height double"), 4.0)
    assert {r["id"] for r in got.collect()} == {k[0] for k in kept}


def test_components(spark):
    grid = Grid(0.0, 6.0, 1.0, 6, 6)
    shape = ["110111", "100001", "111101", "000001", "011111", "000000"]
    cells = spark.createDataFrame([(r, c, int(v)) for r, line in enumerate(shape) for c, v in enumerate(line)], "row int, col int, value int")
    got = {(r["row"], r["col"]): r["label"] for r in mapalgebra.components(cells, grid).collect()}
    for r in range(6):
        for c in range(6):
            seen, todo = {(r, c)}, [(r, c)]
            while todo:
                i, j = todo.pop()
                near = {(i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)} - seen
                near = {(a, b) for a, b in near if 0 <= a < 6 and 0 <= b < 6 and shape[a][b] == shape[r][c]}
                seen |= near
                todo += near
            assert got[r, c] == min(a * 6 + b for a, b in seen)


def test_trees(spark):
    g = lambda r, c, r0, c0, h: h * math.exp(-((r - r0) ** 2 + (c - c0) ** 2) / 8)
    rows = [(r, c, max(g(r, c, 10, 10, 12), g(r, c, 10, 22, 8))) for r in range(30) for c in range(30)]
    grid = Grid(0.0, 30.0, 1.0, 30, 30)
    found = trees.crowns(spark.createDataFrame(rows, "row int, col int, chm double"), grid).collect()
    assert sorted(round(t["H"]) for t in found) == [8, 12] and all(t["D"] > 0 and t["LAI"] == 4 for t in found)
    assert trees.crowns(spark.createDataFrame([(r, c, 0.0) for r in range(5) for c in range(5)], "row int, col int, chm double"), grid).count() == 0


def test_nearest_direction_wraps_only_if_asked(spark):
    rows = spark.createDataFrame([(350.0,), (18.0,)], "wdir double")
    assert [r["raster_dir"] for r in comfort.wind_direction(rows).collect()] == [324.0, 0.0]
    assert comfort.wind_direction(rows, circular=True).first()["raster_dir"] == 0.0


# Sources and sinks


def test_las_round_trip(spark, tmp_path):
    x, y, z, c = np.array([100.0, 1.25, 7.5]), np.array([200.0, 2.5, 8.0]), np.array([50.0, 3.75, 9.0]), np.array([67, 64, 300])
    (tmp_path / "a.las").write_bytes(las.las_bytes(x, y, z, c))
    rows = las.read_las(spark, str(tmp_path / "a.las")).collect()
    assert [(r["x"], r["y"], r["z"], r["classification"]) for r in rows] == [(100.0, 200.0, 50.0, 67), (1.25, 2.5, 3.75, 64), (7.5, 8.0, 9.0, 1)]
    with pytest.raises(ValueError):
        las.parse_header(b"nope")


def test_copc_pages():
    info = las.parse_copc_info(struct.pack("<5d2Q", 1, 2, 3, 500, 1, 1024, 256).ljust(160, b"\0"))
    assert (info.center, info.halfsize, info.root_offset, info.root_size) == ((1.0, 2.0, 3.0), 500.0, 1024, 256)
    assert las.CopcInfo((0.0, 0.0, 0.0), 1000.0, 1.0, 0, 0).bounds(1, 1, 1) == (0.0, 0.0, 1000.0, 1000.0)
    entry = struct.pack("<4iQ2i", 1, 2, 3, 4, 1000, 500, 100)
    assert las.parse_page(entry) == [(1, 2, 3, 4, 1000, 500, 100)]
    child = struct.pack("<4iQ2i", 0, 0, 0, 0, 96, 32, -1) + struct.pack("<4iQ2i", 0, 0, 0, 0, 9999, 32, -1) + struct.pack("<4iQ2i", 0, 0, 0, 0, 5, 6, 7)
    assert las.walk_pages(child + entry, las.CopcInfo((0, 0, 0), 1, 1, 0, 96)) == [(0, 0, 0, 0, 5, 6, 7), (1, 2, 3, 4, 1000, 500, 100)]


def test_geotiff_round_trip(spark, tmp_path):
    grid = Grid(1000.0, 2000.0, 2.0, 4, 3)
    bands = [np.arange(12, dtype=float).reshape(3, 4), np.full((3, 4), -9999.0)]
    data = geotiff.encode(bands, grid, -9999.0)
    cube, transform, nodata = geotiff.decode(data)
    assert (cube[..., 0] == bands[0]).all() and transform == grid.transform and nodata == -9999.0
    (tmp_path / "a.tif").write_bytes(data)
    rows = geotiff.read_geotiff(spark, str(tmp_path / "a.tif")).orderBy("row", "col").collect()
    assert len(rows) == 12 and rows[5]["bands"] == [5.0, None] and rows[5]["x"] == 1002.0


def test_wind_lines(spark, tmp_path):
    cells = spark.createDataFrame([(r, c, c + 0.5, -r - 0.5, 1.5, 2.0, 0.0) for r in range(2) for c in range(3)], "row int, col int, x double, y double, z double, u double, v double")
    lines = files.wind_lines(cells, 3, 2, 1.5).select("value")
    assert lines.first()[0] == "# 3 2 1.5" and files.read_wind_lines(lines).count() == 6
    with pytest.raises(ValueError):
        files.read_wind_lines(lines.where("value not like '0.500 -0.5%'"))


def test_ewkb(spark):
    ring = [(0.0, 0.0), (1.5, 0.0), (1.5, -2.25), (0.0, 0.0)]
    table = spark.createDataFrame([(ring,)], "ring array<struct<x:double,y:double>>")
    want = struct.pack("<BIIII", 1, 0x20000003, 2154, 1, 4) + b"".join(struct.pack("<2d", *p) for p in ring)
    assert bytes(table.select(files.ewkb(F.col("ring"), 2154)).first()[0]) == want


def test_request_builders():
    assert requests.capped(5843, 3428) == (5010, 2939)
    assert "BBOX=46.1,-1.2,46.2,-1.1" in requests.wms_url("L", BBox(-1.2, 46.1, -1.1, 46.2), "dem") and "BBOX=-1.2,46.1,-1.1,46.2" in requests.wms_url("L", BBox(-1.2, 46.1, -1.1, 46.2), "irc")
    assert "CQL_FILTER=a%20%3D%201" in requests.wfs_url("http://s?x", "T", BBox(0, 0, 1, 1), "a = 1")


def test_streaming_windows(spark, small, tmp_path):
    from urbanspark.streaming.events import windowed_means

    batch = spark.read.parquet(f"{small}/events.parquet")
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_means(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == batch.where("ts is not null").count()


def test_nearest_in_row_against_all_distances():
    import random

    from urbanspark.operators.points import nearest_in_row

    rng = random.Random(3)
    for _ in range(2000):
        w, row = rng.randrange(1, 25), rng.randrange(12)
        col = sorted(rng.sample(range(w), rng.randrange(1, w + 1)))
        source = [rng.randrange(12) for _ in col]
        index = [v * w + u for u, v in zip(col, source, strict=True)]
        got = nearest_in_row(col, [abs(v - row) for v in source], index, w)
        assert got == [min(range(len(col)), key=lambda i, x=x: ((x - col[i]) ** 2 + (source[i] - row) ** 2, index[i])) for x in range(w)]
