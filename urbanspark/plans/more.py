"""More registered queries: polygon algebra, rings of rasters, small operators; each with SQL where SQL can express it."""

from __future__ import annotations



from pyspark.sql import functions as F

from .. import dims
from ..core import shuffled, spread
from ..functions import geometry as G
from ..operators import biotope, comfort, features, graphs, mapalgebra, polygons, trees, urban
from ..sources import vector
from .fixtures import BLD, GRID, read
from .fixtures import buildings as bld
from .queries import _BOTH, _CELLS, _cells, _edges, query, thinned, values

# Polygons. Features are rectangles that overlap, several a parcel; SQL cuts each parcel's plane at all their sides.

_RECT = """f AS (SELECT p_partkey AS id, p_partkey % 97 AS parcel, CAST(p_partkey * 7 % 61 AS DOUBLE) AS x0, CAST(p_partkey * 13 % 53 AS DOUBLE) AS y0, p_partkey * 7 % 61 + 4e0 + p_size % 11 AS x1,
  p_partkey * 13 % 53 + 3e0 + p_size % 17 AS y1, p_size AS weight FROM part)"""
_CUT = f"""WITH {_RECT}, xs AS (SELECT parcel, x, lead(x) OVER (PARTITION BY parcel ORDER BY x) AS nx FROM (SELECT parcel, x0 AS x FROM f UNION SELECT parcel, x1 FROM f)),
  ys AS (SELECT parcel, y, lead(y) OVER (PARTITION BY parcel ORDER BY y) AS ny FROM (SELECT parcel, y0 AS y FROM f UNION SELECT parcel, y1 FROM f)),
  c AS (SELECT parcel, x, nx, y, ny FROM xs JOIN ys USING (parcel) WHERE nx IS NOT NULL AND ny IS NOT NULL)"""


def _rectangles(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    x, y = (k * 7 % 61).cast("double"), (k * 13 % 53).cast("double")
    ring = G.rectangle(x, y, x + 4 + size % 11, y + 3 + size % 17)
    return spread(read(spark, d, "part").select("p_partkey", "p_size")).select(k.alias("id"), (k % 97).alias("parcel"), ring.alias("ring"), size.alias("weight"), k.alias("ord"))


@query(f"{_CUT} SELECT parcel, round(sum((nx - x) * (ny - y)), 6) AS area FROM c WHERE EXISTS (SELECT 1 FROM f WHERE f.parcel = c.parcel AND f.x0 <= c.x AND f.x1 >= c.nx AND f.y0 <= c.y AND f.y1 >= c.ny) GROUP BY 1")
def polygon_dissolve(spark, d):
    parts = polygons.dissolved(_rectangles(spark, d), "parcel")
    return polygons.areas(parts, "parcel").select("parcel", F.round("area", 6).alias("area"))


_MASKED = "f.id % 3 <> 0"


@query(f"""{_CUT}, m AS (SELECT * FROM c WHERE EXISTS (SELECT 1 FROM f WHERE NOT {_MASKED} AND f.parcel = c.parcel AND f.x0 <= c.x AND f.x1 >= c.nx AND f.y0 <= c.y AND f.y1 >= c.ny))
  SELECT f.id, round(sum((nx - x) * (ny - y)), 6) AS area FROM f JOIN m ON f.parcel = m.parcel AND f.x0 <= m.x AND f.x1 >= m.nx AND f.y0 <= m.y AND f.y1 >= m.ny WHERE {_MASKED} GROUP BY 1""")
def polygon_clip_to_parcel(spark, d):
    rows = _rectangles(spark, d)
    parts = polygons.clipped(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0"), "parcel")
    return polygons.areas(parts, "id").select("id", F.round("area", 6).alias("area"))


@query(f"""WITH {_RECT}, xs AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx FROM (SELECT x0 AS x FROM f UNION SELECT x1 FROM f)), ys AS (SELECT y, lead(y) OVER (ORDER BY y) AS ny FROM (SELECT y0 AS y FROM f UNION SELECT y1 FROM f)),
  c AS (SELECT * FROM xs, ys WHERE nx IS NOT NULL AND ny IS NOT NULL), w AS (SELECT DISTINCT ON (x, y) c.x, c.nx, c.y, c.ny, f.id FROM c JOIN f ON f.x0 <= c.x AND f.x1 >= c.nx AND f.y0 <= c.y AND f.y1 >= c.ny ORDER BY x, y, weight DESC, id)
  SELECT id, round(sum((nx - x) * (ny - y)), 6) AS area FROM w GROUP BY 1""")
def polygon_overlay_by_weight(spark, d):
    parts = polygons.overlay(_rectangles(spark, d))
    return polygons.areas(parts, "id").select("id", F.round("area", 6).alias("area"))


# A ring that crosses itself like an eight encloses two triangles.
@query("SELECT p_partkey AS id, round(p_size * (p_partkey % 9 + 1) / 2e0, 6) AS area FROM part")
def polygon_repair(spark, d):
    w, h = F.col("p_size").cast("double"), (F.col("p_partkey") % 9 + 1).cast("double")
    ring = F.array(G.point(0.0, 0.0), G.point(w, h), G.point(w, 0.0 * h), G.point(0.0, h), G.point(0.0, 0.0))
    parts = polygons.repaired(read(spark, d, "part").select(F.col("p_partkey").alias("id"), ring.alias("ring")), 64.0)
    return polygons.areas(parts, "id").select("id", F.round("area", 6).alias("area"))


@query("SELECT p_partkey AS id, CAST(k AS INT) AS part, round(CAST((p_size + k) * (p_size + k) AS DOUBLE), 6) AS area FROM part, range(3) t(k) WHERE k <= p_partkey % 3")
def multipart_explode(spark, d):
    s = lambda k: (F.col("p_size") + k).cast("string")
    square = lambda k: F.concat(F.lit("[[[0,0],["), s(k), F.lit(",0],["), s(k), F.lit(","), s(k), F.lit("],[0,"), s(k), F.lit("],[0,0]]]"))
    many = F.concat(F.lit("["), F.array_join(F.slice(F.array(*[square(k) for k in range(3)]), F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int")), ","), F.lit("]"))
    kind = F.when(F.col("p_partkey") % 3 == 0, "Polygon").otherwise("MultiPolygon")
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), F.when(F.col("p_partkey") % 3 == 0, square(0)).otherwise(many).alias("coordinates"))
    return polygons.exploded(rows).select("id", "part", F.round(G.area(F.col("ring"), F.col("holes")), 6).alias("area"))


@query(f"""{_CELLS}, v AS (SELECT "row", col, CAST(CASE WHEN dsm > 49.5e0 THEN 1 ELSE 0 END AS INT) AS value, CAST("row" * 50 + col AS BIGINT) AS i FROM base),
  e AS (SELECT a.i AS p, b.i AS q FROM v a JOIN v b ON a.value = b.value AND abs(a."row" - b."row") + abs(a.col - b.col) = 1),
  r AS (WITH RECURSIVE w(i, root) AS (SELECT i, i FROM v UNION SELECT e.q, w.root FROM w JOIN e ON e.p = w.i WHERE e.q > w.root) SELECT i, min(root) AS label FROM w GROUP BY 1)
  SELECT r.label, value, round(count(*) * 16e0, 6) AS area, round((4 * count(*) - sum((SELECT count(*) FROM e WHERE e.p = v.i))) * 4e0, 6) AS perimeter FROM v JOIN r USING (i) GROUP BY 1, 2""")
def raster_rings(spark, d):
    cells = _cells(spark, d).select("row", "col", F.when(F.col("dsm") > 49.5, 1).otherwise(0).alias("value"))
    rings = polygons.cell_rings(mapalgebra.components(cells, GRID), GRID.x_min, GRID.y_max, GRID.res)
    each = rings.select("label", "value", G.signed_area(F.col("ring")).alias("a"), G.perimeter(F.col("ring")).alias("p"))
    return each.groupBy("label", "value").agg(F.round(F.abs(F.sum("a")), 6).alias("area"), F.round(F.sum("p"), 6).alias("perimeter"))


_TREE = "t AS (SELECT p_partkey AS id, CAST(p_partkey * 37 % 199 AS DOUBLE) + 0.25e0 AS x, CAST(p_partkey * 61 % 97 AS DOUBLE) + 0.75e0 AS y, CAST(p_size AS DOUBLE) AS h, 1e0 + p_size % 7 AS dia FROM part)"


def _tall(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select(k.alias("id"), ((k * 37 % 199).cast("double") + 0.25).alias("x"), ((k * 61 % 97).cast("double") + 0.75).alias("y"), F.col("p_size").cast("double").alias("H"), (F.col("p_size") % 7 + 1.0).alias("D"))


@query(f"WITH {_TREE} SELECT id, h FROM t WHERE h <= 30")
def tree_height_limit(spark, d):
    return trees.not_taller(_tall(spark, d), 30.0).select("id", F.col("H").alias("h"))


@query(f"WITH {_TREE}, s AS (SELECT s_suppkey * 17 % 180 AS a, s_suppkey * 29 % 80 AS b FROM supplier) SELECT id FROM t WHERE EXISTS (SELECT 1 FROM s WHERE x >= a AND x < a + 12 AND y >= b AND y < b + 9)")
def trees_in_mask(spark, d):
    k = F.col("s_suppkey")
    a, b = (k * 17 % 180).cast("double"), (k * 29 % 80).cast("double")
    return polygons.in_any(_tall(spark, d), read(spark, d, "supplier").select(G.rectangle(a, b, a + 12, b + 9).alias("ring"))).select("id")


@query(f"WITH RECURSIVE {thinned(f'WITH {_TREE} SELECT id, x, y, h AS height, dia FROM t WHERE h <= 30', '4e0')} SELECT id, round(18 * sin(2 * pi() / 36) * dia * dia / 4, 6) AS area FROM t")
def tree_crown_circles(spark, d):
    out = trees.crown_circles(_tall(spark, d), 30.0, 4.0)
    return out.select("id", F.round(G.area(F.col("ring")), 6).alias("area"))


# Small operators


@query(f"WITH {BLD} SELECT id, hauteur, w * l AS area, round(x0 + w / 2, 6) AS centroid_x, round(y0 + l / 2, 6) AS centroid_y, nombre_d_etages, hauteur_2, hauteur IS NULL AS \"noHauteur\" FROM bld")
def building_export_frame(spark, d):
    from ..operators import buildings

    rows = buildings.with_shape(bld(spark, d))
    out = buildings.export_frame(rows.withColumn("nombre_d_etages", F.col("nombre_d_etages")))
    keyed = rows.select("id", *out.columns)
    return keyed.withColumns({c: F.round(c, 6) for c in ("centroid_x", "centroid_y")})


@query(f"WITH {BLD} SELECT id, hauteur FROM bld WHERE hauteur IS NOT NULL")
def heights_known(spark, d):
    return bld(spark, d).dropna(subset=["hauteur"]).select("id", "hauteur")


@query(f"WITH {BLD} SELECT id, round(x0 + w / 2, 6) AS mean_x, round(y0 + l / 2, 6) AS mean_y, round(sqrt(w * w + l * l) / 2, 6) AS radius, round(18 * sin(2 * pi() / 36) * (w * w + l * l) / 4, 6) AS circle_area FROM bld")
def ring_measures(spark, d):
    m, r = G.vertex_mean(F.col("ring")), G.circumscribed_radius(F.col("ring"))
    out = bld(spark, d).select("id", m["x"].alias("mean_x"), m["y"].alias("mean_y"), r.alias("radius"))
    return out.withColumn("circle_area", G.area(G.circle(F.col("mean_x"), F.col("mean_y"), F.col("radius")))).select("id", *[F.round(c, 6).alias(c) for c in ("mean_x", "mean_y", "radius", "circle_area")])


@query(f"WITH {BLD} SELECT id, id % 4 = 0 AS tree, round(CASE WHEN id % 4 = 0 THEN 18 * sin(2 * pi() / 36) * (w * w + l * l) / 4 ELSE w * l END, 6) AS area FROM bld")
def layer_polygons(spark, d):
    layer = F.when(F.col("id") % 4 == 0, "ENON-arbres à planter").otherwise("MUR")
    shape = vector.layer_polygon(layer, F.col("ring"))
    return bld(spark, d).select("id", layer.contains("ENON-arbres").alias("tree"), F.round(G.area(shape), 6).alias("area"))


@query("SELECT p_partkey AS id, (p_partkey % 50) * 4e0 AS corner_x, 100 - (p_size % 25) * 4e0 AS corner_y, (p_partkey % 50) * 4e0 + 2 AS centre_x, 98 - (p_size % 25) * 4e0 AS centre_y FROM part")
def pixel_positions(spark, d):
    r, c = F.col("p_size") % 25, F.col("p_partkey") % 50
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), GRID.x_of(c).alias("corner_x"), GRID.y_of(r).alias("corner_y"), GRID.x_of(c, 0.5).alias("centre_x"), GRID.y_of(r, 0.5).alias("centre_y"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 AND value - 20e0 >= 0 THEN value - 20e0 END AS speed FROM events")
def wind_cleaned(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, -9999.0).when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value") - 20.0)
    return read(spark, d, "events").select("event_id", comfort.clean_wind(raw).alias("speed"))


@query("""SELECT l_orderkey, l_linenumber, ends_with(u, '.copc.laz') OR contains(u, '.copc.') AS copc, CASE WHEN length(u) > 30 THEN substr(u, 1, 30) || '…' ELSE u END AS shown
  FROM (SELECT l_orderkey, l_linenumber, 'https://example.org/' || l_orderkey || CASE l_linenumber % 3 WHEN 0 THEN '.copc.laz' WHEN 1 THEN '.copc.zip/tile' ELSE '.laz' END AS u FROM lineitem)""")
def cloud_addresses(spark, d):
    tail = F.when(F.col("l_linenumber") % 3 == 0, ".copc.laz").when(F.col("l_linenumber") % 3 == 1, ".copc.zip/tile").otherwise(".laz")
    url = F.concat(F.lit("https://example.org/"), F.col("l_orderkey").cast("string"), tail)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", features.is_copc(url).alias("copc"), features.truncated(url, 30).alias("shown"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN -9999e0 ELSE value END AS value FROM events")
def nodata_for_nan(spark, d):
    rows = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 12 == 0, float("nan")).when(F.col("event_id") % 6 != 0, F.col("value")).alias("value"))
    return mapalgebra.nan_to_nodata(rows)


@query("SELECT p_partkey AS id, p_size, row_number() OVER (ORDER BY p_partkey) AS uniqueid FROM part WHERE p_size IN (6, 1)")
def soil_numbered(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return features.numbered_subset(rows, "p_size", [6, 1], "id")


@query("SELECT p_size AS value, count(*) AS n FROM part GROUP BY 1")
def class_histogram(spark, d):
    return mapalgebra.class_histogram(read(spark, d, "part").select(F.col("p_size").alias("value")))


@query("SELECT count(*) FILTER (event_id % 6 = 0 AND event_id % 12 <> 0) AS filled, round(count(*) FILTER (event_id % 6 = 0 AND event_id % 12 <> 0) / count(*), 9) AS share FROM events")
def filled_cells(spark, d):
    before = F.when(F.col("event_id") % 6 != 0, F.col("value"))
    after = F.when(F.col("event_id") % 12 != 0, F.col("value"))
    n, share = mapalgebra.filled_share(before, after)
    return read(spark, d, "events").agg(n.alias("filled"), F.round(share, 9).alias("share"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS canopy, value AS first FROM events")
def canopy_band(spark, d):
    rows = read(spark, d, "events").select("event_id", F.col("value").alias("b1"), F.lit(0.0).alias("b2"), F.when(F.col("event_id") % 3 == 0, -9999.0).otherwise(F.col("value")).alias("b3"))
    return rows.select("event_id", mapalgebra.canopy_band(rows, ["b1", "b2", "b3"]).alias("canopy"), mapalgebra.canopy_band(rows, ["b1"]).alias("first"))


@query(f"WITH k(classe, colour, ord) AS (VALUES {values(dims.COSIA_COLOUR)}), n AS (SELECT count(*) AS n FROM k), c AS (SELECT p_partkey AS id, (SELECT classe FROM k WHERE ord = p_partkey % 20) AS classe FROM part) SELECT id, coalesce(colour, '{dims.COSIA_DEFAULT_COLOUR}') AS colour FROM c LEFT JOIN k USING (classe)")
def landcover_colour(spark, d):
    table = dims.lookup(spark, dims.COSIA_COLOUR, "classe", "colour")
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 20).alias("ord")).join(F.broadcast(table.select("ord", "classe")), "ord", "left")
    return mapalgebra.class_colour(rows, table, "classe", dims.COSIA_DEFAULT_COLOUR).select("id", "colour")


@query(f"""WITH {BLD} SELECT id, k AS name, hauteur_2 + k AS hauteur FROM bld, range(6) t(k)""")
def height_column(spark, d):
    # A table for each of the names; later names are there too and don't count.
    names = features.HEIGHT_COLUMNS
    h = F.col("hauteur_2")
    table = lambda k: bld(spark, d).select("id", F.lit(k).cast("long").alias("name"), *[(h + j).alias(n) for j, n in reversed(list(enumerate(names))) if j >= k and not (n == "HAUTEUR" and k == 0)])
    out = [features.ensure_height(table(k)).select("id", "name", "hauteur") for k in range(len(names))]
    every = out[0]
    for t in out[1:]:
        every = every.unionByName(t)
    return every


@query(f"WITH {BLD} SELECT id, x0 + w / 2 - 250e0 AS min_x, y0 + l / 2 - 250e0 AS min_y, x0 + w / 2 + 250e0 AS max_x, y0 + l / 2 + 250e0 AS max_y FROM bld")
def analysis_square(spark, d):
    rows = bld(spark, d).withColumn("e", G.envelope(F.col("ring"))).select("id", "e.*")
    return mapalgebra.domain_square(rows, 250.0)


@query("SELECT event_id, event_type, user_id, value FROM events")
def times_dropped(spark, d):
    return features.without_times(read(spark, d, "events").select("event_id", "ts", "event_type", "user_id", "value"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) || CASE p_partkey % 4 WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END END AS text FROM part")
def number_texts(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), features.number_text(F.col("p_size") + F.col("p_partkey") % 4 / 4.0).alias("text"))


@query("SELECT max(p_name) AS name FROM part")
def newest_file(spark, d):
    return features.newest(read(spark, d, "part").select(F.col("p_name").alias("name")))


@query("""SELECT user_id AS "row", CAST(event_id % 3 AS INT) AS col, round(avg(value), 7) AS mean, round(avg(value) FILTER (hour(ts) BETWEEN 7 AND 19), 7) AS day_mean, round(avg(value) FILTER (hour(ts) NOT BETWEEN 7 AND 19), 7) AS night_mean FROM events GROUP BY 1, 2""")
def comfort_summary(spark, d):
    rows = read(spark, d, "events").select("ts", F.col("user_id").alias("row"), (F.col("event_id") % 3).cast("int").alias("col"), F.col("value").alias("utci"))
    return comfort.summary(rows).select("row", "col", *[F.round(c, 7).alias(c) for c in ("mean", "day_mean", "night_mean")])


@query("SELECT event_id FROM events WHERE ts >= (SELECT date_trunc('day', min(ts)) FROM events) AND ts <= (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY + INTERVAL 86399 SECOND FROM events)")
def time_window(spark, d):
    rows = read(spark, d, "events")
    first = rows.agg(F.date_trunc("day", F.min("ts")).alias("a")).first()["a"]
    import datetime

    return comfort.time_range(rows, str(first), str(first + datetime.timedelta(days=1))).select("event_id")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 5) * 20e0 ELSE 0e0 END AS credit, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 > 0 THEN 0e0 ELSE CAST(p_size AS DOUBLE) END AS surface FROM part""")
def tree_credit(spark, d):
    some = F.col("p_partkey") % 3 == 0
    rows = read(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("surface"), F.lit("surface_totalement_impermeable_sans_vegetation").alias("bff_class"),
        F.when(some, (F.col("p_partkey") % 5).cast("int")).alias("n_arbres"), F.when(some, 20.0).alias("forfait_arbre_m2"),
    )
    return biotope.annotate(rows).select("id", "credit", "surface")


@query(f"WITH {BLD} SELECT id, round(w * l / (w * l + 40e0), 9) AS car FROM bld")
def coverage_ratio(spark, d):
    rows = bld(spark, d).select("id", "area")
    return urban.tessellation_areas(rows, rows.select("id", (F.col("area") + 40.0).alias("cell_area"))).select("id", F.round("car", 9).alias("car"))


@query(f"WITH {_BOTH} SELECT id, area, round(sum(o.other) / count(o.other), 7) AS mean_other FROM v JOIN (SELECT n.id AS k, v.area AS other FROM n JOIN v ON v.id = n.o) o ON o.k = v.id GROUP BY 1, 2")
def neighbour_mean(spark, d):
    areas = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.abs("c_acctbal").alias("area"))
    out = urban.covered_area(_edges(spark, d), areas).join(shuffled(areas), "id").where("neighbours > 0")
    return out.select("id", "area", F.round("mean_area", 7).alias("mean_other"))


# A street along the x axis between two rows of walls, each at its own distance.
@query("SELECT s_suppkey AS street_id, 10e0 + s_suppkey % 5 + s_suppkey % 3 AS width, 0e0 AS deviation, 0e0 AS openness FROM supplier")
def street_profiles(spark, d):
    k = F.col("s_suppkey")
    base = read(spark, d, "supplier").select(k.alias("street_id"), (k * 1000.0).alias("y"), (k % 5 + 5.0).alias("up"), (k % 3 + 5.0).alias("down"))
    streets = base.select("street_id", F.lit(0.0).alias("x0"), F.col("y").alias("y0"), F.lit(30.0).alias("x1"), F.col("y").alias("y1"))
    wall = lambda at: base.select(F.lit(-50.0).alias("x0"), at.alias("y0"), F.lit(80.0).alias("x1"), at.alias("y1"))
    out = graphs.street_profile(streets, wall(F.col("y") + F.col("up")).union(wall(F.col("y") - F.col("down"))))
    return out.select("street_id", *[F.round(c, 9).alias(c) for c in ("width", "deviation", "openness")])


# A uniform wind has no divergence, so the solver leaves it as it is; the parts of a class of sizes give a direction its speed.
_SPEEDS = "s AS (SELECT p_size % 4 AS dir, 2e0 + max(p_size) AS u, -1e0 - min(p_size) AS v FROM part GROUP BY 1)"


@query(f"WITH {_SPEEDS} SELECT CAST(dir AS DOUBLE) AS dir, CAST(r AS INT) AS \"row\", CAST(c AS INT) AS col, CAST(z AS INT) AS k, u, v, 0e0 AS w FROM s, range(12) a(r), range(12) b(c), range(5) t(z)")
def uniform_wind(spark, d):
    from ..operators import solver

    size = F.col("p_size")
    speeds = read(spark, d, "part").groupBy((size % 4).cast("double").alias("dir")).agg((F.max(size) + 2.0).alias("speed_u"), (-F.min(size) - 1.0).alias("speed_v"))
    cells = speeds.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumns({"dem": F.lit(0.0), "dsm": F.lit(0.0)})
    out = solver.mass_consistent(solver.initial_field(cells, 10.0, 50.0), 5.0, 5.0, 10.0)
    return out.select("dir", "row", "col", "k", *[F.round(c, 9).alias(c) for c in "uvw"])


@query(f"WITH {BLD} SELECT id, round(0.75e0 * w * l, 5) AS area, round(2 * (w + l), 5) AS perimeter, round(least(w, l) / greatest(w, l), 6) AS elongation, round(sqrt(0.75e0), 6) AS eri, round(6 / 7e0, 6) AS convexity FROM bld")
def rotated_shapes(spark, d):
    # Footprints with a quarter taken out, turned by as many degrees as their number says.
    e = G.envelope(F.col("ring"))
    turn = F.radians((F.col("id") % 180).cast("double"))
    cut = bld(spark, d).select("id", (e["max_x"] - e["min_x"]).alias("w"), (e["max_y"] - e["min_y"]).alias("l"))
    at = lambda x, y: G.point(x * F.cos(turn) - y * F.sin(turn), x * F.sin(turn) + y * F.cos(turn))
    w, l, o = F.col("w"), F.col("l"), F.lit(0.0)
    ring = F.array(at(o, o), at(w, o), at(w, l / 2), at(w / 2, l / 2), at(w / 2, l), at(o, l), at(o, o))
    out = urban.shape_measures(cut.select("id", ring.alias("ring")))
    return out.select("id", F.round("area", 5).alias("area"), F.round("perimeter", 5).alias("perimeter"), *[F.round(c, 6).alias(c) for c in ("elongation", "eri", "convexity")])


@query(f"""WITH {BLD}, r AS (SELECT id, floor(id / 50e0) AS line, l FROM bld), m AS (SELECT a.id, sum(least(a.l, b.l)) AS shared FROM r a JOIN r b ON b.line = a.line AND b.id IN (a.id - 1, a.id + 1) GROUP BY 1)
SELECT id, round(coalesce(shared, 0), 5) AS shared, round(coalesce(shared, 0) / (2 * (10 + l)), 6) AS share FROM r LEFT JOIN m USING (id)""")
def shared_walls(spark, d):
    # Rows of fifty houses side by side.
    e = G.envelope(F.col("ring"))
    x = (F.col("id") % 50) * 10.0
    rows = bld(spark, d).select("id", G.rectangle(x, e["min_y"], x + 10.0, e["max_y"]).alias("ring"))
    return urban.shared_walls(rows).select("id", F.round("shared", 5).alias("shared"), F.round("share", 6).alias("share"))


@query(f"""WITH {BLD}, e AS (SELECT a.id, b.id AS other, sqrt(power(greatest(a.x0 - b.x0 - b.w, b.x0 - a.x0 - a.w, 0), 2) + power(greatest(a.y0 - b.y0 - b.l, b.y0 - a.y0 - a.l, 0), 2)) AS d
  FROM bld a JOIN bld b ON b.id IN (a.id - 1, a.id + 1)) SELECT bld.id, round(avg(d), 6) AS distance FROM bld LEFT JOIN e ON e.id = bld.id GROUP BY 1""")
def neighbour_distance(spark, d):
    b = bld(spark, d)
    pairs = b.select(F.col("id").alias("a")).join(shuffled(b.select(F.col("id").alias("b"))), F.col("b") == F.col("a") + 1)
    return urban.neighbour_distance(b, pairs).select("id", F.round("distance", 6).alias("distance"))


@query("SELECT s_suppkey AS id, round(sqrt(power(1 + s_suppkey % 7, 2) + power(s_suppkey % 5, 2)) / (1 + s_suppkey % 7 + s_suppkey % 5), 9) AS linearity FROM supplier")
def street_linearity(spark, d):
    a, b, o = 1 + F.col("s_suppkey") % 7, F.col("s_suppkey") % 5, F.lit(0.0)
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round(urban.linearity(F.array(G.point(o, o), G.point(a, o), G.point(a, b))), 9).alias("linearity"))
