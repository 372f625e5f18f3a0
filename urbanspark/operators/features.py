"""GeoJSON features in and out, nested service answers, catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = "array<array<double>>"


def _number(props: Column, *keys: str) -> Column:
    """The first key with a finite number above 0. Text isn't a number, however it reads."""
    out = []
    for k in keys:
        raw = F.get_json_object(props, f"$.{k}")
        is_text = F.regexp_extract(props, rf'"{k}"\s*:\s*(")', 1) != ""
        value = F.when(~is_text, raw.try_cast("double"))
        out.append(F.when((value > 0) & (value < float("inf")), value))
    return F.coalesce(*out)


def lower_keys(props: Column) -> Column:
    """A JSON object's text with its keys in lower case."""
    parsed = F.from_json(props, "map<string,string>")
    keys = F.map_keys(parsed)
    return F.aggregate(keys, props, lambda acc, k: F.replace(acc, F.concat(F.lit('"'), k, F.lit('"')), F.concat(F.lit('"'), F.lower(k), F.lit('"'))))


HEIGHT_KEYS = {"hauteur": ("hauteur", "height"), "nombre_d_etages": ("nombre_d_etages", "storeys", "etages"), "hauteur_2": ("hauteur_2", "height_2", "h2")}


def coalesced_properties(features: DataFrame, props: str = "properties") -> DataFrame:
    """hauteur, nombre_d_etages, hauteur_2 from a JSON object of properties; the other keys go to a map as text."""
    low = lower_keys(F.coalesce(F.col(props), F.lit("{}")))
    rows = features.withColumn("__p", low)
    rows = rows.withColumns({name: _number(F.col("__p"), *keys) for name, keys in HEIGHT_KEYS.items()})
    used = [k for keys in HEIGHT_KEYS.values() for k in keys]
    rest = F.map_filter(F.from_json("__p", "map<string,string>"), lambda k, v: ~k.isin(used) & v.isNotNull())
    return rows.withColumn("metadata", rest).withColumn("noHauteur", F.col("hauteur").isNull()).drop("__p")


def polygon_of(kind: Column, coordinates: Column) -> Column:
    """The polygon's rings, a multipolygon's first; null for other kinds and empty ones. coordinates is JSON text."""
    one = F.from_json(coordinates, f"array<{RING}>")
    many = F.from_json(coordinates, f"array<array<{RING}>>")
    return F.when(kind == "Polygon", F.when(F.size(one) > 0, one)).when(kind == "MultiPolygon", F.when(F.size(many) > 0, F.element_at(F.when(F.size(many) > 0, many), 1)))


def ring_of(rings: Column, index: int = 1) -> Column:
    return F.transform(F.try_element_at(rings, F.lit(index)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def read_features(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row per feature of GeoJSON documents: properties (JSON text), kind, coordinates (JSON text); a lone Feature counts as one."""
    each = "array<struct<properties:string,geometry:struct<type:string,coordinates:string>>>"
    many = F.from_json(F.get_json_object(column, "$.features"), each)
    single = F.from_json(F.concat(F.lit("["), F.col(column), F.lit("]")), each)
    kind = F.get_json_object(column, "$.type")
    listed = F.when(kind == "FeatureCollection", many).when(kind == "Feature", single).otherwise(F.raise_error(F.lit("not a FeatureCollection or a Feature")).cast(each))
    rows = texts.select(F.posexplode(listed).alias("id", "f"))
    return rows.select("id", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def buildings_from_geojson(texts: DataFrame, column: str = "value") -> DataFrame:
    """id, ring, holes, heights and metadata; features without a polygon are skipped."""
    return buildings_of(read_features(texts, column))


def buildings_of(rows: DataFrame) -> DataFrame:
    """The same from features (id, properties, kind, coordinates)."""
    rows = rows.withColumn("rings", polygon_of(F.col("kind"), F.col("coordinates"))).where("rings is not null")
    holes = F.transform(F.slice("rings", F.lit(2), F.size("rings")), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return coalesced_properties(rows).select("id", ring_of(F.col("rings")).alias("ring"), holes.alias("holes"), "hauteur", "nombre_d_etages", "hauteur_2", "noHauteur", "metadata")


def feature_json(buildings: DataFrame) -> DataFrame:
    """One Feature a row as text; unknown heights are left out."""
    coordinates = F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    props = F.struct("hauteur", "area", "nombre_d_etages", F.col("hauteur_2").alias("HAUTEUR_2"))
    return buildings.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"))).alias("feature"))


RNB = "struct<results:array<struct<rnb_id:string,status:string,point:struct<coordinates:array<double>>,addresses:array<struct<street_number:string,city_name:string,city_zipcode:string>>,ext_ids:array<struct<created_at:string>>>>>"


def rnb_points(texts: DataFrame, column: str = "value") -> DataFrame:
    """Points of a building register's answer: the first address and first external id; rows without two coordinates go."""
    r = texts.select(F.explode(F.from_json(column, RNB)["results"]).alias("r")).where(F.size("r.point.coordinates") >= 2)
    first = F.try_element_at(F.col("r.addresses"), F.lit(1))
    return r.select(
        "r.rnb_id", "r.status", F.col("r.point.coordinates")[0].alias("x"), F.col("r.point.coordinates")[1].alias("y"),
        first["street_number"].alias("street_number"), first["city_name"].alias("city_name"), first["city_zipcode"].alias("city_zipcode"), F.try_element_at(F.col("r.ext_ids"), F.lit(1))["created_at"].alias("created_at"),
    )


def dedupe_catalogue(rows: DataFrame) -> DataFrame:
    """One service a key (nom_technique, service, url, file_order): the last of the raster services, else the first of any."""
    raster = F.col("service") == "WMS Raster"
    order = Window.partitionBy("nom_technique").orderBy(F.when(raster, 0).otherwise(1), F.when(raster, -F.col("file_order")).otherwise(F.col("file_order")))
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def lookup_with_fallback(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Keys with their service, or that of the key with .LAMB93 replaced by .SHADOW."""
    c = catalogue.select("nom_technique", "service")
    direct = wanted.join(c.withColumnRenamed("service", "direct"), "nom_technique", "left")
    other = c.select(F.col("nom_technique").alias("other_key"), F.col("service").alias("other"))
    rows = direct.withColumn("other_key", F.replace("nom_technique", F.lit(".LAMB93"), F.lit(".SHADOW"))).join(other, "other_key", "left")
    return rows.select("nom_technique", F.coalesce("direct", "other").alias("service"))


def tile_urls(texts: DataFrame, column: str = "value") -> DataFrame:
    """url of each tile feature: the cleaned cloud's if stated, else the plain one; neither: skipped."""
    f = F.from_json(F.get_json_object(column, "$.features"), "array<struct<properties:struct<url_npl:string,url:string>>>")
    rows = texts.select(F.explode(f).alias("f"))
    return rows.select(F.coalesce("f.properties.url_npl", "f.properties.url").alias("url")).where("url is not null")


def is_copc(url: Column) -> Column:
    return url.endswith(".copc.laz") | url.contains(".copc.")


def cache_name(url: Column) -> Column:
    """A file name for a cached download: what isn't a letter, digit, dot or dash becomes a line, and a digest keeps names apart."""
    return F.concat(F.substring(F.sha2(url, 256), 1, 16), F.lit("-"), F.regexp_replace(F.substring_index(F.substring_index(url, "?", 1), "/", -1), r"[^A-Za-z0-9.\-]", "_"))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


# Names of height columns, in the order in which they are tried.
HEIGHT_COLUMNS = ["hauteur", "height", "HAUTEUR", "hauteur_mean", "H_MEDIANE", "H_MAX"]


def ensure_height(rows: DataFrame, candidates: list[str] = HEIGHT_COLUMNS, name: str = "hauteur") -> DataFrame:
    """The first of the candidate columns that the table has, as ``name``; an error if it has none."""
    found = next((c for c in candidates if c in rows.columns), None)
    if found is None:
        raise ValueError(f"none of the columns {', '.join(candidates)}")
    return rows if found == name else rows.withColumn(name, F.col(f"`{found}`"))


def without_times(rows: DataFrame) -> DataFrame:
    """The table without columns of dates and times."""
    return rows.select(*[F.col(f"`{n}`") for n, t in rows.dtypes if t not in ("date", "timestamp", "timestamp_ntz")])


def numbered_subset(rows: DataFrame, column: str, wanted: list, order: str, name: str = "uniqueid") -> DataFrame:
    """Rows whose column is one of ``wanted``, numbered from 1 in an order.

    Numbers run within ranges of the order, each after the rows of the ranges before it, so no task sees all rows.
    """
    ranged = rows.where(F.col(column).isin(wanted)).repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id()).checkpoint()
    before = ranged.groupBy("__part").count()
    before = before.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))  # a row a task
    within = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return ranged.withColumn("__within", within).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__within")).drop("__part", "__before", "__within")


def newest(rows: DataFrame, name: str = "name") -> DataFrame:
    """The row with the greatest file name."""
    return rows.groupBy().agg(F.max(F.struct(name, *[c for c in rows.columns if c != name])).alias("r")).select("r.*").where(F.col(name).isNotNull())


def number_text(x: Column) -> Column:
    """A number as text without a needless fraction or exponent, up to 12 digits after the point."""
    text = F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return F.when(x == 0, F.lit("0")).when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(text)
