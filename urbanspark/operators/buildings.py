"""Buildings: heights, statistics, export frames. Columns as in the data model: id, ring or area, hauteur, nombre_d_etages, hauteur_2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import wind as W

STOREY = 3.0


def get_height(storey: float = STOREY) -> Column:
    """Known height, else storeys, else the second height, else 0."""
    return F.coalesce(F.col("hauteur"), F.col("nombre_d_etages") * storey, F.col("hauteur_2"), F.lit(0.0))


def with_shape(buildings: DataFrame, ring: str = "ring") -> DataFrame:
    c = G.centroid(F.col(ring))
    return buildings.withColumns({"area": G.area(F.col(ring)), "centroid_x": c["x"], "centroid_y": c["y"]})


def mean_height(buildings: DataFrame) -> DataFrame:
    """One row, mean_height: weighted by area over known heights, 0 if these have no area."""
    known = F.col("hauteur").isNotNull()
    product, total = F.sum(F.when(known, F.col("area") * F.col("hauteur"))), F.sum(F.when(known, F.col("area")))
    return buildings.agg(F.coalesce(product / F.when(total != 0, total), F.lit(0.0)).alias("mean_height"))


def process_heights(buildings: DataFrame, storey: float = STOREY, strict_positive: bool = False) -> DataFrame:
    """Heights filled from storeys, second height or the mean of the heights known before; height_source tells which.

    The mean is one row, joined as such; with ``strict_positive`` rows that end without a positive height go.
    """
    source = F.when(F.col("hauteur").isNotNull(), "known").when(F.col("nombre_d_etages").isNotNull(), "storeys").when(F.col("hauteur_2").isNotNull(), "second").otherwise("mean")
    rows = buildings.crossJoin(F.broadcast(mean_height(buildings)))
    filled = F.coalesce(F.col("hauteur"), F.col("nombre_d_etages") * storey, F.col("hauteur_2"), F.col("mean_height"))
    rows = rows.withColumns({"height_source": source, "hauteur": filled, "noHauteur": F.lit(False)}).drop("mean_height")
    return rows.where("hauteur > 0") if strict_positive else rows.where("hauteur is not null")


def stats(buildings: DataFrame) -> DataFrame:
    """count, total_area, mean_height, with_height, min_height, max_height; 0 where nothing is known."""
    known = F.col("hauteur").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    product, total = F.sum(F.when(known, F.col("area") * F.col("hauteur"))), F.sum(F.when(known, F.col("area")))
    return buildings.agg(
        F.count("*").alias("count"), zero(F.sum("area")).alias("total_area"), zero(product / F.when(total != 0, total)).alias("mean_height"),
        F.count("hauteur").alias("with_height"), zero(F.min("hauteur")).alias("min_height"), zero(F.max("hauteur")).alias("max_height"),
    )


def export_frame(buildings: DataFrame) -> DataFrame:
    return buildings.select("hauteur", "area", "centroid_x", "centroid_y", "nombre_d_etages", "hauteur_2", "noHauteur")


def wind_extents(buildings: DataFrame, direction: float, storey: float = STOREY, ring: str = "ring") -> DataFrame:
    """id, cx, cy, h, w, l, weff, leff: extents along and across the wind, the centroid counted in; 0.1 at least."""
    rows = with_shape(buildings, ring)
    ca, cc = W.to_wind_frame(F.col("centroid_x"), F.col("centroid_y"), direction)
    along = F.transform(F.col(ring), lambda p: W.to_wind_frame(p["x"], p["y"], direction)[0])
    cross = F.transform(F.col(ring), lambda p: W.to_wind_frame(p["x"], p["y"], direction)[1])
    length = W.at_least(F.greatest(F.array_max(along), ca) - F.least(F.array_min(along), ca), 0.1)
    width = W.at_least(F.greatest(F.array_max(cross), cc) - F.least(F.array_min(cross), cc), 0.1)
    rows = rows.select("id", F.col("centroid_x").alias("cx"), F.col("centroid_y").alias("cy"), get_height(storey).alias("h"), width.alias("w"), length.alias("l"), "area")
    ratio = F.least(W.at_least(F.col("area"), 1e-10) / (F.col("w") * F.col("l")), F.lit(1.0))
    return rows.withColumns({"weff": F.col("w") * ratio, "leff": F.col("l") * ratio}).drop("area")


def with_lengths(extents: DataFrame) -> DataFrame:
    """The zones' lengths of every building."""
    h, weff, leff = F.col("h"), F.col("weff"), F.col("leff")
    return extents.withColumns({"lu": W.upwind_length(h, weff), "lfv": W.upwind_vortex_length(h, weff), "lr": W.cavity_length(h, weff, leff), "lw": W.wake_length(h, weff, leff), "hcm": W.displacement_height(h, weff)})


def roughness(extents: DataFrame, domain_area: float) -> DataFrame:
    """One row: z0, d, hr, lambda_f; the defaults where there is no building or no area."""
    sums = extents.agg(F.sum(F.col("h") * F.col("w")).alias("front"), F.sum(F.col("w") * F.col("l")).alias("plan"), F.sum(F.col("w") * F.col("l") * F.ln(W.at_least(F.col("h"), 0.1))).alias("logs"))
    known = (F.lit(domain_area) > 0) & (F.col("plan") > 0)
    sums = sums.select(F.when(known, F.least(F.col("front") / domain_area, F.lit(2.0))).otherwise(0.1).alias("lambda_f"), F.when(known, F.exp(F.col("logs") / F.col("plan"))).otherwise(10.0).alias("hr"), known.alias("known"))
    d, z0 = W.hanna_britter(F.col("lambda_f"), F.col("hr"))
    return sums.select(F.when(F.coalesce("known", F.lit(False)), z0).otherwise(W.Z0_DEFAULT).alias("z0"), F.when(F.coalesce("known", F.lit(False)), d).otherwise(0.0).alias("d"), "hr", "lambda_f")
