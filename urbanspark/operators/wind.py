"""The wind field over pixels and buildings.

Only buildings whose zones can reach a pixel are paired with it: a building is filed under the cells of a coarse
grid that its zones' circle covers, pixels under their own cell, and the pairs are an equi-join on the cell. What a
building without a hit contributes (1, or the profile above its roof) depends on its height alone, so its part of
the minimum is taken from one aggregate of heights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Grid
from ..functions import wind as W
from .buildings import with_lengths


def near_pairs(pixels: DataFrame, extents: DataFrame, direction: float, cell: float = 64.0) -> DataFrame:
    """Pixels (row, col, x, y, z) with each building that may reach them, and along, cross, zone."""
    b = with_lengths(extents)
    reach = F.greatest(F.col("lu"), F.col("lw")) + F.sqrt(F.col("l") * F.col("l") + F.col("w") * F.col("w")) / 2
    b = b.select(F.struct("id", "cx", "cy", "h", "w", "l", "weff", "leff", "lu", "lfv", "lr", "lw").alias("b"), reach.alias("reach"))
    span = lambda c: F.sequence(F.floor((F.col(f"b.{c}") - F.col("reach")) / cell), F.floor((F.col(f"b.{c}") + F.col("reach")) / cell))
    filed = b.withColumn("kx", F.explode(span("cx"))).withColumn("ky", F.explode(span("cy")))
    keyed = pixels.withColumns({"kx": F.floor(F.col("x") / cell), "ky": F.floor(F.col("y") / cell)})
    pairs = keyed.join(filed, ["kx", "ky"])
    along, cross = W.to_wind_frame(F.col("x") - F.col("b.cx"), F.col("y") - F.col("b.cy"), direction)
    pairs = pairs.withColumns({"along": along, "cross": cross})
    return pairs.withColumn("zone", W.zone_code(F.col("along"), F.col("cross"), F.col("b")))


def with_factors(pairs: DataFrame, profile: W.Profile) -> DataFrame:
    """Pairs inside a zone, with the factor there."""
    return pairs.where(F.col("zone") != W.FREE).withColumn("factor", W.zone_factor(F.col("zone"), F.col("along"), F.col("z"), F.col("b"), profile))


def zone_raster(pixels: DataFrame, extents: DataFrame, direction: float, profile: W.Profile) -> DataFrame:
    """row, col, zone: of the hit with the least factor (ties: the first building); 0 without a hit."""
    hits = with_factors(near_pairs(pixels, extents, direction), profile)
    best = hits.groupBy("row", "col").agg(F.min_by("zone", F.struct("factor", "b.id")).alias("zone"))
    return pixels.select("row", "col").join(best, ["row", "col"], "left").withColumn("zone", F.coalesce("zone", F.lit(0)).cast("int"))


def wind_field_2d(pixels: DataFrame, extents: DataFrame, direction: float, profile: W.Profile, u_ref: float = 1.0, vegetation: Column | None = None) -> DataFrame:
    """row, col, speed, direction.

    A pixel in some zone has the least factor of all buildings, at least 0; those that it isn't in a zone of count
    too, with 1 or the profile over a lower roof. A pixel in none, or whose least factor is over 1, has the
    profile's speed.
    """
    hits = with_factors(near_pairs(pixels, extents, direction), profile)
    z, here = F.col("z"), profile.ratio(F.col("z"))
    under = F.col("b.h") < z
    least = hits.groupBy("row", "col").agg(F.min("factor").alias("hit"), F.count("*").alias("hits"), F.count_if(under).alias("hits_under"))
    most = least.agg(F.max("hits")).first()[0] or 0
    # Whether some building out of reach is lower than the pixel, or not lower: of all buildings, as many of the
    # lowest and of the highest as a pixel has hits, and one more, settle that.
    lows = extents.select("h").orderBy("h").limit(most + 1).agg(F.collect_list("h").alias("lows"))
    highs = extents.select("h").orderBy(F.desc("h")).limit(most + 1).agg(F.collect_list("h").alias("highs"))
    rows = pixels.join(least, ["row", "col"], "left").crossJoin(F.broadcast(lows)).crossJoin(F.broadcast(highs))
    free_under = F.size(F.filter("lows", lambda h: h < z)) > F.col("hits_under")
    free_over = F.size(F.filter("highs", lambda h: h >= z)) > F.col("hits") - F.col("hits_under")
    free = F.least(F.when(free_under, here), F.when(free_over, F.lit(1.0)))
    factor = F.least(F.col("hit"), free)
    calm = profile.ratio(W.at_least(z, 0.1))
    speed = F.when(F.col("hits").isNull() | (factor > 1.0), calm).otherwise(W.at_least(factor, 0.0)) * u_ref
    return rows.select("row", "col", (speed if vegetation is None else speed * vegetation).alias("speed"), F.lit(float(direction)).alias("direction"))


def in_wake(points: DataFrame, extents: DataFrame, direction: float) -> DataFrame:
    """Points (row, col, x, y, z) that lie in some building's cavity or wake."""
    hit = near_pairs(points, extents, direction).where(F.col("zone").isin(W.CAVITY, W.WAKE)).select("row", "col").distinct()
    return points.join(hit, ["row", "col"], "left_semi")


def pixel_heights(dsm: DataFrame, dem: DataFrame, grid: Grid) -> DataFrame:
    """row, col, x, y (the pixels' corners), z: surface over ground, at least 0."""
    rows = dsm.select("row", "col", "dsm").join(dem.select("row", "col", "dem"), ["row", "col"])
    return rows.select("row", "col", grid.x_of(F.col("col")).alias("x"), grid.y_of(F.col("row")).alias("y"), W.at_least(F.col("dsm") - F.col("dem"), 0.0).alias("z"))
