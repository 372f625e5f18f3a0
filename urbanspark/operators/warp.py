"""Rasters in another projection and on another grid, clipped to a mask: target cells meet tiles of the source.

A target cell's centre is taken back to the source's system and filed under the source tile that it falls into; source cells are
filed under their tile and, along its rim, under the neighbours that a bilinear value reaches into. One shuffle on each
side brings both together; a tile is a small dense array.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import LAMBERT93, Grid
from ..functions import crs
from .polygons import in_any

#: Cells of a tile's side.
TILE = 256


def _rim(at: str, tile: int):
    """The tiles that want a cell: its own, and the one before if it is the first of its line, since centres reach half a cell back."""
    own = F.floor(F.col(at) / tile)
    return F.array_distinct(F.array(own, F.floor((F.col(at) - 1) / tile)))


def warp(source: DataFrame, source_grid: Grid, target: Grid, *bands: str, source_srid: int = LAMBERT93, target_srid: int = LAMBERT93, mask: DataFrame | None = None, method: str = "bilinear", tile: int = TILE) -> DataFrame:
    """(row, col, bands) of the target grid's cells that get a value in some band; with a mask (ring, in the target's system) only cells whose centre lies in it.

    Bilinear: the mean of the up to four source cells about the centre, by weight; cells without a value (null or NaN) don't
    count, and where none of weight has one there is none. ``method`` nearest takes the cell that holds the centre.
    A source cell listed twice is an ambiguity: the last one met counts. Empty tables give no rows.
    """
    if method not in ("bilinear", "nearest"):
        raise ValueError(f"unknown method {method!r}")
    half = 0.5 if method == "bilinear" else 0.0
    cells = target.cells(source.sparkSession).withColumns({"x": target.x_of(F.col("col"), 0.5), "y": target.y_of(F.col("row"), 0.5)})
    if mask is not None:
        cells = in_any(cells, mask, 32 * target.res)
    at = cells.withColumn("place", crs.transform_point(F.col("x"), F.col("y"), target_srid, source_srid))
    fx, fy = (F.col("place")["x"] - source_grid.x_min) / source_grid.res - half, (F.lit(source_grid.y_max) - F.col("place")["y"]) / source_grid.res - half
    there = at.select("row", "col", fx.alias("fx"), fy.alias("fy")).where(f"fx > -1 and fy > -1 and fx < {source_grid.width} and fy < {source_grid.height}")
    wanted = there.select(F.floor(F.col("fy") / tile).alias("ty"), F.floor(F.col("fx") / tile).alias("tx"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "fx", "fy")
    held = source.select("row", "col", *[F.col(b).cast("double").alias(b) for b in bands])
    held = held.withColumn("ty", F.explode(_rim("row", tile))).withColumn("tx", F.explode(_rim("col", tile)))
    kinds = ", ".join(f"`{b}` double" for b in bands)

    def sample(key: tuple, cells: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        ty, tx = key
        n = tile + 1
        fx, fy = cells["fx"].to_numpy() - tx * tile, cells["fy"].to_numpy() - ty * tile
        c, r = np.floor(fx).astype(np.int64), np.floor(fy).astype(np.int64)
        inside = (c < tile) & (r < tile) & (c >= 0) & (r >= 0)  # always, but for rounding of the tile's number
        out = {"row": cells["row"].to_numpy(), "col": cells["col"].to_numpy()}
        vr, vc = values["row"].to_numpy() - ty * tile, values["col"].to_numpy() - tx * tile
        for band in bands:
            grid = np.full((n, n), np.nan)
            grid[vr, vc] = values[band].to_numpy(float, na_value=np.nan)
            if method == "nearest":
                v = np.where(inside, grid[np.clip(r, 0, tile), np.clip(c, 0, tile)], np.nan)
            else:
                total, weight = np.zeros(len(c)), np.zeros(len(c))
                for i in (0, 1):
                    for j in (0, 1):
                        w = np.where(i, fy - r, 1 - (fy - r)) * np.where(j, fx - c, 1 - (fx - c))
                        g = grid[np.clip(r + i, 0, tile), np.clip(c + j, 0, tile)]
                        good = ~np.isnan(g) & (w > 0) & inside
                        total[good] += w[good] * g[good]
                        weight[good] += w[good]
                with np.errstate(invalid="ignore", divide="ignore"):
                    v = np.where(weight > 0, total / weight, np.nan)
            out[band] = v
        found = pd.DataFrame(out)
        return found[found[list(bands)].notna().any(axis=1)].astype({b: object for b in bands}).where(lambda d: d.notna(), None)

    return wanted.groupBy("ty", "tx").cogroup(held.groupBy("ty", "tx")).applyInPandas(sample, f"row int, col int, {kinds}")


def clip(cells: DataFrame, grid: Grid, mask: DataFrame) -> DataFrame:
    """Cells (row, col, ...) whose centre lies in a shape of the mask (ring)."""
    placed = cells.withColumns({"x": grid.x_of(F.col("col"), 0.5), "y": grid.y_of(F.col("row"), 0.5)})
    return in_any(placed, mask, 32 * grid.res).select(*cells.columns)
