"""Trees from a canopy model: local maxima, crowns by a marker flood, tree points."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Grid, shuffled
from ..functions import geometry as G
from .polygons import in_any
from .spatialjoin import thin


def cleaned(canopy: DataFrame) -> DataFrame:
    """Cells (row, col, chm); what isn't a finite number is 0."""
    bad = F.col("chm").isNull() | F.isnan("chm") | (F.abs(F.col("chm")) == float("inf"))
    return canopy.withColumn("chm", F.when(bad, 0.0).otherwise(F.col("chm")))


def tops(canopy: DataFrame, min_height: float = 2.0, distance: int = 5) -> DataFrame:
    """Cells that are the highest within ``distance`` rows and columns (ties: the first by index).

    The greatest of a window is the greatest of its columns' greatest, so a cell offers its height along its row first, and what is
    best there goes along the columns.
    """
    tall = cleaned(canopy).where(F.col("chm") >= min_height).select("row", "col", "chm")
    span = F.sequence(F.lit(-distance), F.lit(distance))
    rank = F.struct(F.col("chm"), -F.col("row"), -F.col("col"))
    along = tall.withColumn("best", rank).withColumn("j", F.explode(span))
    along = along.select("row", (F.col("col") + F.col("j")).alias("col"), "best").groupBy("row", "col").agg(F.max("best").alias("best"))
    down = along.withColumn("i", F.explode(span)).select((F.col("row") + F.col("i")).alias("row"), "col", "best").groupBy("row", "col").agg(F.max("best").alias("best"))
    return tall.join(shuffled(down), ["row", "col"]).where(F.col("best") == rank).select("row", "col", "chm")


def _flood(chm: np.ndarray, markers: list[tuple[int, int]], least: float) -> np.ndarray:
    """Each cell of the mask goes to the marker that reaches it over the highest way."""
    label = np.zeros(chm.shape, np.int32)
    heap = []
    for n, (r, c) in enumerate(markers, 1):
        label[r, c] = n
        heapq.heappush(heap, (-chm[r, c], n, r, c))
    while heap:
        _, n, r, c = heapq.heappop(heap)
        for rr, cc in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= rr < chm.shape[0] and 0 <= cc < chm.shape[1] and not label[rr, cc] and chm[rr, cc] >= least:
                label[rr, cc] = n
                heapq.heappush(heap, (-chm[rr, cc], n, rr, cc))
    return label


def crowns(canopy: DataFrame, grid: Grid, min_height: float = 2.0, distance: int = 5, lai: float = 4.0, tile: int = 512, halo: int = 32) -> DataFrame:
    """H, D, LAI, x, y of each tree: height and diameter of its crown, at its top's pixel centre.

    The flood is sequential, so it runs per tile with a halo wider than a crown; a tree belongs to the tile of its top.
    """
    peaks = tops(canopy, min_height, distance).withColumn("top", F.lit(True)).select("row", "col", "top")
    cells = cleaned(canopy).where(F.col("chm") >= min_height).join(shuffled(peaks), ["row", "col"], "left")
    reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    cells = cells.withColumn("ti", F.explode(reach("row"))).withColumn("tj", F.explode(reach("col")))
    px = grid.res * grid.res

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        chm = np.full((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), -np.inf)
        chm[pdf["row"] - r0, pdf["col"] - c0] = pdf["chm"]
        marks = pdf[pdf["top"].fillna(False).astype(bool)].sort_values(["chm", "row", "col"], ascending=[False, True, True])
        label = _flood(chm, [(r - r0, c - c0) for r, c in zip(marks["row"], marks["col"], strict=True)], min_height)
        rows = []
        for n, (r, c) in enumerate(zip(marks["row"], marks["col"], strict=True), 1):
            if r // tile == ti and c // tile == tj:
                own = label == n
                area = float(own.sum()) * px
                if area > 0:
                    rows.append((float(chm[own].max()), 2 * math.sqrt(area / math.pi), lai, grid.x_min + (c + 0.5) * grid.res, grid.y_max - (r + 0.5) * grid.res))
        return pd.DataFrame(rows, columns=["H", "D", "LAI", "x", "y"], dtype=float)

    return cells.groupBy("ti", "tj").applyInPandas(one, "H double, D double, LAI double, x double, y double")


#: Classes of a canopy model where none are named: ground and three heights of vegetation.
CANOPY_CLASSES = (2, 3, 4, 5)


def not_taller(trees: DataFrame, most: float, height: str = "H") -> DataFrame:
    return trees.where(F.col(height) <= most)


def crown_circles(trees: DataFrame, most: float, spacing: float, mask: DataFrame | None = None) -> DataFrame:
    """Trees (id, x, y, H, D) no taller than ``most``, in the mask's shapes (ring) if there is one, thinned from the tallest down; ring is the crown's circle."""
    rows = not_taller(trees, most)
    if mask is not None:
        rows = in_any(rows, mask)
    kept = thin(rows.select("id", "x", "y", F.col("H").alias("height")), spacing)
    return rows.join(shuffled(kept.select("id")), "id", "left_semi").withColumn("ring", G.circle(F.col("x"), F.col("y"), F.col("D") / 2))
