"""Point clouds to rasters. Points are (x, y, z, classification); cells are (row, col, ...), empty cells are null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import BBox, Grid

GROUND = 2


def bbox_filter(points: DataFrame, box: BBox) -> DataFrame:
    """Closed on all sides; both ranges reach the scan."""
    return points.where(F.col("x").between(box.min_x, box.max_x) & F.col("y").between(box.min_y, box.max_y))


def class_filter(points: DataFrame, classes: list[int] | None) -> DataFrame:
    """None keeps all classes, an empty list none."""
    if classes is None:
        return points
    return points.where(F.col("classification").isin(classes) if classes else F.lit(False))


def to_cells(points: DataFrame, grid: Grid) -> DataFrame:
    """row and col added, half-open; points off the grid or without a number go. NaN has to be told apart first: it sorts above all."""
    rows = points.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z")))
    rows = rows.withColumns({"row": grid.row_of(F.col("y")).cast("int"), "col": grid.col_of(F.col("x")).cast("int")})
    return rows.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))


def max_z(points: DataFrame, grid: Grid, ground: int = GROUND) -> DataFrame:
    """row, col, dsm (highest point), dtm (highest ground point)."""
    return to_cells(points, grid).groupBy("row", "col").agg(F.max("z").alias("dsm"), F.max(F.when(F.col("classification") == ground, F.col("z"))).alias("dtm"))


def on_whole_grid(cells: DataFrame, grid: Grid) -> DataFrame:
    return grid.cells(cells.sparkSession).join(cells, ["row", "col"], "left")


def fill_3x3(cells: DataFrame, grid: Grid) -> DataFrame:
    """Empty dtm cells get the least of the neighbours as they were before, 0 without any. Each cell offers its value to nine; one aggregate collects."""
    near = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j))))"))
    offered = cells.where("dtm is not null").select("row", "col", "dtm", near.alias("o")).select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), "dtm")
    least = offered.groupBy("row", "col").agg(F.min("dtm").alias("near"))
    whole = on_whole_grid(cells, grid).join(least, ["row", "col"], "left")
    return whole.withColumn("dtm", F.coalesce("dtm", "near", F.lit(0.0))).drop("near")


def nearest_in_row(col: list[int], away: list[int], index: list[int], width: int) -> list[int]:
    """For each column of a row the number of the nearest cell, of those ``away`` rows in ascending columns; of equally near ones that with the least index.

    The lower envelope of their distances' parabolas, in whole numbers: each is put on it and taken off it once.
    """
    keep: list[int] = []
    ends: list[tuple[int, int]] = []  # where each begins to be nearer than the one before, as a fraction
    for q in range(len(col)):
        own = away[q] ** 2 + col[q] ** 2
        while keep:
            v = keep[-1]
            at = own - away[v] ** 2 - col[v] ** 2, 2 * (col[q] - col[v])
            # One that is nearest at a single place stays: it may have the least index there.
            if len(keep) > 1 and at[0] * ends[-1][1] < ends[-1][0] * at[1]:
                keep.pop()
                ends.pop()
            else:
                ends.append(at)
                break
        keep.append(q)
        if len(keep) == 1:
            ends = []
    out, k = [], 0
    for x in range(width):
        while k < len(ends) and x * ends[k][1] > ends[k][0]:
            k += 1
        best, j = keep[k], k
        while j < len(ends) and x * ends[j][1] == ends[j][0]:
            j += 1
            best = min(best, keep[j], key=index.__getitem__)
        out.append(best)
    return out


def fill_nearest(cells: DataFrame, grid: Grid) -> DataFrame:
    """Empty dtm cells get the nearest filled cell's value (Euclidean, ties to the smaller index), 0 if none is filled.

    Exact and separable: a column's nearest filled rows come from the column alone, a row's answer from its
    columns' answers. Each step works on one column or row at a time, so a task holds a line of the grid.
    """
    w, h = grid.width, grid.height

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["row"].to_numpy())
        z = pdf.set_index("row")["dtm"]
        rows = np.arange(h)
        k = np.searchsorted(at, rows, side="right")
        up, down = at[np.maximum(k - 1, 0)], at[np.minimum(k, len(at) - 1)]
        source = np.where((k == len(at)) | ((k > 0) & (rows - up <= down - rows)), up, down)
        return pd.DataFrame({"row": rows.astype(np.int32), "col": np.int32(pdf["col"].iloc[0]), "source": source.astype(np.int32), "z": z.loc[source].to_numpy()})

    def rows_(pdf: pd.DataFrame) -> pd.DataFrame:
        row = int(pdf["row"].iloc[0])
        pdf = pdf.sort_values("col")
        c, s, z = pdf["col"].tolist(), pdf["source"].tolist(), pdf["z"].to_numpy()
        near = nearest_in_row(c, [abs(v - row) for v in s], [v * w + u for u, v in zip(c, s, strict=True)], w)
        return pd.DataFrame({"row": np.int32(row), "col": np.arange(w, dtype=np.int32), "near": z[near]})

    ground = cells.where("dtm is not null").select("row", "col", "dtm")
    by_column = ground.groupBy("col").applyInPandas(columns, "row int, col int, source int, z double")
    by_row = by_column.groupBy("row").applyInPandas(rows_, "row int, col int, near double")
    whole = on_whole_grid(cells, grid).join(by_row, ["row", "col"], "left")
    return whole.withColumn("dtm", F.coalesce("dtm", "near", F.lit(0.0))).drop("near")


def chm(cells: DataFrame) -> DataFrame:
    """Canopy height; 0 where nothing was seen from above."""
    return cells.withColumn("chm", F.when(F.col("dsm").isNull(), 0.0).otherwise(F.greatest(F.col("dsm") - F.col("dtm"), F.lit(0.0))))


def rasters(points: DataFrame, box: BBox, classes: list[int] | None = None, res: float = 1.0, fill: str = "neighbor3x3") -> DataFrame:
    """row, col, dsm, dtm, chm of every cell: one lazy plan from points to canopy."""
    if fill not in ("neighbor3x3", "nearest"):
        raise ValueError(f"unknown fill {fill!r}")
    grid = Grid.over(box, res)
    cells = max_z(class_filter(bbox_filter(points, box), classes), grid)
    return chm((fill_3x3 if fill == "neighbor3x3" else fill_nearest)(cells, grid))


def grid_stats(points: DataFrame, cell: float) -> DataFrame:
    """One row: cells, points, avg_per_cell, max_per_cell of a spatial grid."""
    per = points.groupBy(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("cells"), F.sum("n").alias("points"), F.avg("n").alias("avg_per_cell"), F.max("n").alias("max_per_cell"))


def extents(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))])


def tile_coverage(points: DataFrame, tiles: DataFrame, strict: bool = True) -> DataFrame:
    """url, n for every listed tile; with ``strict`` an error if under half the tiles have points and some have none."""
    per = tiles.select("url").join(points.groupBy("url").agg(F.count("*").alias("n")), "url", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if not strict:
        return per
    total = per.agg(F.count("*").alias("tiles"), F.count_if(F.col("n") > 0).alias("loaded"))
    bad = (F.col("loaded") < F.ceil(F.col("tiles") / 2)) & (F.col("loaded") < F.col("tiles"))
    return per.crossJoin(F.broadcast(total)).where(F.when(bad, F.raise_error(F.lit("too few tiles were loaded")).cast("boolean")).otherwise(True)).select("url", "n")


def octree_bounds(nodes: DataFrame, cx: float, cy: float, half: float) -> DataFrame:
    """min/max of octree nodes (level, vx, vy)."""
    side = F.lit(2 * half) / F.pow(F.lit(2.0), F.col("level"))
    x, y = F.lit(cx - half) + F.col("vx") * side, F.lit(cy - half) + F.col("vy") * side
    return nodes.withColumns({"min_x": x, "min_y": y, "max_x": x + side, "max_y": y + side})


def overlapping(nodes: DataFrame, box: BBox) -> DataFrame:
    """Closed overlap of boxes."""
    return nodes.where((F.col("min_x") <= box.max_x) & (F.col("max_x") >= box.min_x) & (F.col("min_y") <= box.max_y) & (F.col("max_y") >= box.min_y))
