"""Context, boxes and grids: plain values from which plans are built."""

from __future__ import annotations

import math
import tempfile
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WGS84, LAMBERT93, CC46 = 4326, 2154, 3946


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode, where that is unset, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="urbanspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shuffled(rows: DataFrame) -> DataFrame:
    """One side of a join that is never to be broadcast: Spark takes a table for small by its files' bytes, which rings, copies and keys made of their columns exceed many times, also behind a checkpoint."""
    return rows.hint("merge")


def spread(rows: DataFrame) -> DataFrame:
    """Few bytes of a file from which much is made, dealt to all cores: Spark plans tasks by the files' bytes."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


@dataclass(frozen=True)
class BBox:
    min_x: float
    min_y: float
    max_x: float
    max_y: float

    def validated(self) -> BBox:
        if not (self.min_x < self.max_x and self.min_y < self.max_y):
            raise ValueError(f"empty box: {self}")
        return self

    def scaled(self, factor: float) -> BBox:
        """About its centre."""
        cx, cy = (self.min_x + self.max_x) / 2, (self.min_y + self.max_y) / 2
        hx, hy = (self.max_x - self.min_x) / 2 * factor, (self.max_y - self.min_y) / 2 * factor
        return BBox(cx - hx, cy - hy, cx + hx, cy + hy)


@dataclass(frozen=True)
class Context:
    """Where and how layers are computed; setters return a new context and keep the rest."""

    epsg: int = LAMBERT93
    bbox: BBox | None = None
    output: str | None = None

    def with_bbox(self, *sides: float) -> Context:
        return replace(self, bbox=BBox(*sides))

    def with_crs(self, epsg: int) -> Context:
        return replace(self, epsg=epsg)


@dataclass(frozen=True)
class Grid:
    """Square cells, rows from the north; pixel_to_geo is the cell's corner, centre is half a cell further."""

    x_min: float
    y_max: float
    res: float
    width: int
    height: int

    @staticmethod
    def over(box: BBox, res: float = 1.0) -> Grid:
        return Grid(box.min_x, box.max_y, res, math.ceil((box.max_x - box.min_x) / res), math.ceil((box.max_y - box.min_y) / res))

    @property
    def transform(self) -> tuple[float, ...]:
        return (self.x_min, self.res, 0.0, self.y_max, 0.0, -self.res)

    def col_of(self, x: Column) -> Column:
        return F.floor((x - self.x_min) / self.res)

    def row_of(self, y: Column) -> Column:
        return F.floor((self.y_max - y) / self.res)

    def x_of(self, col: Column, shift: float = 0.0) -> Column:
        return F.lit(self.x_min) + (col + F.lit(shift)) * self.res

    def y_of(self, row: Column, shift: float = 0.0) -> Column:
        return F.lit(self.y_max) - (row + F.lit(shift)) * self.res

    def cells(self, spark: SparkSession) -> DataFrame:
        """(row, col) of every cell, generated on the executors."""
        i = F.col("id")
        return spark.range(self.width * self.height).select(F.floor(i / self.width).cast("int").alias("row"), (i % self.width).cast("int").alias("col"))


def jfa_steps(width: int, height: int) -> list[int]:
    """Jump lengths of a flood over the grid: halves of the next power of two, then one more single step."""
    n = 1
    while n < max(width, height):
        n *= 2
    steps = []
    while n > 1:
        n //= 2
        steps.append(n)
    return [*steps, 1]


def jfa_steps_of(width: Column, height: Column) -> Column:
    """The same as an array column."""
    n = F.ceil(F.log2(F.greatest(width, height, F.lit(1)).cast("double"))).cast("int")
    halves = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.pow(F.lit(2.0), n - i).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.concat(halves, F.array(F.lit(1)))
