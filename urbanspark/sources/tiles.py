"""Layers read in tiles: a Python data source that plans its partitions from a box and pushes rectangles into the reader.

A box is cut into square tiles; each is one request of a map service, or one file of a tiled folder. Conditions on a
feature's envelope (or a cell's centre) narrow the box before the partitions are planned, so tiles beside the
rectangle are never opened. A feature that several tiles report belongs to the one with the lower left corner of what
its envelope and the box share. An answer as long as the service's limit may be cut off: that tile is asked again in
four parts.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..core import BBox
from . import requests
from .fetch import fetch

FORMAT = "urban_tiles"
FEATURES = "id string, properties string, kind string, coordinates string, min_x double, min_y double, max_x double, max_y double, tx long, ty long"
CELLS = "row long, col long, x double, y double, bands array<double>, tx long, ty long"
#: Parts of a part of a tile, at most.
DEPTH = 12
#: Tiles a plan may have; a box with more wants larger tiles.
MOST = 1_000_000


@dataclass
class Tiles(InputPartition):
    at: list[tuple[int, int]]


def _numbers(coordinates) -> Iterator[tuple[float, float]]:
    if coordinates and isinstance(coordinates[0], (int, float)):
        yield coordinates[0], coordinates[1]
    else:
        for c in coordinates or []:
            yield from _numbers(c)


def parsed(data: bytes) -> list[dict]:
    """Features of a collection, a lone one, or one a line (the files of a folder)."""
    text = data.decode("utf-8").strip()
    if not text:
        return []
    try:
        documents = [json.loads(text)]
    except json.JSONDecodeError:
        documents = [json.loads(line) for line in text.splitlines() if line.strip()]
    return [f for d in documents for f in (d.get("features") or [] if d.get("type") == "FeatureCollection" else [d])]


class TileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        get = options.get
        self.url, self.kind, self.tile = options["url"], get("kind", "features"), float(options["tile"])
        self.box = tuple(float(v) for v in options["bbox"].split(","))
        self.wanted = list(self.box)
        self.limit, self.res = int(get("limit", requests.WFS_CAP)), float(get("res", 1.0))
        self.each, self.tries, self.wait = int(get("tilesperpartition", 1)), int(get("tries", 3)), float(get("wait", 0.5))
        if not self.tile > 0 or not BBox(*self.box).validated():
            raise ValueError("tile has to be above 0")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Lower bounds of max_x or upper ones of min_x narrow the box (of cells: bounds of x); Spark checks all rows again."""
        low = {"x": 0, "y": 1} if self.kind == "raster" else {"max_x": 0, "max_y": 1}
        high = {"x": 2, "y": 3} if self.kind == "raster" else {"min_x": 2, "min_y": 3}
        for f in filters:
            name, value = (f.attribute[0] if len(f.attribute) == 1 else "", getattr(f, "value", None)) if hasattr(f, "attribute") else ("", None)
            if isinstance(value, (int, float)) and not isinstance(value, bool) and not math.isnan(value):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)) and name in low:
                    self.wanted[low[name]] = max(self.wanted[low[name]], float(value))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)) and name in high:
                    self.wanted[high[name]] = min(self.wanted[high[name]], float(value))
            yield f

    def partitions(self) -> list[InputPartition]:
        x0, y0, x1, y1 = self.wanted
        if x0 > x1 or y0 > y1:
            return [Tiles([])]
        first, last = (self._tile(x0, y0), self._tile(x1, y1))
        if (last[0] - first[0] + 1) * (last[1] - first[1] + 1) > MOST:
            raise ValueError(f"more than {MOST} tiles; make them larger or the box smaller")
        every = [(tx, ty) for ty in range(first[1], last[1] + 1) for tx in range(first[0], last[0] + 1)]
        return [Tiles(every[i : i + self.each]) for i in range(0, len(every), self.each)]

    def _tile(self, x: float, y: float) -> tuple[int, int]:
        """The tile of a point in the box; the last one's far side belongs to it."""
        last = [max(1, math.ceil((b - a) / self.tile)) - 1 for a, b in ((self.box[0], self.box[2]), (self.box[1], self.box[3]))]
        return tuple(min(max(math.floor((v - o) / self.tile), 0), n) for v, o, n in zip((x, y), self.box[:2], last, strict=True))

    def _bounds(self, tx: int, ty: int) -> tuple[float, float, float, float]:
        side = lambda i, k: min(self.box[i] + k * self.tile, self.box[i + 2])
        return side(0, tx), side(1, ty), side(0, tx + 1), side(1, ty + 1)

    def _bytes(self, tx: int, ty: int, b: tuple[float, float, float, float]) -> bytes | None:
        width, height = (max(1, round((b[i + 2] - b[i]) / self.res)) for i in (0, 1))
        names = dict(zip(("min_x", "min_y", "max_x", "max_y"), map(requests.plain_number, b), strict=True)) | {"tx": str(tx), "ty": str(ty), "width": str(width), "height": str(height)}
        url = self.url
        for name, value in names.items():
            url = url.replace("{" + name + "}", value)
        return fetch(url, self.tries, self.wait)

    def _features(self, tx: int, ty: int, b: tuple[float, float, float, float], depth: int = 0) -> Iterator[tuple]:
        data = self._bytes(tx, ty, b)
        found = parsed(data) if data else []
        service = "{min_x}" in self.url
        if service and len(found) >= self.limit:
            if depth == DEPTH:
                raise ValueError(f"over {self.limit} features in a part of {b}")
            mx, my = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
            for part in ((b[0], b[1], mx, my), (mx, b[1], b[2], my), (b[0], my, mx, b[3]), (mx, my, b[2], b[3])):
                yield from self._features(tx, ty, part, depth + 1)
            return
        x0, y0, x1, y1 = self.wanted
        for f in found:
            shape = f.get("geometry") or {}
            points = np.array(list(_numbers(shape.get("coordinates"))), float).reshape(-1, 2)
            if not len(points):
                continue  # nowhere
            (ax, ay), (bx, by) = points.min(0).tolist(), points.max(0).tolist()
            if ax > x1 or bx < x0 or ay > y1 or by < y0:
                continue
            px, py = max(ax, x0), max(ay, y0)
            # Half open, but the box's far sides belong to the last tile.
            mine = b[0] <= px and (px < b[2] or px <= b[2] == self.box[2]) and b[1] <= py and (py < b[3] or py <= b[3] == self.box[3])
            if mine:
                name = f.get("id")
                yield None if name is None else str(name), json.dumps(f.get("properties")), shape.get("type"), json.dumps(shape.get("coordinates")), ax, ay, bx, by, tx, ty

    def _cells(self, tx: int, ty: int, b: tuple[float, float, float, float]) -> Iterator[pa.RecordBatch]:
        from .geotiff import decode

        data = self._bytes(tx, ty, b)
        if not data:
            return
        cube, t, nodata = decode(data)
        x, y = t[0] + (np.arange(cube.shape[1]) + 0.5) * t[1], t[3] + (np.arange(cube.shape[0]) + 0.5) * t[5]
        inside = lambda v, lo, hi, end: (v >= lo) & ((v < hi) | (v <= hi) & (hi == end))
        cols, rows = np.flatnonzero(inside(x, b[0], b[2], self.box[2])), np.flatnonzero(inside(y, b[1], b[3], self.box[3]))
        col, top = np.floor((x[cols] - self.box[0]) / abs(t[1])).astype(np.int64), np.floor((self.box[3] - y) / abs(t[5])).astype(np.int64)
        for r in rows.tolist():
            line, n = cube[r, cols].astype(float), len(cols)
            flat = line.ravel()
            bands = pa.ListArray.from_arrays(np.arange(0, (n + 1) * line.shape[1], line.shape[1], dtype=np.int32), pa.array(flat, pa.float64(), mask=np.isnan(flat) | (flat == nodata)))
            yield pa.RecordBatch.from_arrays([pa.array([top[r]] * n, pa.int64()), pa.array(col), pa.array(x[cols]), pa.array([y[r]] * n), bands, pa.array([tx] * n, pa.int64()), pa.array([ty] * n, pa.int64())], ["row", "col", "x", "y", "bands", "tx", "ty"])

    def read(self, partition: Tiles) -> Iterator:
        for tx, ty in partition.at:
            b = self._bounds(tx, ty)
            yield from self._cells(tx, ty, b) if self.kind == "raster" else self._features(tx, ty, b)


class TileSource(DataSource):
    """Options: url (with {min_x} ... {max_y}, {width}, {height} of a service, or {tx}, {ty} of a folder), bbox, tile, kind (features or raster), limit, res, tilesPerPartition, tries, wait."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CELLS if self.options.get("kind") == "raster" else FEATURES

    def reader(self, schema: StructType) -> TileReader:
        return TileReader({k.lower(): v for k, v in self.options.items()})


def read_tiles(spark: SparkSession, url: str, box: BBox, tile: float, kind: str = "features", **options: object) -> DataFrame:
    """A tiled layer, lazily: features with their envelope, or cells with their centre; tiles that a service or folder hasn't are empty.

    Bounds on min_x, max_x, min_y, max_y (cells: x, y) prune tiles before they are opened; the session's pushdown into
    Python sources is switched on for that. Features without coordinates are nowhere and don't come.
    """
    spark.dataSource.register(TileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    sides = ",".join(map(repr, (float(box.min_x), float(box.min_y), float(box.max_x), float(box.max_y))))
    return spark.read.format(FORMAT).options(url=url, bbox=sides, tile=repr(float(tile)), kind=kind, **{k: str(v) for k, v in options.items()}).load()


def within(layer: DataFrame, box: BBox, kind: str = "features") -> DataFrame:
    """The part of a tiled layer that meets a box, in a form that is pushed into the reader."""
    names = ("x", "x", "y", "y") if kind == "raster" else ("max_x", "min_x", "max_y", "min_y")
    return layer.where(f"{names[0]} >= {box.min_x!r}D and {names[1]} <= {box.max_x!r}D and {names[2]} >= {box.min_y!r}D and {names[3]} <= {box.max_y!r}D")


def service_url(base: str, layer: str, limit: int = requests.WFS_CAP) -> str:
    """A feature service's address with the box left open; latitude comes first in it."""
    url = requests.wfs_url(base, layer, None, None, limit)
    return url + "&BBOX={min_y},{min_x},{max_y},{max_x},EPSG:4326"
