"""GeoTIFF rasters without compression: long cells in, long cells out."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import Grid

_TYPES = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 5: "u8", 6: "i1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 16: "u8"}


def encode(bands: list[np.ndarray], grid: Grid, nodata: float | None = None) -> bytes:
    """Bands (rows x columns of one type) as a striped little-endian file, a strip a row, with its place on the ground."""
    cube = np.stack(bands, axis=-1)
    cube = np.ascontiguousarray(cube.astype(cube.dtype.newbyteorder("<")))
    h, w, n = cube.shape
    row = w * n * cube.itemsize
    fmt = 3 if cube.dtype.kind == "f" else 2 if cube.dtype.kind == "i" else 1
    tags: list[tuple[int, int, bytes, int]] = []

    def tag(code: int, kind: int, *values) -> None:
        tags.append((code, kind, np.array(values, "<" + _TYPES[kind]).tobytes(), len(values)))

    tag(256, 4, w), tag(257, 4, h), tag(258, 3, *[8 * cube.itemsize] * n), tag(259, 3, 1), tag(262, 3, 1)
    tags.append((273, 4, b"", h))
    tag(277, 3, n), tag(278, 4, 1), tag(279, 4, *[row] * h), tag(284, 3, 1), tag(339, 3, *[fmt] * n)
    tag(33550, 12, grid.res, grid.res, 0.0), tag(33922, 12, 0.0, 0.0, 0.0, grid.x_min, grid.y_max, 0.0)
    if nodata is not None:
        text = f"{nodata:g}\0".encode()
        tags.append((42113, 2, text, len(text)))
    at = 8 + 2 + 12 * len(tags) + 4
    data_at = at + sum(len(v) + len(v) % 2 for _, _, v, _ in tags if len(v) > 4) + (4 * h if h > 1 else 0)
    entries, extra = b"", b""
    for code, kind, value, count in tags:
        if code == 273:
            value = (data_at + row * np.arange(h)).astype("<u4").tobytes()
        if len(value) <= 4:
            entries += struct.pack("<HHI", code, kind, count) + value.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", code, kind, count, at + len(extra))
            extra += value + b"\0" * (len(value) % 2)
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra + cube.tobytes()


def decode(data: bytes) -> tuple[np.ndarray, tuple[float, ...], float | None]:
    """(rows x columns x bands, transform, nodata)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, = struct.unpack_from(order + "I", data, 4)
    found: dict[int, np.ndarray] = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        code, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        kind_np = np.dtype(order + _TYPES.get(kind, "u1"))
        where = at + 10 + 12 * i if kind_np.itemsize * count <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        found[code] = np.frombuffer(data, kind_np, count, where)
    if int(found.get(259, [1])[0]) != 1:
        raise ValueError("compressed rasters aren't supported")
    w, h, n = int(found[256][0]), int(found[257][0]), int(found.get(277, [1])[0])
    sample = np.dtype(order + {1: "u", 2: "i", 3: "f"}[int(found.get(339, [1])[0])] + str(int(found[258][0]) // 8))
    raw = b"".join(data[o : o + s] for o, s in zip(found[273].tolist(), found[279].tolist(), strict=True))
    scale, tie = found.get(33550, np.array([1.0, 1.0])), found.get(33922, np.zeros(6))
    nodata = float(found[42113].tobytes().split(b"\0")[0]) if 42113 in found else None
    return np.frombuffer(raw, sample).reshape(h, w, n), (float(tie[3]), float(scale[0]), 0.0, float(tie[4]), 0.0, -float(scale[1])), nodata


def read_geotiff(spark: SparkSession, *paths: str) -> DataFrame:
    """url, row, col, x, y (corners), bands (array of double, null for nodata) of all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cube, t, nodata = decode(content)
                for r in range(len(cube)):
                    line = cube[r].astype(float)
                    bands = [[None if x != x or x == nodata else x for x in px] for px in line.tolist()]
                    n = len(line)
                    col = np.arange(n)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([r] * n, pa.int32()), pa.array(col.astype(np.int32)), pa.array(t[0] + col * t[1]), pa.array([t[3] + r * t[5]] * n), pa.array(bands, pa.list_(pa.float64()))], ["url", "row", "col", "x", "y", "bands"])

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInArrow(run, "url string, row int, col int, x double, y double, bands array<double>")


def write_geotiff(cells: DataFrame, grid: Grid, *bands: str, nodata: float = -9999.0) -> bytes:
    """A dense file of long cells; a raster of one file is what this is for, Parquet otherwise."""
    out = [np.full((grid.height, grid.width), nodata) for _ in bands]
    for r in cells.select("row", "col", *bands).toLocalIterator(prefetchPartitions=True):
        for band, name in zip(out, bands, strict=True):
            band[r["row"], r["col"]] = nodata if r[name] is None else r[name]
    return encode(out, grid, nodata)


def write_tiles(cells: DataFrame, grid: Grid, folder: str, pixels: int, *bands: str, nodata: float = -9999.0) -> DataFrame:
    """(tx, ty, path, size) of GeoTIFF tiles of ``pixels`` cells a side, written by the tasks themselves; tiles count from the lower left corner.

    A tile without cells isn't written. ``folder`` is in a store that Arrow writes to and all executors share; a file gets its
    name when it is whole, so a task that runs again does no harm. Lazy: the tiles are written when the result is.
    """
    low = grid.y_max - grid.height * grid.res
    up = F.lit(grid.height - 1) - F.col("row")
    rows = cells.select("row", "col", *bands, F.floor(F.col("col") / pixels).alias("tx"), F.floor(up / pixels).alias("ty"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
        width, height = min(pixels, grid.width - tx * pixels), min(pixels, grid.height - ty * pixels)
        top = grid.height - ty * pixels - height
        out = [np.full((height, width), nodata) for _ in bands]
        for band, name in zip(out, bands, strict=True):
            v = pdf[name].to_numpy(float, na_value=np.nan)
            band[pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - tx * pixels] = np.where(np.isnan(v), nodata, v)
        data = encode(out, Grid(grid.x_min + tx * pixels * grid.res, low + (ty * pixels + height) * grid.res, grid.res, width, height), nodata)
        store, base = fs.FileSystem.from_uri(folder) if re.match(r"\w+:", folder) else (fs.LocalFileSystem(), folder)
        store.create_dir(base)
        path, part = f"{base}/{tx}_{ty}.tif", f"{base}/.{tx}_{ty}-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(data)
        store.move(part, path)
        return pd.DataFrame({"tx": [tx], "ty": [ty], "path": [path], "size": [len(data)]})

    return rows.groupBy("tx", "ty").applyInPandas(tile, "tx long, ty long, path string, size long")
