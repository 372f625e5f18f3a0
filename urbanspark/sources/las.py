"""LAS point clouds: readers of uncompressed files, a writer, and the octree index of cloud-optimised files.

``scan_las`` is a Python data source: its partitions are ranges of points, planned from the files' heads, each read by its own
byte range; files whose head tells that they lie outside the conditions on x, y and z are never read. ``read_las`` goes through
Spark's reader, a file a task, and so reaches any store.

Compressed points (LAZ) need a codec that isn't available; their headers and octree pages can be read.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .fetch import fetch_range, listed

#: Points that a reader's partition has.
SLICE = 1_000_000


@dataclass(frozen=True)
class Header:
    version: tuple[int, int]
    offset: int
    format: int
    record: int
    points: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    #: (least, greatest) of x, y and z as the file states them.
    extent: tuple[tuple[float, float], ...] = ()
    compressed: bool = False


def parse_header(data: bytes) -> Header:
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = data[24], data[25]
    offset, = struct.unpack_from("<I", data, 96)
    fmt, record = data[104] & 0x3F, struct.unpack_from("<H", data, 105)[0]
    points, = struct.unpack_from("<Q", data, 247) if (major, minor) >= (1, 4) else struct.unpack_from("<I", data, 107)
    ends = struct.unpack_from("<6d", data, 179) if len(data) >= 227 else ()
    extent = tuple((ends[i + 1], ends[i]) for i in (0, 2, 4)) if ends else ()
    return Header((major, minor), offset, fmt, record, points, struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155), extent, bool(data[104] & 0x80))


def decode_points(data: bytes, header: Header) -> pa.RecordBatch:
    """x, y, z, classification of whole records; the class byte's place follows from the format."""
    at = 16 if header.format >= 6 else 15
    if header.record <= at or len(data) % header.record:
        raise ValueError("a point record is too short")
    kind = np.dtype({"names": ["x", "y", "z", "c"], "formats": ["<i4", "<i4", "<i4", "u1"], "offsets": [0, 4, 8, at], "itemsize": header.record})
    raw = np.frombuffer(data, kind)
    xyz = [raw[n] * s + o for n, s, o in zip("xyz", header.scale, header.shift, strict=True)]
    c = raw["c"].astype(np.int16)
    return pa.RecordBatch.from_arrays([*map(pa.array, xyz), pa.array(c if header.format >= 6 else c & 31)], ["x", "y", "z", "classification"])


def read_las(spark: SparkSession, *paths: str) -> DataFrame:
    """Points of all files, with their url. Files come through Spark's own reader, so any store works."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                h = parse_header(bytes(data[:400]))
                for a in range(0, h.points, SLICE):
                    n = min(SLICE, h.points - a)
                    part = decode_points(bytes(data[h.offset + a * h.record : h.offset + (a + n) * h.record]), h)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([path] * n)], ["x", "y", "z", "classification", "url"])

    return files.mapInArrow(run, "x double, y double, z double, classification short, url string")


FORMAT = "urban_las"
POINTS = "x double, y double, z double, classification short, url string"
#: Bytes of a file that hold its head.
HEAD = 375


@dataclass
class Range(InputPartition):
    url: str
    header: Header
    first: int
    count: int


class LasScan(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls, self.slice = json.loads(options["urls"]), int(options.get("slice", SLICE))
        self.wanted = {n: [float("-inf"), float("inf")] for n in "xyz"}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of x, y and z leave out files, and points within those that are read; Spark checks all rows again."""
        for f in filters:
            name, value = (f.attribute[0], f.value) if hasattr(f, "attribute") and hasattr(f, "value") and len(f.attribute) == 1 else ("", None)
            if name in self.wanted and isinstance(value, (int, float)) and not isinstance(value, bool) and value == value:
                own = self.wanted[name]
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    own[0] = max(own[0], float(value))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    own[1] = min(own[1], float(value))
            yield f

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(16) as pool:
            heads = list(pool.map(lambda u: parse_header(fetch_range(u, 0, HEAD)), self.urls))
        out: list[InputPartition] = []
        for url, h in zip(self.urls, heads, strict=True):
            if h.compressed:
                raise ValueError(f"{url}: compressed points can't be read")
            # Stated ends may be off by a step of the scale.
            if h.extent and any(lo > b + s or hi < a - s for (a, b), s, (lo, hi) in zip(h.extent, h.scale, self.wanted.values(), strict=True)):
                continue
            out += [Range(url, h, a, min(self.slice, h.points - a)) for a in range(0, h.points, self.slice)]
        return out or [Range("", Header((1, 4), 0, 6, 30, 0, (1.0,) * 3, (0.0,) * 3), 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        h = part.header
        for a in range(part.first, part.first + part.count, BATCH):
            n = min(BATCH, part.first + part.count - a)
            data = fetch_range(part.url, h.offset + a * h.record, n * h.record)
            if len(data) < n * h.record:
                raise ValueError(f"{part.url}: the file ends before its points do")
            got = decode_points(data, h)
            inside = np.ones(n, bool)
            for i, (lo, hi) in enumerate(self.wanted.values()):
                v = got.column(i).to_numpy()
                inside &= (v >= lo) & (v <= hi)
            kept = got.filter(pa.array(inside)) if not inside.all() else got
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([part.url] * kept.num_rows, pa.string())], ["x", "y", "z", "classification", "url"])


#: Points that are read and handed on at once.
BATCH = 1 << 16


class LasSource(DataSource):
    """Options: urls (a JSON list), slice (points of a partition)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return POINTS

    def reader(self, schema: StructType) -> LasScan:
        return LasScan({k.lower(): v for k, v in self.options.items()})


def scan_las(spark: SparkSession, *paths: str, slice: int = SLICE) -> DataFrame:
    """Points of files, folders (their .las files) and web addresses, with their url: split by ranges of points, and pruned by conditions on x, y and z.

    Heads are read when the query is planned, once a file. Compressed files are an error; a folder without files gives no rows.
    """
    spark.dataSource.register(LasSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    urls = [u for p in paths for u in listed(p, ".las")]
    return spark.read.format(FORMAT).options(urls=json.dumps(urls), slice=str(slice)).load()


def las_bytes(x: np.ndarray, y: np.ndarray, z: np.ndarray, c: np.ndarray, scale: float = 0.01) -> bytes:
    """A LAS 1.4 file of point format 6; classes that a byte can't hold become 1 (unclassified)."""
    low = [float(np.floor(v.min())) if len(v) else 0.0 for v in (x, y, z)]
    c = np.where((c < 0) | (c > 255), 1, c)
    kind = np.dtype({"names": ["x", "y", "z", "r", "c"], "formats": ["<i4", "<i4", "<i4", "u1", "u1"], "offsets": [0, 4, 8, 14, 16], "itemsize": 30})
    raw = np.zeros(len(x), kind)
    for name, v, o in zip("xyz", (x, y, z), low, strict=True):
        raw[name] = np.round((v - o) / scale)
    raw["r"], raw["c"] = 0x11, c
    head = bytearray(375)
    head[:4], head[24:26] = b"LASF", b"\x01\x04"
    struct.pack_into("<HII", head, 94, 375, 375, 0)
    head[104] = 6
    struct.pack_into("<H", head, 105, 30)
    struct.pack_into("<6d", head, 131, *[scale] * 3, *low)
    ends = [f(v) if len(v) else 0.0 for v in (x, y, z) for f in (np.max, np.min)]
    struct.pack_into("<6d", head, 179, *map(float, ends))
    struct.pack_into("<Q", head, 247, len(x))
    return bytes(head) + raw.tobytes()


#: Points of a file that a task writes, about.
FILE_POINTS = 500_000


def write_las(points: DataFrame, most: int = FILE_POINTS) -> DataFrame:
    """(part, content): each partition as bytes of LAS files of about ``most`` points, for a binary sink; a task holds one file. Parts are numbers of their own, the first of a partition its number."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, files = [], 0, 0

        def file() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            part = t["part"][0].as_py() + (files << 32)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([las_bytes(*(t[c].to_numpy() for c in ("x", "y", "z", "classification")))], pa.binary())], ["part", "content"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield file()
                held, rows, files = [], 0, files + 1
        if rows:
            yield file()

    return points.select("x", "y", "z", "classification", F.spark_partition_id().alias("part")).mapInArrow(run, "part long, content binary")


@dataclass(frozen=True)
class CopcInfo:
    center: tuple[float, float, float]
    halfsize: float
    spacing: float
    root_offset: int
    root_size: int

    def bounds(self, level: int, vx: int, vy: int) -> tuple[float, float, float, float]:
        side = 2 * self.halfsize / 2**level
        x, y = self.center[0] - self.halfsize + vx * side, self.center[1] - self.halfsize + vy * side
        return x, y, x + side, y + side


def parse_copc_info(data: bytes) -> CopcInfo:
    x, y, z, half, spacing, offset, size = struct.unpack_from("<5d2Q", data)
    return CopcInfo((x, y, z), half, spacing, offset, size)


def parse_page(data: bytes) -> list[tuple[int, int, int, int, int, int, int]]:
    """Entries (level, x, y, z, offset, byte size, points) of an octree page; points -1: a child page."""
    return [struct.unpack_from("<4iQ2i", data, at) for at in range(0, len(data) - 31, 32)]


def walk_pages(file: bytes, info: CopcInfo) -> list[tuple[int, int, int, int, int, int, int]]:
    """All entries with points; pages out of the file's range are skipped."""
    todo, out = [(info.root_offset, info.root_size)], []
    while todo:
        at, size = todo.pop()
        if at + size > len(file) or size <= 0:
            continue
        for e in parse_page(file[at : at + size]):
            if e[6] == -1:
                todo.append((e[4], e[5]))
            elif e[6] > 0:
                out.append(e)
    return out
