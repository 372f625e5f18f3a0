"""Shapefiles and ASCII drawings (DXF), decoded from their bytes; files come through Spark's reader."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_FIELDS = [("id", pa.int64()), ("kind", pa.string()), ("parts", pa.list_(pa.list_(_POINT))), ("properties", pa.map_(pa.string(), pa.string()))]
SCHEMA = "id long, kind string, parts array<array<struct<x:double,y:double>>>, properties map<string,string>"


def shapes(data: bytes) -> list[tuple[str, list[list[tuple[float, float]]]]]:
    """(kind, parts) of each record: points, lines and polygons, with or without heights and measures; null shapes too."""
    if struct.unpack_from(">i", data)[0] != 9994:
        raise ValueError("not a shapefile")
    out, at = [], 100
    while at + 8 <= len(data):
        words, = struct.unpack_from(">i", data, at + 4)
        body = data[at + 8 : at + 8 + 2 * words]
        kind = struct.unpack_from("<i", body)[0] % 10
        if kind == 1:
            out.append(("Point", [[struct.unpack_from("<2d", body, 4)]]))
        elif kind in (3, 5):
            parts, n = struct.unpack_from("<2i", body, 36)
            first = [*struct.unpack_from(f"<{parts}i", body, 44), n]
            xy = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * parts)
            line = list(zip(xy[::2], xy[1::2], strict=True))
            out.append(("Polygon" if kind == 5 else "LineString", [line[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]))
        else:
            out.append(("Null", []))
        at += 8 + 2 * words
    return out


def attributes(data: bytes, encoding: str = "utf-8") -> list[dict[str, str]]:
    """Rows of a dBase table as text; deleted rows are left in their place."""
    count, head, size = struct.unpack_from("<IHH", data, 4)
    names, at = [], 32
    while data[at] != 0x0D:
        names.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32
    rows = []
    for i in range(count):
        pos, row = head + i * size + 1, {}
        for name, width in names:
            row[name] = data[pos : pos + width].decode(encoding, "replace").strip("\0 ")
            pos += width
        rows.append(row)
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def _rows(shp: bytes, dbf: bytes | None) -> list[tuple]:
    table = attributes(dbf) if dbf else []
    as_points = lambda parts: [[{"x": x, "y": y} for x, y in p] for p in parts]
    return [(i, kind, as_points(parts), list(table[i].items()) if i < len(table) else []) for i, (kind, parts) in enumerate(shapes(shp))]


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Features of shapefiles (a path or pattern that covers the .shp and .dbf files)."""
    files_ = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", r"\.(shp|dbf)$", "").alias("stem"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("ext"), "content")
    both = files_.where("ext = 'shp'").select("stem", F.col("content").alias("shp")).join(files_.where("ext = 'dbf'").select("stem", F.col("content").alias("dbf")), "stem", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shp, dbf in zip(batch.column(0), batch.column(1), strict=True):
                yield _batch(_rows(shp.as_py(), dbf.as_py()))

    return both.select("shp", "dbf").mapInArrow(run, SCHEMA)


def read_zipped_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """The same from zip files; members with unsafe names are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = {n for n in z.namelist() if not n.startswith("/") and ".." not in n.split("/")}
                    for n in sorted(n for n in names if n.lower().endswith(".shp")):
                        other = next((m for m in names if m.lower() == n[:-4].lower() + ".dbf"), None)
                        yield _batch(_rows(z.read(n), z.read(other) if other else None))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def lcz_rows(layer: DataFrame, column: str | None = None) -> DataFrame:
    """lcz_int from a named attribute, else from the first that is a whole number; 0 without one."""
    whole = F.filter(F.map_values("properties"), lambda v: v.rlike(r"^-?\d+$"))
    found = F.try_element_at("properties", F.lit(column)) if column else F.try_element_at(whole, F.lit(1))
    return layer.withColumn("lcz_int", F.coalesce(found.try_cast("int"), F.lit(0)))


def drawing(text: str) -> list[tuple[str, str, list[tuple[float, float]], float | None]]:
    """(layer, kind, points, radius) of an ASCII drawing's lines, polylines, points and circles."""
    codes = [line.strip() for line in text.splitlines()]
    pairs = [(int(a), b) for a, b in zip(codes[::2], codes[1::2], strict=False) if a.lstrip("-").isdigit()]
    out, now, inside = [], None, False
    for code, v in [*pairs, (0, "EOF")]:
        if code == 0:
            if now and now["kind"] == "VERTEX" and out and out[-1][1] == "POLYLINE":
                out[-1][2].extend(now["points"])
            elif now and now["kind"] in ("LWPOLYLINE", "POLYLINE", "LINE", "POINT", "CIRCLE"):
                points = [] if now["kind"] == "POLYLINE" else now["points"]
                if now["closed"] and points and points[0] != points[-1]:
                    points.append(points[0])
                out.append((now["layer"], now["kind"], points, now["radius"]))
            now = {"kind": v, "layer": "0", "points": [], "radius": None, "closed": False} if inside else None
        elif code == 2 and v == "ENTITIES":
            inside, now = True, None
        elif now is not None:
            if code == 8:
                now["layer"] = v
            elif code in (10, 11):
                now["points"].append((float(v), 0.0))
            elif code in (20, 21) and now["points"]:
                now["points"][-1] = (now["points"][-1][0], float(v))
            elif code == 40 and now["kind"] == "CIRCLE":
                now["radius"] = float(v)
            elif code == 70 and now["kind"] in ("LWPOLYLINE", "POLYLINE"):
                now["closed"] = bool(int(v) & 1)
    return out


def read_dxf(spark: SparkSession, path: str) -> DataFrame:
    """layer, kind, ring (points in order), radius of every entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = [(layer, kind, [{"x": x, "y": y} for x, y in points], r) for layer, kind, points, r in drawing(content.decode("utf-8", "replace"))]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.list_(_POINT), pa.float64()), strict=True)], ["layer", "kind", "ring", "radius"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "layer string, kind string, ring array<struct<x:double,y:double>>, radius double")


def layer_polygon(layer: Column, ring: Column) -> Column:
    """A tree layer's shape becomes a circle about its vertices' mean, as wide as the farthest vertex is from its box's centre; others stay."""
    about = lambda r: G.bound(F.struct(G.vertex_mean(r).alias("c"), G.circumscribed_radius(r).alias("radius")), lambda v: G.circle(v["c"]["x"], v["c"]["y"], v["radius"]))
    return G.bound(ring, lambda r: F.when(layer.contains("ENON-arbres"), about(r)).otherwise(r))


def shapefile_bytes(rings: list[list[list[tuple[float, float]]]], rows: list[dict[str, str | None]], fields: dict[str, int]) -> dict[str, bytes]:
    """The .shp, .shx and .dbf of polygons (each a list of closed rings) and their attributes as text of at most so many bytes; longer values are an error."""
    records, index, at = [], [], 100
    box = [float("inf"), float("inf"), float("-inf"), float("-inf")]
    for n, parts in enumerate(rings, 1):
        xy = [p for r in parts for p in r]
        if xy:
            xs, ys = [p[0] for p in xy], [p[1] for p in xy]
            own = (min(xs), min(ys), max(xs), max(ys))
            box = [min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3])]
            first = [sum(len(r) for r in parts[:i]) for i in range(len(parts))]
            body = struct.pack("<i4d2i", 5, *own, len(parts), len(xy)) + struct.pack(f"<{len(parts)}i", *first) + struct.pack(f"<{2 * len(xy)}d", *(v for p in xy for v in p))
        else:
            body = struct.pack("<i", 0)
        records.append(struct.pack(">2i", n, len(body) // 2) + body)
        index.append(struct.pack(">2i", at // 2, len(body) // 2))
        at += 8 + len(body)
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i", 1000, 5) + struct.pack("<8d", *(box if box[0] <= box[2] else [0.0] * 4), 0, 0, 0, 0)
    width = 1 + sum(fields.values())
    columns = b"".join(struct.pack("<11sc4xBB14x", name.encode()[:10], b"C", size, 0) for name, size in fields.items())
    lines = []
    for row in rows:
        values = [(row.get(name) or "").encode() for name in fields]
        if long := next((n for n, v in zip(fields, values, strict=True) if len(v) > fields[n]), None):
            raise ValueError(f"a value of {long} has more than {fields[long]} bytes")
        lines.append(b" " + b"".join(v.ljust(size) for v, size in zip(values, fields.values(), strict=True)))
    table = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(fields), width) + columns + b"\r" + b"".join(lines) + b"\x1a"
    return {"shp": head(at) + b"".join(records), "shx": head(100 + 8 * len(index)) + b"".join(index), "dbf": table}


#: Features of a shapefile that a task writes, about.
FILE_FEATURES = 20_000


def shapefiles(features: DataFrame, *columns: str, width: int = 64, most: int = FILE_FEATURES) -> DataFrame:
    """(name, content) of shapefiles of about ``most`` features, of which a task holds one: polygons (ring, maybe holes) with columns as text; ``files.write_files`` puts them into a folder.

    Outer rings run clockwise and holes the other way, as the format wants. A task without rows gives no files.
    """
    rows = features if "holes" in features.columns else features.withColumn("holes", F.lit(None).cast("array<array<struct<x:double,y:double>>>"))
    picked = rows.select(F.spark_partition_id().alias("__task"), "ring", "holes", *[F.col(c).cast("string").alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes_, values, task, files = [], [], 0, 0

        def file() -> pa.RecordBatch:
            made = shapefile_bytes(shapes_, values, dict.fromkeys(columns, width))
            stem = f"part-{task:05d}" + (f"-{files}" if files else "")
            return pa.RecordBatch.from_arrays([pa.array([f"{stem}.{e}" for e in made]), pa.array(list(made.values()), pa.binary())], ["name", "content"])

        for batch in batches:
            for r in batch.to_pylist():
                task = r["__task"]
                turned = [(ring, hole) for ring, hole in ((r["ring"], False), *((h, True) for h in r["holes"] or ())) if ring]
                shapes_.append([_turned([(p["x"], p["y"]) for p in ring], hole) for ring, hole in turned])
                values.append({c: r[c] for c in columns})
            if len(values) >= most:
                yield file()
                shapes_, values, files = [], [], files + 1
        if values:
            yield file()

    return picked.mapInArrow(run, "name string, content binary")


def _turned(ring: list[tuple[float, float]], left: bool) -> list[tuple[float, float]]:
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
    return ring if (area > 0) == left else ring[::-1]


def dxf_lines(features: DataFrame) -> DataFrame:
    """Drawings as text: an entity (layer, ring) is a closed polyline; a row holds its group codes, and ``dxf_document`` frames the rows of a file."""
    pairs = F.concat(
        F.lit("0\nLWPOLYLINE\n8\n"), F.col("layer"), F.lit("\n90\n"), (F.size("ring") - 1).cast("string"), F.lit("\n70\n1\n"),
        F.array_join(F.transform(F.slice("ring", F.lit(1), F.size("ring") - 1), lambda p: F.concat(F.lit("10\n"), p["x"].cast("string"), F.lit("\n20\n"), p["y"].cast("string"))), "\n"),
    )
    return features.select(pairs.alias("value"))


def dxf_document(lines: DataFrame) -> DataFrame:
    """(name, content) of a drawing a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(batches):
            if batch.num_rows:
                text = "0\nSECTION\n2\nENTITIES\n" + "\n".join(batch.column(1).to_pylist()) + "\n0\nENDSEC\n0\nEOF\n"
                yield pa.RecordBatch.from_arrays([pa.array([f"part-{batch.column(0)[0].as_py():05d}-{i}.dxf"]), pa.array([text.encode()], pa.binary())], ["name", "content"])

    return lines.select(F.spark_partition_id().alias("task"), "value").mapInArrow(run, "name string, content binary")
