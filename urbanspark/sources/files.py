"""Text sources and sinks: service catalogue, weather files, wind vectors, GeoJSON, zipped layers."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import features


def read_geojson(spark: SparkSession, *paths: str) -> DataFrame:
    """Features of whole documents: id, properties (JSON text), kind, coordinates (JSON text)."""
    return features.read_features(spark.read.text(list(paths), wholetext=True))


def read_zipped_geojson(spark: SparkSession, *paths: str) -> DataFrame:
    """Features of the GeoJSON members of zip files; members with unsafe names are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith((".geojson", ".json")) and not n.startswith("/") and ".." not in n.split("/")]
                    yield pa.RecordBatch.from_arrays([pa.array([z.read(n).decode() for n in names], pa.string())], ["value"])

    files = spark.read.format("binaryFile").load(list(paths)).select("content")
    return features.read_features(files.mapInArrow(run, "value string"))


def write_geojson(buildings: DataFrame, path: str) -> None:
    """A Feature a line, in parallel; ``collection`` wraps small results into one document."""
    features.feature_json(buildings).write.mode("overwrite").text(path)


def write_files(rows: DataFrame, folder: str) -> int:
    """Write each row (name, content) as a file of a folder in a store that Arrow writes to; how many there are. The tasks write; a file gets its name when it is whole."""

    def run(files: Iterator[Row]) -> Iterator[int]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if re.match(r"\w+:", folder) else (fs.LocalFileSystem(), folder)
        store.create_dir(base)
        n = 0
        for name, content in files:
            part = f"{base}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(content)
            store.move(part, f"{base}/{name}")
            n += 1
        yield n

    # Pickled rows come about a megabyte at a time, or one; an Arrow batch is of thousands of rows, here whole files.
    return rows.select("name", "content").rdd.mapPartitions(run).sum()


def collection(buildings: DataFrame) -> DataFrame:
    """One row: the whole FeatureCollection as text."""
    return features.feature_json(buildings).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("value"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """nom_technique, service, url, file_order of a semicolon table in windows-1252; hard spaces are trimmed."""
    rows = spark.read.csv(path, sep=";", encoding="windows-1252", header=True)
    rows = rows.select([F.trim(F.translate(F.col(f"`{c}`"), " ", " ")).alias(c.strip().lower().replace(" ", "_")) for c in rows.columns])
    return rows.withColumn("file_order", F.monotonically_increasing_id())


EPW_COLUMNS = {"ta": 6, "rh": 8, "pressure": 9, "ghi": 13, "dni": 14, "dhi": 15, "wdir": 20, "ws": 21}


def read_epw(spark: SparkSession, path: str) -> DataFrame:
    """Hourly weather of an EPW file after its eight header lines; hours count from 1."""
    lines = spark.read.text(path).withColumn("f", F.split("value", ",")).where(F.size("f") > 30)
    ts = F.make_timestamp(F.col("f")[0].cast("int"), F.col("f")[1].cast("int"), F.col("f")[2].cast("int"), F.col("f")[3].cast("int") - 1, F.lit(0), F.lit(0.0))
    return lines.select(ts.alias("ts"), *[F.col("f")[i].try_cast("double").alias(n) for n, i in EPW_COLUMNS.items()])


def wind_lines(cells: DataFrame, nx: int, ny: int, height: float) -> DataFrame:
    """Lines ``x y z u v`` in row order under a ``# nx ny h`` header, as (n, value)."""
    head = cells.sparkSession.createDataFrame([(-1, f"# {nx} {ny} {height:g}")], "n long, value string")
    body = cells.select((F.col("row").cast("long") * nx + F.col("col")).alias("n"), F.concat_ws(" ", *[F.format_string("%.3f", F.col(c).cast("double")) for c in ("x", "y", "z", "u", "v")]).alias("value"))
    return head.unionByName(body).orderBy("n")


def read_wind_lines(lines: DataFrame) -> DataFrame:
    """x, y, z, u, v of such lines; an error if the header is missing or counts otherwise."""
    head = lines.where(F.col("value").startswith("#")).select(F.split(F.trim(F.regexp_replace("value", "#", "")), r"\s+").alias("h"))
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("f"))
    nx, ny = (int(x) for x in (head.first() or [["0", "0"]])[0][:2])
    if nx * ny != body.count():
        raise ValueError("the header doesn't fit the rows")
    return body.select(*[F.col("f")[i].cast("double").alias(c) for i, c in enumerate(("x", "y", "z", "u", "v"))])


def ewkb(ring: Column, srid: int) -> Column:
    """A polygon's EWKB (little endian, with the reference system) as a binary Column."""
    hexed = lambda v, n: F.lit(v.to_bytes(n, "little").hex())
    return F.unhex(F.concat(hexed(1, 1), hexed(0x20000003, 4), hexed(srid, 4), hexed(1, 4), _int_hex(F.size(ring)), F.array_join(F.transform(ring, lambda p: F.concat(_double_hex(p["x"]), _double_hex(p["y"]))), "")))


def _flip(hexed: Column, n: int) -> Column:
    return G.bound(hexed, lambda h: F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(n - 1, -1, -1)]))


def _int_hex(n: Column) -> Column:
    return _flip(F.lpad(F.hex(n.cast("long")), 8, "0"), 4)


def _double_hex(x: Column) -> Column:
    """IEEE bits of a double by arithmetic: sign, exponent, fraction; each is computed once."""
    a = F.abs(x)
    near = lambda e: e + F.when(a >= F.pow(F.lit(2.0), e + 1), 1).when(a < F.pow(F.lit(2.0), e), -1).otherwise(0)
    of = lambda e: F.shiftleft((e + 1023).cast("long"), 52) + ((a / F.pow(F.lit(2.0), e) - 1) * float(1 << 52)).cast("long")
    bits = F.when(a == 0, F.lit(0).cast("long")).otherwise(G.bound(G.bound(F.floor(F.log2(a)).cast("int"), near), of))
    return _flip(F.lpad(F.hex(F.when(x < 0, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)), 16, "0"), 8)
