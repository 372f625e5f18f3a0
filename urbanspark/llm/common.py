"""What the corpus operators share: table access, durable intermediate tables, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a Python worker; bounds its memory whatever a batch holds.
CHUNK_BYTES = 4 << 20
#: Bytes of an Arrow batch between the JVM and a worker while an intermediate table is written.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode, where that is unset, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="urbanspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths of the tables that the innermost ``scratch`` has to delete.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors.

    The table stays until the folder is cleared, but for one inside a ``scratch``. Arrow batches are bounded by bytes while it is written
    (a session setting, restored afterwards: threads that share a session may see it).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes every table written inside when it ends, but for those of the ``keep(df, what)`` that it gives; these belong to the scratch around it, if there is one.

    Inside, nothing may be left lazy that reads a table which goes: what goes on is to be written by ``keep``.
    """
    outer, own = _SCRATCH.get(), []
    token = _SCRATCH.set(own)

    def keep(df: DataFrame, what: str) -> DataFrame:
        out = written(df, what)
        path = own.pop()
        if outer is not None:
            outer.append(path)
        return out

    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in own:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which lives on for other tasks, gives freed memory back to the system."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Freed memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a file that numbers are left for.
_FILE_ROWS = 1 << 40


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df``, each row with a number of its own in the column ``name``: however it is split and read again, the number stays with the row.

    A plain scan of Parquet files is numbered by the file and the row's place in it, and nothing is copied; only the list of files is written.
    Any other table is written once together with its numbers.
    """
    place = _places(df, fresh(df, "__file"), fresh(df, "__place"))
    if place is None:
        return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    file, at = place.columns[-2:]
    n = fresh(df, "__n")
    # A row a file: one task numbers them.
    files = written(place.select(file).distinct().coalesce(1).withColumn(n, F.monotonically_increasing_id()), "files")
    rows = place.join(maybe_broadcast(files), file)
    return rows.select(*[rows[f"`{c}`"] for c in df.columns], (F.col(n) * _FILE_ROWS + F.col(at)).alias(name))


def _places(df: DataFrame, file: str, at: str) -> DataFrame | None:
    """``df`` with each row's file and place in it, if it is a plain scan of Parquet files."""
    if "_metadata" in {c.lower() for c in df.columns} or len({c.lower() for c in df.columns}) < len(df.columns):
        return None
    try:
        if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
            return None
        return df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    except (AnalysisException, AttributeError):
        return None


def plain_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of a table can't clash with those an operator adds."""
    return df.select(*[df[f"`{n}`"] for n in names])


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of ``column`` each, at least one row."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pa.compute.binary_length(col).fill_null(0), dtype=np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return col.fill_null("").to_pylist()


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's strings as UTF-8; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column)).fill_null("")
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return col.cast(kind).to_pylist()


#: Rows of two or three numbers that may be broadcast after they have been counted.
BROADCAST_ROWS = 1_000_000


def maybe_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it is counted to be within ``limit`` rows, else as it is (a shuffled join)."""
    few = small.limit(limit + 1).count() <= limit
    return F.broadcast(small) if few else small


#: A key is hot if it has more than one row in so many.
HOT_SHARE = 1000


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys that may have over 1/share of the rows (a mergeable sketch proposes them): at most 2 x share rows, written; nulls are none."""
    sketch = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k({key}, {2 * share}, {8 * share})").alias("top"), F.count("*").alias("rows"))
    top = sketch.select("rows", F.explode("top").alias("x")).where(F.col("x.count") * share > F.col("rows"))
    return written(top.select(F.col("x.item").alias(key)), "hot-keys")


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has at most one row a key: rows of hot keys meet a broadcast, all others are shuffled.

    ``left`` should be a written table; it is read three times.
    """
    hot = F.broadcast(hot_keys(left, key))
    few = F.broadcast(right.join(hot, key, "left_semi"))
    rest = left.join(hot, key, "left_anti")
    return left.join(hot, key, "left_semi").join(few, key, how).unionByName(rest.join(right, key, how))
