"""Centroid clustering by annulus search: Lloyd rounds in exact integers.

Centroids are sorted by norm. A vector's distance to a centroid of about its own norm bounds its distance to the
nearest one, so by the triangle inequality the nearest has a norm within that bound of the vector's own: two binary
searches give the annulus, and only its centroids are compared, exactly. Centroids (a few thousand numbers) go to the
tasks with their function; every task sends one row of sums per cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_columns, tidy, written

DIM, K, ROUNDS, SEED = 64, 40, 5, 2
SCALE = 256
#: Components of this size or above aren't kept: distances must fit into a long.
LIMIT = 1 << 27
#: Vectors compared at once.
BLOCK = 4096


def vectors(embeddings: DataFrame, dim: int = DIM, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors with ``dim`` components, none null or non-finite, as integers floor(256 * x); written once.

    Vectors with an integer of ``LIMIT`` or more are left out as well: their distances would leave the range of a long.
    """
    rows = plain_columns(embeddings, key, column).toDF("vec_id", "e")
    whole = F.expr(f"size(e) = {dim} AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(double(x)) < {LIMIT // SCALE})")
    v = F.expr(f"transform(e, x -> int(floor({SCALE} * double(x))))")
    return written(rows.where(F.col("e").isNotNull() & whole).select("vec_id", v.alias("v")), "vectors")


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hex sha256 of ``seed:vec_id``, in that order; equal ids by their components, null ids last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    best = rows.select(name.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in best], np.int64)


def _arrays(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(column)).flatten(), np.int64).reshape(-1, dim)


class Annulus:
    """Centroids by norm, and the exact nearest one of each vector."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.squares = centroids, (centroids**2).sum(1)
        norms = np.sqrt(self.squares.astype(np.float64))
        self.by_norm = np.argsort(norms, kind="stable")
        self.norms = norms[self.by_norm]

    def _distance(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((x - c) ** 2).sum(-1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster (of equally near ones the smallest number), squared distance, and how many comparisons it took."""
        norm = np.sqrt((x**2).sum(1).astype(np.float64))
        right = np.clip(np.searchsorted(self.norms, norm), 1, max(1, len(self.norms) - 1))
        closer = np.where(norm - self.norms[right - 1] <= self.norms[np.minimum(right, len(self.norms) - 1)] - norm, right - 1, np.minimum(right, len(self.norms) - 1))
        seed = self.by_norm[closer]
        best, at = self._distance(x, self.centroids[seed]), seed.copy()
        reach = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (norm + reach) + 1e-6  # roots are rounded: a wider annulus loses nothing
        low = np.searchsorted(self.norms, norm - reach - slack, side="left")
        high = np.searchsorted(self.norms, norm + reach + slack, side="right")
        for j in range(int(low.min()), int(high.max())):
            rows = np.flatnonzero((low <= j) & (j < high))
            c = self.by_norm[j]
            d = self._distance(x[rows], self.centroids[c])
            better = (d < best[rows]) | ((d == best[rows]) & (c < at[rows]))
            best[rows[better]], at[rows[better]] = d[better], c
        return at, best, int((high - low).sum())


def _sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and exact componentwise sums of each non-empty cluster."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annulus, k = Annulus(centroids), len(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            every = _arrays(batch, "v", dim)
            for a in range(0, len(every), BLOCK):
                x = every[a : a + BLOCK]
                at = annulus.nearest(x)[0]
                by = np.argsort(at, kind="stable")
                cuts = np.flatnonzero(np.diff(at[by], prepend=-1))
                count += np.bincount(at, minlength=k)
                total[at[by][cuts]] += np.add.reduceat(x[by], cuts, axis=0)
        some = np.flatnonzero(count)
        if len(some):
            offsets = np.arange(0, (len(some) + 1) * dim, dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array(count[some], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(total[some].ravel(), pa.int64()))], ["cluster", "n", "s"]
            )

    parts = rows.select("v").mapInArrow(tidy(run), "cluster int, n long, s array<long>")
    exact = [F.sum(F.col("s")[i].cast("decimal(19,0)")).alias(f"s{i}") for i in range(dim)]
    return {r[0]: (int(r[1]), [int(x) for x in r[2:]]) for r in parts.groupBy("cluster").agg(F.sum("n"), *exact).collect()}


def lloyd(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """The centroids after so many rounds; a non-empty cluster's is the exact floor of its mean, an empty one's stays."""
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for c, (n, sums) in _sums(rows, centroids).items():
            centroids[c] = [s // n for s in sums]
    return centroids


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    kind = dict(rows.dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annulus = Annulus(centroids)
        for batch in batches:
            every = _arrays(batch, "v", centroids.shape[1])
            for a in range(0, len(every), BLOCK):
                at, best, _ = annulus.nearest(every[a : a + BLOCK])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(at)), pa.array(at, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v").mapInArrow(tidy(run), f"vec_id {kind}, cluster int, distance long")


def clusters(embeddings: DataFrame, dim: int = DIM, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Kept are vectors as ``vectors`` says; repeated rows and repeated ids are vectors of their own. With fewer than k
    kept vectors there are fewer clusters; without any, or with an empty table, no rows. Of equally near centroids the
    smallest number counts. Columns other than vec_id and embedding aren't looked at.
    """
    rows = vectors(embeddings, dim)
    centroids = lloyd(rows, k, rounds, seed)
    if not len(centroids):
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    out = written(assigned(rows, centroids), "clusters")
    each = {r[0]: r[1] for r in out.groupBy("cluster").agg(F.sum("distance")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by = lambda values, t: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("cluster") + 1).cast(t)
    return out.select(
        "vec_id", "cluster", "distance", by([each.get(c, 0) for c in range(len(names))], "long").alias("cluster_inertia"), F.lit(reduce(int.__add__, each.values(), 0)).cast("long").alias("inertia"), by(names, "string").alias("centroid_sha256")
    )
