"""SimHash near-dedup with pivot distance tables.

Fingerprints within two bits agree on at least six of eight bytes. So each distinct fingerprint is filed under
its 28 choices of six bytes; a file that more than one fingerprint shares holds 65,536 at most, whatever the
corpus, and only such files go further. Inside a file the pivot table has the Hamming distances to reference
fingerprints: a pair whose coordinates differ by more than the limit anywhere can't be within it (triangle
inequality) and is discarded; survivors are verified on the bits themselves. A file passes on a spanning forest
of its links, never its pairs, and connected components over distinct fingerprints give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, plain_columns, split_join, text_bytes, written
from .components import connected_components

BITS = 2
SHINGLE = 3
SEED = 42
#: Reference fingerprints of a pivot table.
PIVOTS = 16
_CHOICES = list(combinations(range(8), 2))


def fingerprint(data: bytes, k: int = SHINGLE) -> int:
    """Bits set in over half the XXH64 values of the text's k-word shingles, A-Z lowered; no words: zero."""
    words = data.lower().split()
    if not words:
        return 0
    rows = [words[i:] for i in range(k)] if len(words) >= k else [[w] for w in words]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(b" ".join(s), SEED) for s in zip(*rows, strict=False)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row, fp as a signed long; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                fp = np.array([fingerprint(x, k) for x in text_bytes(batch)], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return plain_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def pivot_forest(fps: np.ndarray, bits: int = BITS, pivots: int = PIVOTS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints (uint64, sorted or not).

    The table is sorted by its first coordinate, so only a window of rows can pass that coordinate; the others
    cut the window down, and the bits decide.
    """
    rng = np.random.default_rng(7)
    refs = np.concatenate([np.array([0], np.uint64), rng.integers(0, 1 << 63, pivots - 1, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, pivots - 1, dtype=np.uint64)])
    # References that agree with the file where its members agree put the spread into the bits that differ.
    refs[1:] = np.where(np.arange(1, pivots) % 2 == 0, refs[1:], fps[0] ^ (refs[1:] & np.bitwise_or.reduce(fps ^ fps[0])))
    dist = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int16)
    order = np.lexsort((fps, dist[:, 0]))
    fps, dist = fps[order], dist[order]
    ends = np.searchsorted(dist[:, 0], dist[:, 0] + bits, side="right")
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in range(len(fps)):
        near = np.arange(i + 1, ends[i])
        for c in range(1, pivots):
            if len(near) < 8:
                break
            near = near[np.abs(dist[near, c] - dist[i, c]) <= bits]
        if len(near):
            for j in near[np.bitwise_count(fps[near] ^ fps[i]) <= bits].tolist():
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    edges.append((int(fps[i]), int(fps[j])))
    return edges


def near_edges(fps: DataFrame) -> DataFrame:
    """(a, b): for distinct fingerprints (column fp), links that connect whatever is connected within BITS bits."""
    keep = [np.array(sum(0xFF << 8 * b for b in range(8) if b not in c), np.uint64).view(np.int64).item() for c in _CHOICES]
    keys = F.array(*[F.struct(F.lit(n).cast("byte").alias("n"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(keep)])
    # Dealt out anew: the few bytes of distinct fingerprints would else be merged into a task or two ahead of the 28-fold explode.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = fps.select("fp").repartition(tasks, "fp").select("fp", F.explode(keys).alias("k")).select("fp", "k.n", "k.key")
    files = filed.groupBy("n", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            flat, at = np.asarray(col.flatten()).view(np.uint64), np.asarray(col.offsets) - np.asarray(col.offsets)[0]
            found = [e for a, b in zip(at[:-1], at[1:], strict=True) for e in pivot_forest(flat[a:b])]
            ends = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return files.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach) for every row.

    Documents without words have fingerprint zero and are linked like any other. Rows repeated whole, and rows
    of one fingerprint, share a component. A null doc_id is never a component's name unless all its ids are
    null. An empty table gives an empty result; other columns aren't looked at.
    """
    docs_fp = written(fingerprints(docs, k), "fingerprints")
    distinct = docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(near_edges(distinct))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = written(named, "fp-roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # A fingerprint may have any share of the documents, as that of texts without words.
    out = split_join(docs_fp, written(named.join(ids, "root").select("fp", "component_id"), "fp-components"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
