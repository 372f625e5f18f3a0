"""Near-dedup of the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A SimHash radius that holds nearly all such pairs is too wide for files of equal bytes (at 0.8 about ten bits of 64
differ), so a file holds the texts that share a band of four of 128 min-hashes: a pair at 0.8 shares none of the 32
bands with a probability of 5e-8. Inside a file pairs are discarded without looking at the sets: by the counts of
shingles that no other text of any file has (exact), by the pivot table of 256-bit SimHash fingerprints (a pair whose
Hamming distances to a reference fingerprint differ by more than the radius is out of it) and by the distance itself.
Survivors are verified on the sets. A file tries only pairs that no links connect as yet, and passes on a forest of
its links; a large file is cut into chunks of bounded size, and every pair of chunks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, maybe_broadcast, numbered, scratch, text_bytes, tidy, written
from .components import connected_components

SHINGLE, SEED = 5, 42
BANDS, ROWS = 32, 4
#: Bands whose files are looked at in each round; later rounds know what earlier ones linked.
ROUNDS = ((0, 4), (4, BANDS))
_MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words of the fingerprint of a set, and bits by which two of sets at 0.8 may differ: 39 of 256 are expected, and 80 are over five deviations off.
FP_WORDS, RADIUS = 4, 80
_FP_MULTIPLIERS = np.random.default_rng(12).integers(0, 1 << 63, FP_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Reference fingerprints of a file's pivot table.
PIVOTS = 8
#: Shingles in a chunk of a file.
CHUNK = 1 << 20


def shingles(data: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 values of the k-word shingles, A-Z lowered; a shorter text is one shingle, no words: none."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    rows = [words[i:] for i in range(k)] if len(words) >= k else [[w] for w in words]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(s), SEED) for s in zip(*rows, strict=False)], dtype="<u8"))


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes of a set; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(own), 256):  # stays in the cache
        np.minimum(low, (own[at : at + 256, None] * _MULTIPLIERS).min(axis=0), out=low)
    key = np.zeros(BANDS, np.uint64)
    for part in low.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text"):
            data = text_bytes(batch)
            own = [shingles(x) for x in data]
            same = [xxhash.xxh3_128_digest(x.tobytes()) for x in own]
            texts = [xxhash.xxh3_128_digest(x) for x in data]
            keys = pa.array([bands(x) for x in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary()), pa.array(same, pa.binary()), keys], ["row", "doc_id", "hash", "same", "bands"])


def set_fingerprint(own: np.ndarray) -> bytes:
    """256 bits, each set in over half of the set's hashes."""
    h = own[:, None] * _FP_MULTIPLIERS
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    ones = np.zeros(64 * FP_WORDS, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8 * FP_WORDS), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h)).tobytes()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text"):
            own = [shingles(x) for x in text_bytes(batch)]
            prints = pa.array(map(set_fingerprint, own), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64())), prints], ["node", "own", "fp"])


def file_forest(node: np.ndarray, root: np.ndarray, side: np.ndarray, core: np.ndarray, fps: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect whatever members of a file, or of two of its chunks, are connected by pairs at 0.8 or more.

    core: shingles that another text has too. Of two chunks (side) only pairs between them are tried. A pair shares four
    fifths of the larger set, so one of the rarest fifth and one more of either's shingles is in both: only texts that
    share such a shingle are compared, whatever boilerplate all of them have.
    """
    order = np.lexsort((node, np.array([len(x) for x in sets]) - core))
    node, side, core, fps, sets = node[order], side[order], core[order], fps[order], [sets[i] for i in order]
    label = np.unique(root[order], return_inverse=True)[1]
    size = np.array([len(x) for x in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    stop = np.cumsum(size)
    start, mine = stop - size, np.zeros(len(values), bool)
    follow, begin, end, bound = _rarest(flat, size, len(values))
    refs = fps[np.unique(np.linspace(0, len(fps) - 1, PIVOTS).astype(int))]
    table = np.bitwise_count(fps[:, None] ^ refs[None]).sum(axis=2, dtype=np.int16)
    across = side.min() != side.max()
    links = []
    for i in range(len(node) - 1):
        own = slice(bound[i], bound[i + 1])
        to = np.unique(np.concatenate([follow[:0], *(follow[a:b] for a, b in zip(begin[own].tolist(), end[own].tolist(), strict=True))]))
        to = to[label[to] != label[i]]
        if across:
            to = to[side[to] != side[i]]
        # What two texts share is at most what either shares with any; shared * 9 >= both * 4 is shared / (both - shared) >= 4 / 5.
        to = to[9 * np.minimum(core[to], core[i]) >= 4 * (size[to] + size[i])]
        to = to[np.abs(table[to] - table[i]).max(axis=1, initial=0) <= RADIUS]
        to = to[np.bitwise_count(fps[to] ^ fps[i]).sum(axis=1) <= RADIUS]
        if not len(to):
            continue
        mine[flat[start[i] : stop[i]]] = True
        shared = np.array([np.count_nonzero(mine[flat[start[j] : stop[j]]]) for j in to.tolist()])
        mine[flat[start[i] : stop[i]]] = False
        for j in to[9 * shared >= 4 * (size[to] + size[i])].tolist():
            if label[i] != label[j]:
                links.append((int(node[i]), int(node[j])))
                label[label == label[j]] = label[i]
    return links


def _rarest(flat: np.ndarray, size: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members by rare shingle; and slices (begin, end) of those that come after a member with one of its own rare shingles, member i's from bound[i] to bound[i + 1]."""
    owner = np.repeat(np.arange(len(size)), size)
    often = np.bincount(flat, minlength=values)
    rank = np.empty(values, np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(values)
    order = np.lexsort((rank[flat], owner))
    nth = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    rare = order[nth < np.repeat(size - -(-4 * size // 5) + 1, size)]
    rare = rare[often[flat[rare]] > 1]
    rare = rare[np.lexsort((owner[rare], flat[rare]))]
    follow, key = owner[rare], flat[rare]
    end = np.searchsorted(key, key, side="right")
    at = np.flatnonzero(np.arange(1, len(key) + 1) < end)
    at = at[np.argsort(follow[at], kind="stable")]
    return follow, at + 1, end[at], np.searchsorted(follow[at], np.arange(len(size) + 1))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by file and chunks; a group ends where these change."""
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        own = t["own"].chunk(0) if t["own"].num_chunks else pa.array([], pa.list_(pa.int64()))
        at, values = own.offsets.to_numpy(), own.values.to_numpy()
        sets = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        fps = np.frombuffer(b"".join(t["fp"].to_pylist()), np.uint64).reshape(-1, FP_WORDS)
        links = file_forest(*(t[c].to_numpy() for c in ("node", "root", "side", "core")), fps, sets)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(keys[:, a]) != last:
                yield done()
            last = tuple(keys[:, a])
            held.append(batch.slice(a, b - a))
    if held:
        yield done()


def near_components(rows: DataFrame, row: str) -> DataFrame:
    """(row, doc_id, hash, component) for every row of a ``numbered`` table; hash is of the text, null counts as empty.

    Components are those of all pairs with a similarity of 0.8 or more; texts without words are alike.
    """
    with scratch(rows.sparkSession) as keep:
        small = written(rows.select(F.col(f"`{row}`").alias("row"), "doc_id", "text").mapInArrow(tidy(_sketches), "row long, doc_id long, hash binary, same binary, bands array<long>"), "near-sketches")
        # Texts of one set are one node, named by its smallest row.
        nodes = small.groupBy("same").agg(F.min("row").alias("node"))
        named = written(small.select("row", "doc_id", "hash", "same").join(nodes, "same").drop("same"), "near-nodes")
        heads = small.join(named.where("row = node").select("row"), "row", "left_semi")
        filed = heads.select(F.col("row").alias("node"), F.posexplode("bands").alias("n", "key"))
        files = written(filed.groupBy("n", "key").agg(F.count("*").alias("members")).where("members > 1").select("n", "key"), "near-files")
        members = written(filed.join(maybe_broadcast(files), ["n", "key"], "left_semi"), "near-members")
        meant = maybe_broadcast(written(members.select(F.col("node").alias(row)).distinct(), "near-meant"))
        sets = written(rows.select(f"`{row}`", "text").join(meant, row, "left_semi").mapInArrow(tidy(_sets), "node long, own array<long>, fp binary"), "near-sets")
        # Shingles that a single text has; with more than a fifth of them it has no near copy.
        lone = sets.select("node", F.explode("own").alias("x")).groupBy("x").agg(F.count("*").alias("texts"), F.min("node").alias("node")).where("texts = 1")
        lone = lone.groupBy("node").agg(F.count("*").alias("lone"))
        known = sets.select("node", F.size("own").alias("size")).join(lone, "node", "left").withColumn("core", F.col("size") - F.coalesce("lone", F.lit(0)))
        known = written(known.where("5 * core >= 4 * size").select("node", "size", "core"), "near-known")
        links, roots = None, None
        for lo, hi in ROUNDS:
            tried = members.where(F.col("n").between(lo, hi - 1)).join(maybe_broadcast(known), "node")
            tried = tried.withColumn("root", F.col("node")) if roots is None else tried.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            tried = written(tried, "near-tried")
            apart = tried.groupBy("n", "key").agg(F.sum("size").alias("total"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
            apart = written(apart.select("n", "key", F.ceil(F.col("total") / CHUNK).alias("chunks")), "near-apart")
            cut = tried.join(maybe_broadcast(apart), ["n", "key"]).withColumn("side", F.pmod(F.xxhash64("node"), "chunks"))
            cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
            cut = cut.select("n", "key", F.least("side", "other").alias("c"), F.greatest("side", "other").alias("d"), "node", "root", "side", "core")
            whole = cut.join(sets, "node").select("n", "key", "c", "d", "node", "root", "side", "core", "own", "fp")
            found = whole.repartition("n", "key", "c", "d").sortWithinPartitions("n", "key", "c", "d").mapInArrow(tidy(_linked), "a long, b long")
            found = written(found, "near-links")
            links = found if links is None else links.union(found)
            roots = connected_components(links)
        return keep(named.join(roots, "node", "left").select("row", "doc_id", "hash", F.coalesce("root", "node").alias("component")), "near-components")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one, with the smallest doc_id (nulls last), then the smallest hash of its text.

    The table is written once with a number in each row, and rows go by that number: ids may be repeated or null.
    Texts without words, null ones among them, are alike; of rows repeated whole one stays. An empty table gives an
    empty result; other columns, whatever their names, are handed through.
    """
    row = fresh(docs, "__row")
    rows = numbered(docs, row)
    found = near_components(rows, row)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash", "row")
    stay = found.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("size")).where("size > 1")
    gone = found.join(stay, "component").where("row <> best.row").select(F.col("row").alias(row))
    return rows.join(maybe_broadcast(written(gone, "near-gone")), row, "left_anti").select(*[rows[f"`{c}`"] for c in docs.columns])
