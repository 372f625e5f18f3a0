"""Benchmark decontamination: an FM-index per training shard, searched backwards for every test phrase.

A phrase is a window of ten consecutive words of a test item (a shorter item is one window). Tasks read whole
texts; runs of words that occur in some phrase make a shard's text, since any other word ends what could match, and
runs shorter than the shortest phrase can't match. A full shard is sorted by suffixes and indexed; backward search
over wavelet ranks counts each phrase, sampled suffix positions locate it, and the places merge to removal spans.
Texts are read once and never shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, maybe_broadcast, numbered, plain_columns, text_bytes, texts, tidy, written
from .fm_index import FMIndex

WINDOW = 10
#: Symbols of a shard's index (about 100 bytes each while it is sorted).
SHARD = 1 << 20
#: Documents that may wait for their shard to fill up.
WAITING = 200_000
#: Bytes of test items handed to the tasks at once; more items make more passes over the texts.
BLOCK_BYTES = 16 << 20
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Phrases:
    """The distinct windows of test items as rows of symbols, and the items (names, by number) that hold each."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.symbols: dict[bytes, int] = {}
        number: dict[str | None, int] = {}  # rows of one id are one item
        rows: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            ids = tuple(self.symbols.setdefault(w, len(self.symbols) + 1) for w in text.translate(_WORDS).split())
            item = number.setdefault(None if name is None else str(name), len(number))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                rows.setdefault(ids[i : i + window], set()).add(item)
        self.names = list(number)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.zeros((len(rows), window), np.int32)
        for i, r in enumerate(rows):
            self.rows[i, : len(r)] = r
        self.first = np.concatenate([[0], np.cumsum([len(s) for s in rows.values()], dtype=np.int64)]).astype(np.int64)
        self.items = np.array([x for s in rows.values() for x in sorted(s)], np.int64)
        self.shortest = int(self.lengths.min()) if len(rows) else 1 << 62


class Shard:
    """Runs of known words of many documents, indexed when full."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.parts, self.size = phrases, [], 0
        self.where: list[tuple[int, int, int]] = []  # begin in the shard, document, begin in words

    def add(self, doc: int, ids: np.ndarray) -> None:
        """All runs of ``ids`` (0: a word of no phrase) that could hold a phrase."""
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids != 0).astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.phrases.shortest:
                self.where.append((self.size, doc, a))
                self.parts.append(ids[a : b + 1] if b < len(ids) else np.append(ids[a:b], 0))
                self.size += b - a + 1

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, begin, end) of merged spans in words as rows of one array each, and (document, item) pairs."""
        p = self.phrases
        none = np.zeros(0, np.int64)
        if not self.parts:
            return none, none, none, np.zeros((0, 2), np.int64)
        index = FMIndex(np.concatenate(self.parts), len(p.symbols) + 1)
        low, high = index.search(p.rows, p.lengths)
        n = high - low
        phrase = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        place = index.locate(rows)
        begins, docs, words = np.array(self.where, np.int64).T
        run = np.searchsorted(begins, place, side="right") - 1
        doc, start = docs[run], words[run] + place - begins[run]
        owners = (p.first[1:] - p.first[:-1])[phrase]
        item = p.items[np.arange(owners.sum()) - np.repeat(np.cumsum(owners) - owners, owners) + np.repeat(p.first[phrase], owners)]
        pairs = np.unique(np.stack([np.repeat(doc, owners), item], 1), axis=0)
        by = np.lexsort((start, doc))
        doc, start, end = doc[by], start[by], (start + p.lengths[phrase])[by]
        far = (int(end.max()) if len(end) else 0) + 2
        reach = np.maximum.accumulate(doc * far + end)
        new = np.concatenate([[True], doc[1:] * far + start[1:] > reach[:-1]])[: len(doc)]
        last = np.concatenate([new[1:], [True]])[: len(doc)]
        return doc[new], start[new], reach[last] - doc[last] * far, pairs


_SPANS = "array<struct<begin:long,end:long>>"
_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])


def _scanned(rows: DataFrame, key: str, items: list[tuple[object, bytes]], window: int, shard_size: int) -> DataFrame:
    """(key, n_words, spans, items) of every row (key, text): removal spans in words, sorted and apart; items as strings."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items, window)
        shard, keys, counts = Shard(phrases), [], []

        def full() -> pa.RecordBatch:
            doc, begin, end, pairs = shard.found()
            names = [phrases.names[i] for i in pairs[:, 1].tolist()]
            named = np.array([x is not None for x in names], bool)
            span_at = np.searchsorted(doc, np.arange(len(counts) + 1)).astype(np.int32)
            name_at = np.searchsorted(pairs[named, 0], np.arange(len(counts) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], fields=list(_SPAN))
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(keys), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(span_at, spans), pa.ListArray.from_arrays(name_at, pa.array([x for x in names if x is not None], pa.string()))],
                [key, "n_words", "spans", "items"],
            )

        for whole in batches:
            for batch in chunks(whole, "text"):
                keys.append(batch.column(0))
                for data in text_bytes(batch):
                    words = data.translate(_WORDS).split()
                    shard.add(len(counts), np.fromiter(map(phrases.symbols.get, words, repeat(0)), np.int32, len(words)))
                    counts.append(len(words))
                if shard.size >= shard_size or len(counts) >= WAITING:
                    yield full()
                    shard, keys, counts = Shard(phrases), [], []
        if counts:
            yield full()

    return plain_columns(rows, key, "text").mapInArrow(tidy(run), f"`{key}` {kind}, n_words long, spans {_SPANS}, items array<string>")


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW, shard: int = SHARD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_words, spans, items) for every row of ``docs``.

    spans: the words that lie in any occurrence of a window, as sorted [begin, end) ranges that don't touch; items:
    the item_ids with such windows, as distinct strings. Null and empty texts have no words, items without words
    no windows; items with a null id are searched, but name no item. Repeated items count once, repeated documents
    are told each; empty tables give no rows or no spans. A text of any length is searched whole: a shard ends
    between documents, so memory is that of ``shard`` symbols and one document. Columns of other names aren't
    looked at. Items beyond ``block_bytes`` are searched in blocks, each a pass over ``docs``; a block is dealt by hash.
    """
    tests = benchmark.select(benchmark["`item_id`"].alias("item_id"), F.coalesce(benchmark["`text`"], F.lit("")).alias("text"))
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    if blocks == 1:
        return _scanned(plain_columns(docs, key, "text"), key, [(r[0], r[1].encode()) for r in tests.collect()], window, shard)
    number = "__row"
    rows = numbered(plain_columns(docs, key, "text"), number)
    tests, parts = written(tests, "benchmark"), []
    for b in range(blocks):
        items = [(r[0], r[1].encode()) for r in tests.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()]
        parts.append(_scanned(rows, number, items, window, shard))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy(number).agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    join = f"""aggregate(spans, CAST(array() AS {_SPANS}), (done, s) -> IF(size(done) > 0 AND s.begin <= element_at(done, -1).end,
        concat(slice(done, 1, size(done) - 1), array(named_struct('begin', element_at(done, -1).begin, 'end', greatest(element_at(done, -1).end, s.end)))), concat(done, array(s))))"""
    return rows.select(key, number).join(merged, number).select(key, "n_words", F.expr(join).alias("spans"), "items")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row: the counts of ``contaminated_spans``, whose edge cases hold.

    The digest of no items is that of the empty string.
    """
    found = contaminated_spans(docs, benchmark, window=window)
    return found.select(
        "doc_id", "n_words", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.begin)").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the removal spans cut out of their texts: from a span's first letter to its last; all else stays as it is.

    All columns stay. Null texts stay null; texts without a span aren't touched. The table is written once with a
    number a row; spans of the texts hit meet it by that number.
    """
    number, spans = fresh(docs, "__row"), fresh(docs, "__spans")
    rows = numbered(docs, number)
    found = contaminated_spans(rows, benchmark, number, window).where(F.size("spans") > 0).select(number, F.col("spans").alias(spans))
    both = rows.join(maybe_broadcast(written(found, "spans")), number, "left")
    hit = both.where(F.col(f"`{spans}`").isNotNull()).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{spans}`"))
    kept = both.where(F.col(f"`{spans}`").isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                out = []
                for text, gone in zip(texts(batch), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    places = [m.span() for m in _WORD.finditer(text)]
                    ends = [0, *(x for s in gone for x in (places[s["begin"]][0], places[s["end"] - 1][1])), len(text)]
                    out.append("".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                at = batch.schema.get_field_index("text")
                cols = [pa.array(out, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    return kept.unionByName(hit.mapInArrow(tidy(cut), docs.schema))
