"""Lexical retrieval packing: sequences whose documents share words.

One pass turns each document into token ids. Its full windows are sequences of their own; what remains, less than a
window, is packed by retrieval. Remainders are dealt to shards of a bounded number of documents by a sketch of
their words (rare ones count more), so that lexical neighbours meet, and each shard is an inverted index with BM25
weights whose document frequencies are counted over the whole corpus. A seed document asks its shard with all its
words for the best unused neighbours, which fill its window greedily; the one that crosses the end is cut there, and
its rest is the next seed. A task holds many shards, one after another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, give_back, plain_columns, tidy, written

WINDOW = 2048
END_ID = 1
#: Remainders in a shard at least, where a task has so many; twice as many at most.
SHARD = 2000
#: Bytes of remainders that a task is meant to have.
TASK_BYTES = 64 << 20
#: A token is common in a shard if one text in so many has it.
COMMON = 8
#: BM25's parameters.
K1, B = 1.2, 0.75
#: Bytes of words a worker remembers the ids of, each counted as its characters and _EACH.
_REMEMBER, _EACH = 60 << 20, 120
#: Bytes of text cut at once: words, places and ids of a chunk take some twenty times as much.
_CUT_BYTES = 2 << 20
#: Texts handed to the tokenizer at once.
_ENCODED = 16
#: Ids below this are counted in tables; a tokenizer with more needs wider pieces.
_IDS = 1 << 16


class Tokens:
    """Token ids of whole columns: words between white space are tokenised once and remembered.

    Right for tokenizers that lower case, drop white space and never take it into a token, as the default one: its
    expression parts letters from signs, and its normalisation works within a word. So a sign after a letter may be
    parted beforehand, and words of letters alone can be handed over many at a time: each ends with the one token
    that has the mark of a word's end.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(_IDS, bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        # Entry 0 is the end of a text.
        self.pool, self.first, self.size = np.full(1, END_ID, np.uint16), np.zeros(1, np.int32), np.ones(1, np.int32)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the tokenizer's own results, hundreds of bytes a token, are there for a few texts at a time."""
        out: list[np.ndarray] = []
        for at in range(0, len(texts), _ENCODED):
            out += [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts[at : at + _ENCODED], add_special_tokens=False)]
        return out

    def _learn(self, words: list[str]) -> None:
        plain: list[str] = []
        other: list[str] = []
        for w in words:
            (plain if w.isalpha() and (w.isascii() or w.lower().isalpha()) else other).append(w)
        ids = self._encoded([" ".join(plain[i : i + 256]) for i in range(0, len(plain), 256)])
        flat = _joined(ids)
        stops = np.flatnonzero(self.ends[flat]) + 1
        if len(stops) != len(plain):  # a tokenizer of another kind: one by one
            other, plain, flat, stops = plain + other, [], flat[:0], stops[:0]
        rest = self._encoded(other)
        sizes = np.concatenate([np.diff(stops, prepend=0), np.array([len(r) for r in rest], np.int64)]).astype(np.int32)
        base = len(self.size)
        self.held += sum(map(len, plain)) + sum(map(len, other)) + _EACH * len(sizes)
        self.known.update(zip(plain + other, range(base, base + len(sizes)), strict=True))
        self.first = np.concatenate([self.first, (len(self.pool) + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.size = np.concatenate([self.size, sizes])
        self.pool = np.concatenate([self.pool, flat, _joined(rest)])

    def _look_up(self, words: list[str]) -> np.ndarray:
        if self.held > _REMEMBER:
            self.clear()
        entry = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(entry < 0)):
            fresh = [words[i] for i in new.tolist()]
            self._learn(fresh)
            entry[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        return entry

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint16 with END_ID after each text, and the bounds of the texts."""
        column = column.fill_null("").cast(pa.string())
        if not pc.any(pc.match_substring(column, "<|")).as_py():  # the special tokens' own case matters
            column = pc.replace_substring_regex(pc.ascii_lower(column), "([a-z])([.,;:!?])", r"\1 \2")
        words = pc.ascii_split_whitespace(column)
        flat = words.flatten().dictionary_encode()
        # Through NumPy a word is made in a tenth of the time that Arrow's own scalars take.
        entry = self._look_up(flat.dictionary.to_numpy(zero_copy_only=False).tolist())
        stops = np.asarray(words.offsets)[1:] - words.offsets[0].as_py()
        word = np.insert(entry[np.asarray(flat.indices)], stops, 0)
        size = self.size[word]
        stop = np.cumsum(size, dtype=np.int32)  # a chunk has far fewer ids than that holds
        at = np.repeat(self.first[word] - (stop - size), size)
        at += np.arange(len(at), dtype=np.int32)
        return self.pool.take(at), np.concatenate([[0], stop[stops + np.arange(len(column))]])


def _joined(lists: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint16), *lists])


@cache
def _tokens(path: str) -> Tokens:
    """A worker's tokenizer, kept from task to task."""
    return Tokens(path)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_FIELDS = {"kind": pa.int8(), "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "ids": pa.binary()}
_SCHEMA = "kind byte, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_WINDOW_ROW, _REST_ROW, _COUNT_ROW = 0, 1, 2


def _cut(path: str):
    """Windows, remainders and the batch's document frequencies (doc_id: term, -1 for documents, -2 for tokens, -3 for those of remainders; length: how many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, df, docs, total, rests = _tokens(path), np.zeros(_IDS, np.int64), 0, 0, 0
        for whole in batches:
            give_back()  # what new words took in the batch before
            for batch in chunks(whole, "text", _CUT_BYTES):
                ids, bounds = tokens.batch(batch.column(1))
                rows = []
                for doc, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own, n = ids[a:b], b - a
                    df[_counted(own)[0]] += 1
                    for at in range(0, n - WINDOW + 1, WINDOW):
                        rows.append((_WINDOW_ROW, doc, at, WINDOW, _crc(own[at : at + WINDOW]), n, None))
                    if rest := n % WINDOW:
                        rows.append((_REST_ROW, doc, n - rest, rest, 0, n, own[n - rest :].tobytes()))
                        rests += rest
                docs, total = docs + len(batch), total + len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _FIELDS.values(), strict=True)], list(_FIELDS))
        terms = np.flatnonzero(df)
        counts = [(_COUNT_ROW, int(t), 0, int(df[t]), 0, 0, None) for t in terms] + [(_COUNT_ROW, -k, 0, x, 0, 0, None) for k, x in ((1, docs), (2, total), (3, rests))]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*counts, strict=True), _FIELDS.values(), strict=True)], list(_FIELDS))

    return run


def _hashes() -> np.ndarray:
    """For each token id a number from 0 to 1, by a mixing function."""
    h = (np.arange(_IDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = ((h >> np.uint64(29)) ^ h) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(12)).astype(float) + 0.5) / (1 << 52)


def _sketched(idf: Broadcast):
    """Adds to each remainder the first of its tokens in an order by chance in which the idf of a token is its rate: texts that share rare tokens often share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.argsort(np.argsort(-np.log(_hashes()) / np.maximum(idf.value, 1e-6), kind="stable"), kind="stable")
        for batch in batches:
            first = [np.partition(rank[np.frombuffer(x, np.uint16)], 0)[0] for x in batch.column(3).to_pylist()]
            yield batch.append_column("sketch", pa.array(first, pa.int64()))

    return run


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, rising, and how often each occurs."""
    line = np.sort(ids, kind="stable")  # by radix: ids are short
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    return line[first].astype(np.int64), np.diff(first, append=len(line))


class Shard:
    """BM25 over the remainders of a shard: rows of weights for tokens that many texts have, lists of texts for all others.

    Used documents go from both when they are half of all.
    """

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.terms, tfs = [], []
        for ids in texts:
            term, tf = _counted(ids)
            self.terms.append(term)
            tfs.append(tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean)))
        size = np.array([len(t) for t in self.terms])
        term, doc = np.concatenate(self.terms), np.repeat(np.arange(len(texts), dtype=np.int32), size)
        weight = (np.concatenate(tfs) * idf[term]).astype(np.float32)
        common = np.bincount(term, minlength=_IDS) * COMMON > len(texts)
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        rows = self.row[term]
        self.dense = np.zeros((int(common.sum()), len(texts)), np.float32)
        self.dense[rows[rows >= 0], doc[rows >= 0]] = weight[rows >= 0]
        order = np.flatnonzero(rows < 0)
        order = order[np.argsort(term[order], kind="stable")]
        self.term, self.doc, self.weight = term[order], doc[order], weight[order]
        self.free, self.left = np.ones(len(texts), bool), len(texts)
        self.docs = np.arange(len(texts))
        self._bound()

    def _bound(self) -> None:
        self.place = np.zeros(len(self.free), np.int32)
        self.place[self.docs] = np.arange(len(self.docs))
        self.bounds = np.searchsorted(self.term, np.arange(_IDS + 1))

    def use(self, i: int) -> None:
        self.left -= bool(self.free[i])
        self.free[i] = False
        if 2 * self.left < len(self.docs) and len(self.docs) > 64:
            keep = self.free[self.docs[self.doc]]
            kept = self.free[self.docs]
            self.docs, self.dense = self.docs[kept], self.dense[:, kept]
            place = np.cumsum(kept) - 1
            self.term, self.doc, self.weight = self.term[keep], place[self.doc[keep]].astype(np.int32), self.weight[keep]
            self._bound()

    def neighbours(self, seed: int, tokens: np.ndarray, need: int) -> Iterator[int]:
        """Unused documents by falling score (ties: in order), as many as ``need`` tokens ask for."""
        t = self.terms[seed]
        rows = self.row[t]
        score = self.dense[rows[rows >= 0]].sum(axis=0)
        t = t[rows < 0]
        a, n = self.bounds[t], self.bounds[t + 1] - self.bounds[t]
        at = np.repeat(a - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        score = score + np.bincount(self.doc[at], self.weight[at], len(self.docs))
        left = np.flatnonzero(self.free[self.docs])
        own, left = score[left], self.docs[left]
        for most in (64, len(left)):  # a few are enough as a rule
            best = left if most >= len(left) else left[own >= np.partition(own, len(own) - most)[len(own) - most]]
            order = best[np.argsort(-score[self.place[best]], kind="stable")]
            reached = np.cumsum(tokens[order])
            if most >= len(left) or reached[-1] >= need:
                break
        yield from order[: int(np.searchsorted(reached, need)) + 1].tolist()


def _fill(texts: list[np.ndarray], idf: np.ndarray, mean: float) -> list[tuple[int, int, int, int, int]]:
    """(text, start in it, length, sequence, offset): every token once, all sequences but the last full."""
    shard, sizes = Shard(texts, idf, mean), np.array([len(t) for t in texts], np.int64)
    out, sequence, filled = [], 0, 0
    cut: tuple[int, int] | None = None  # a text whose rest opens the next sequence
    seeds = iter(range(len(texts)))
    while True:
        if cut is None:
            seed = next((i for i in seeds if shard.free[i]), None)
            if seed is None:
                return out
            cut = (seed, 0)
            shard.use(seed)
        doc, at = cut
        queue, cut = [(doc, at)], None
        near = shard.neighbours(doc, sizes, WINDOW)
        while filled < WINDOW and (queue or (nxt := next(near, None)) is not None):
            i, at = queue.pop() if queue else (nxt, 0)
            shard.use(i)
            n = min(WINDOW - filled, int(sizes[i]) - at)
            out.append((i, at, n, sequence, filled))
            filled += n
            if at + n < sizes[i]:
                cut = (i, at + n)
        if filled < WINDOW:
            return out
        sequence, filled = sequence + 1, 0


def packed(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed each, as documents of their own. Only a
    shard's last sequence is short. An empty table gives no rows; other columns aren't looked at. The ids of a
    shard's remainders, two bytes each, are what is shuffled.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(docs[f"`{key}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
    cut = written(rows.mapInArrow(tidy(_cut(path)), _SCHEMA), "packing")
    # Bounded by the vocabulary, whatever the corpus: one number a token id.
    counts = {r["doc_id"]: r["n"] for r in cut.where(F.col("kind") == _COUNT_ROW).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    n, total, rests = (counts.pop(k, 0) for k in (-1, -2, -3))
    idf = np.zeros(_IDS, np.float32)
    if counts:
        df = np.array(list(counts.values()), float)
        idf[list(counts)] = np.log(1 + (n - df + 0.5) / (df + 0.5))
    mean = total / n if n else 1.0
    table = docs.sparkSession.sparkContext.broadcast(idf)

    windows = cut.where(F.col("kind") == _WINDOW_ROW).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = 0

        def done() -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(held)
            texts = [np.frombuffer(x, np.uint16) for x in t["ids"].to_pylist()]
            doc, start, tokens = (t[c].to_pylist() for c in ("doc_id", "start", "doc_tokens"))
            rows = [(doc[i], start[i] + at, n, _crc(texts[i][at : at + n]), tokens[i], number + seq, off) for i, at, n, seq, off in _fill(texts, table.value, mean)]
            number += 1 + max(r[5] for r in rows) - number
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "number", "offset"])

        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                if held and sum(len(b) for b in held) + len(part) > 2 * SHARD:
                    yield done()
                held.append(part)
        if held:
            yield done()

    rest = cut.where(F.col("kind") == _REST_ROW).select("doc_id", "start", "doc_tokens", "ids")
    rest = rest.mapInArrow(tidy(_sketched(table)), "doc_id long, start long, doc_tokens long, ids binary, sketch long").withColumn("tie", F.xxhash64("doc_id", "start", "ids"))
    # Tasks by bytes, no more than the session's partitions as long as these are small enough. Ties of the sketch, such as a large group of copies, are split by a hash of the row.
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(usual, round(n / SHARD)), -(-2 * rests // TASK_BYTES))
    dealt = rest.repartitionByRange(tasks, "sketch", "tie").sortWithinPartitions("sketch", "tie")
    pieces = dealt.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(tidy(shards), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, number long, offset long")
    pieces = pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", ((F.spark_partition_id().cast("long") * (1 << 33) + F.col("number")) * 2 + 1).alias("sequence_id"), "offset")
    return windows.unionByName(pieces)


def sequences(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per sequence: sequence_id, length, pieces (array of doc_id, start, length by offset).

    Pieces are those of ``packed``, with its edge cases; a sequence has at most WINDOW pieces, however long its texts are.
    """
    piece = F.struct("offset", "doc_id", "start", "length")
    rows = packed(docs, path).groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    return rows.select("sequence_id", "length", "pieces")


def piece_columns(docs: DataFrame) -> DataFrame:
    return plain_columns(packed(docs), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
