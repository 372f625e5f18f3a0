"""Secret scan: all rules in one minimal automaton, compiled backwards, mark in a single byte pass where matches begin.

A text is read from its end, so the automaton reports every place where a match of some rule begins. From the
leftmost of these a rule's own forward automaton runs to the longest match's end; the next match begins at or after
it. That gives leftmost non-overlapping spans, and a text without a place is never looked at again. Lengths are
checked on the spans: counted in the automaton, those of several rules would multiply its states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, plain_columns
from .dfa import Anchored, Dfa, compiled, places


def _assigned(span: bytes) -> bool:
    """Whether the value after the first colon or equals sign has 12 characters or more."""
    at = min(i for i in (span.find(b":"), span.find(b"=")) if i >= 0)
    value = span[at + 1 :].lstrip(b" ")
    return len(value) - (value[:1] in (b'"', b"'")) >= 12


@dataclass(frozen=True)
class Kind:
    """name; the rule; whether a match counts."""

    name: str
    rule: str
    counts: Callable[[bytes], bool] = lambda span: True
    base: bool = False


KINDS = [
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", _assigned, True),
    Kind("access", "AKIA[A-Z0-9]+", lambda span: len(span) >= 18, True),
    Kind("hex", "[0-9a-f]{16,}", base=True),
    Kind("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Kind("forge_token", "gh[oprsu]_[A-Za-z0-9]+", lambda span: len(span) >= 34),
    Kind("chat_token", "xox[abprs]-[A-Za-z0-9-]+", lambda span: len(span) >= 15),
    Kind("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", lambda span: min(map(len, span[3:].split(b"."))) >= 8),
]


@cache
def _automata() -> tuple[Dfa, list[Anchored]]:
    return compiled([k.rule for k in KINDS], backwards=True), [Anchored(k.rule) for k in KINDS]


def _spans(data: bytes, at: np.ndarray, bits: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in bytes, by start and then kind, from the places where matches begin."""
    found = []
    for n, kind in enumerate(KINDS):
        begin = at[bits >> n & 1 == 1]
        i = 0
        while i < len(begin):
            start = int(begin[i])
            end = _automata()[1][n].longest(data, start)
            if kind.counts(data[start:end]):
                found.append((start, n, end))
            i = int(np.searchsorted(begin, end))
    return sorted(found)


def _code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if data.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)])
    return [(int(before[a]), n, int(before[b])) for a, n, b in spans]


def batch_spans(batch: pa.RecordBatch, column: str = "text") -> list[list[tuple[int, int, int]]]:
    """(start, kind's number, end) in code points of each row's text, by start and then kind."""
    col = batch.column(batch.schema.get_field_index(column)).fill_null("")
    col = col.cast(pa.large_binary())
    bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    at, bits = places(_automata()[0], data[::-1], len(data) - bounds[1:], np.diff(bounds))
    at, bits = len(data) - 1 - at[::-1], bits[::-1]
    cut = np.searchsorted(at, bounds)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(col))]
    for i in np.flatnonzero(np.diff(cut)).tolist():
        text, a, b = data[bounds[i] : bounds[i + 1]].tobytes(), cut[i], cut[i + 1]
        out[i] = _code_points(text, _spans(text, at[a:b] - bounds[i], bits[a:b]))
    return out


def _mapped(docs: DataFrame, schema: str, row: Callable[[list[tuple[int, int, int]]], tuple], names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 8 << 20):
                rows = [row(x) for x in batch_spans(batch)]
                cols = [pa.array(list(c)) if any(x is not None for x in c) else pa.nulls(len(c), pa.string()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *names])

    return plain_columns(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, {schema}")


def _digest(spans: list[tuple[int, int, int]]) -> tuple:
    told = [f"{KINDS[n].name}:{a}:{b}" for a, n, b in spans]
    base = ",".join(x for x, (_, n, _) in zip(told, spans, strict=True) if KINDS[n].base)
    count = [sum(n == k for _, n, _ in spans) for k in range(3)]
    return *count, hashlib.sha256(base.encode()).hexdigest(), ",".join(told)


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row.

    A null or empty text has no spans, and the digest is that of the empty string; repeated rows are told each; an empty table gives no
    rows; other columns aren't looked at. A text of any length is scanned whole, in time that grows with it.
    """
    return _mapped(docs, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", _digest, ["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per finding: doc_id, kind, start, end (code points, end exclusive), found (the text there).

    A null or empty text has none; repeated rows are told each; an empty table gives no rows; other columns of
    the table, whatever their names, are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 8 << 20):
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                rows = [(ids[i], KINDS[n].name, a, b, texts[i].as_py()[a:b]) for i, s in enumerate(batch_spans(batch)) for a, n, b in s]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "kind", "start", "end", "found"])

    return plain_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, kind string, start long, end long, found string")
