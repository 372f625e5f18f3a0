"""Licence scan: one Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser evaluates expressions.

Texts are reduced to their words, single spaces between, so that a phrase is found where its words stand
consecutively. An identifier tag's expression (``MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)``)
is read from the text itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, plain_columns, text_bytes, texts

#: Phrases that count as base places, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: More notices. What a label permits: 1 anything, 0 nothing.
NOTICES = {
    "lesser general public license": "lgpl", "affero general public license": "agpl", "mozilla public license": "mpl",
    "bsd license": "bsd", "2 clause bsd": "bsd", "3 clause bsd": "bsd", "isc license": "isc", "public domain": "public-domain", "unlicense": "public-domain",
    "creative commons zero": "cc0", "cc0": "cc0", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc", "cc by nc nd": "cc-by-nc",
    "all rights reserved": "reserved",
}
#: Licences told by their identifiers alone, each with what it permits.
OTHERS = {
    "zlib": 1.0, "libpng": 1.0, "bsl": 1.0, "wtfpl": 1.0, "ncsa": 1.0, "postgresql": 1.0, "x11": 1.0, "curl": 1.0, "python": 0.95, "psf": 0.95, "ruby": 0.9, "ms-pl": 0.9, "artistic": 0.8, "afl": 0.9, "ofl": 0.8,
    "epl": 0.6, "cddl": 0.6, "cpl": 0.6, "ipl": 0.6, "eupl": 0.4, "osl": 0.4, "ms-rl": 0.5, "odbl": 0.4, "sspl": 0.1, "busl": 0.0,
}
PERMITS = {"mit": 1.0, "apache": 0.95, "bsd": 1.0, "isc": 1.0, "public-domain": 1.0, "cc0": 1.0, "cc-by": 0.9, "mpl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "reserved": 0.0}
TAG = "spdx license identifier"
#: Prefixes of identifiers, the longest that fits counts.
FAMILIES = {"mit": "mit", "apache": "apache", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "unlicense": "public-domain", "cc0": "cc0", "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "mpl": "mpl", "lgpl": "lgpl", "gpl": "gpl", "agpl": "agpl"}
FAMILIES |= {name: name for name in OTHERS}
PERMITS |= OTHERS
#: An exception loosens what the licence asks for; these are exceptions whose names don't say so.
WITH_GAIN = 0.3
NOTES = ("linux-syscall-note", "gpl-cc-1.0", "shl-2.0", "shl-2.1")
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A tag wherever its three words stand consecutively, and the rest of the line. No part can take what the next needs, so a search is linear.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_EXPRESSION = re.compile(rf"(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?ia:spdx){_GAP}+(?ia:license){_GAP}+(?ia:identifier)[ \t]*[:=]?[ \t]*([A-Za-z0-9.+\-() \t]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+\-]+")


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


def postfix(expression: str) -> list[str]:
    """Shunting-yard: with binds tighter than and, and tighter than or; raises ValueError on a malformed expression."""
    rank = {"or": 1, "and": 2, "with": 3}
    out, stack, operand = [], [], True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if operand != (token == "(" or (low not in rank and token != ")")):
            raise ValueError(f"unexpected {token!r}")
        if token == "(":
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("unexpected ')'")
            stack.pop()
        elif low in rank:
            while stack and rank.get(stack[-1], 0) >= rank[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            out.append(token)
            operand = False
    if operand or "(" in stack:
        raise ValueError("the expression ends early")
    return out + stack[::-1]


def family(identifier: str) -> str | None:
    low = identifier.lower()
    fits = [p for p in FAMILIES if low == p or low.startswith(p + "-")]
    return FAMILIES[max(fits, key=len)] if fits else None


def is_exception(identifier: str) -> bool:
    low = identifier.lower()
    return "exception" in low.split("-") or low in NOTES


def evaluated(expression: str) -> tuple[set[str], float]:
    """Labels named, and what the expression permits: or takes the freer side, and the stricter, with a known exception adds WITH_GAIN.

    An identifier of no known family is a label of its own, in lower case, and permits 0.5; what follows with is none.
    """
    stack: list[tuple[str, float, set[str]]] = []
    for token in postfix(expression):
        if token in ("or", "and", "with"):
            (right, b, named), (_, a, others) = stack.pop(), stack.pop()
            if token == "with":
                stack.append(("", min(1.0, a + WITH_GAIN * is_exception(right)), others))
            else:
                stack.append(("", max(a, b) if token == "or" else min(a, b), named | others))
        else:
            name = family(token)
            stack.append((token, PERMITS[name] if name else 0.5, {name or token.lower()}))
    return stack[0][2], stack[0][1]


def _trimmed(raw: str) -> str:
    """The words of a tag's line that still belong to the expression."""
    tokens, operand, depth, keep = _TOKEN.findall(raw), True, 0, 0
    for i, token in enumerate(tokens):
        op = token.lower() in ("or", "and", "with")
        if operand != (token == "(" or (not op and token != ")")) or (token == ")" and not depth):
            break
        depth += (token == "(") - (token == ")")
        operand = op or token == "("
        if not operand and not depth:
            keep = i + 1
    return " ".join(tokens[:keep])


def scanned(data: bytes, text: str | None = None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = data.translate(_WORDS).split()
    line = b" ".join([b"", *words, b""]).decode("latin-1")  # a byte a character: what is found counts words alone
    places, labels, base, tags = [], set(), set(), False
    stated: dict[int, str] = {}  # where a statement ends, the longest that does
    counted, seen = 0, 0  # words that begin before the place counted last
    for end, phrase in _automaton().iter(line):
        if phrase != TAG and len(phrase) > len(stated.get(end, "")):
            stated[end] = phrase
        if phrase in BASE:
            at = end - len(phrase) - 1
            seen += line.count(" ", counted, at) if at >= counted else -line.count(" ", at, counted)
            counted = at
            places.append(seen)
            base.add(BASE[phrase])
        elif phrase == TAG:
            tags = True
        else:
            labels.add(NOTICES[phrase])
    labels |= base
    # What the strictest statement permits, notice or tag; 0.5 where a text states nothing.
    # A notice that ends with a base phrase (lesser general public license) counts in its place.
    permits = [PERMITS[BASE.get(x) or NOTICES[x]] for x in set(stated.values())]
    if tags:
        for m in _EXPRESSION.finditer(text if text is not None else data.decode()):
            if exp := _trimmed(m[1].rstrip(".")):
                named, free = evaluated(exp)
                labels |= named
                permits.append(free)
    score = min(permits, default=0.5)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), float(score)


_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Words are counted from 0; first_word and last_word are null without a base place. score is what the strictest
    statement permits (1: anything, 0: nothing), 0.5 without one; a malformed tail of a tag's line is left out. A
    null text is empty; repeated rows are told each; an empty table gives no rows; other columns aren't looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                rows = list(zip(*map(scanned, text_bytes(batch)), strict=True))
                cols = [pa.array(list(c), t) for c, (_, t) in zip(rows, _FIELDS, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *(n for n, _ in _FIELDS)])

    return plain_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def license_tags(docs: DataFrame) -> DataFrame:
    """One row per identifier tag: doc_id, start (code points), expression, labels, permits.

    A null text has none, repeated rows are told each, and an empty table gives no rows; a tag and its expression stand on one line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                rows = []
                for i, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                    for m in _EXPRESSION.finditer(t):
                        if exp := _trimmed(m[1].rstrip(".")):
                            labels, free = evaluated(exp)
                            rows.append((i, m.start(), exp, ",".join(sorted(labels)), free))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
                cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "expression", "labels", "permits"])

    return plain_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, start long, expression string, labels string, permits double")
