"""Toxicity: a learned lexicon's trie intersected with Levenshtein automata, and scores of what stands around a hit.

Labelled rows that aren't held out teach which words and word beginnings mark toxic texts. Terms are chosen one
after another, each for the toxic texts that the earlier ones leave uncovered, so that words which only happen to
share a text with a term stay out. The terms' trie is intersected with the Levenshtein automaton of each position
(subset construction over trie node and edits) into one automaton, which all words of a batch run through side by
side. Signs and digits inside a word stand for letters that look alike, or for one letter each. A hit in quotation,
or reported, weighs less; a logistic function of a text's hits gives its score.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, plain_columns, texts, written

#: Labelled rows that the lexicon and the weights are fitted on, at most.
SAMPLE = 20_000
#: Texts that a term has to mark, and how purely. There is no cap on candidates or terms: the sample bounds them.
LEAST, PURITY = 3, 0.8
#: A term has to mark more toxic texts than chance does at this level, shared by all words in LEAST texts or more. Copies count once.
LEVEL = 0.05
#: Terms that each toxic text should be marked by, where it has so many.
DEPTH = 4
#: Lengths of word beginnings that may be terms; the least length of a term that is matched with one edit.
STEMS, FUZZY_FROM = (4, 5, 6, 7, 8), 4
#: Clean words within an edit of a term from which on it isn't matched with an edit: there the language has words of its own.
CROWDED = 3
#: What a misspelled term weighs at least, of what the term itself does. Training texts may have none.
FUZZY_WEIGHT = 0.9
#: Words before and after a hit that are looked at.
CONTEXT = 4
#: Letters, with signs and digits where letters stand on both sides.
_WORD = re.compile(r"[^\W\d_]+(?:[0-9@$*!#|+]+[^\W\d_]+)*")
_PLAIN = re.compile(r"[^\W\d_]+")
#: Letters that signs are put for.
_LOOK = str.maketrans("013457@$!|+", "oieastasilt")
_QUOTES = {"“": "”", "«": "»", "„": "“", '"': '"', "‘": "’"}
#: Words that report what somebody else said.
REPORTING = frozenset("said says wrote called calls quoted quote word words term dit écrit mot terme sagte schrieb wort begriff dijo escribió palabra término".split())
QUOTED_WEIGHT = 0.3
EXACT, STEM, FUZZY = 3, 2, 1


class TooLarge(ValueError):
    """An automaton with more states than it may have."""


class LexiconAutomaton:
    """Words within one edit of a term, or beginning with a stem: table[state, letter]; best[state] is what a word ending there is."""

    def __init__(self, terms: list[str], stems: list[str], limit: int = 20_000, exact: frozenset[str] = frozenset(), fuzzy_from: int = 5) -> None:
        letters = sorted({c for w in [*terms, *stems] for c in w})
        self.letters = {c: i for i, c in enumerate(letters)}
        other, n = len(letters), len(letters) + 1
        children: list[dict[int, int]] = [{}]
        term_at, stem_at, fuzzy = [False], [False], [False]
        for w, is_stem in [*((t, False) for t in terms), *((s, True) for s in stems)]:
            node = 0
            for c in (self.letters[c] for c in w):
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    term_at.append(False)
                    stem_at.append(False)
                    fuzzy.append(False)
                node = children[node][c]
            term_at[node], stem_at[node] = term_at[node] or not is_stem, stem_at[node] or is_stem
            fuzzy[node] = fuzzy[node] or (not is_stem and len(w) >= fuzzy_from and w not in exact)
        # Only ways that lead to a term matched with an edit are followed with one.
        useful = fuzzy[:]
        for node in range(len(children) - 1, -1, -1):
            useful[node] = useful[node] or any(useful[c] for c in children[node].values())

        def closed(items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            more = {(c, 1) for node, e in items if e == 0 for c in children[node].values() if useful[c]}  # a letter left out
            return frozenset(items | more)

        grown = (-1, 0)  # within a word that began with a stem
        start = closed({(0, 0)})
        ids, order, table = {start: 0}, [start], []
        for state in order:
            row = []
            for letter in range(n):
                to: set[tuple[int, int]] = {grown} if grown in state else set()
                for node, e in state:
                    if node < 0:
                        continue
                    if (child := children[node].get(letter)) is not None and (e == 0 or useful[child]):
                        to.add((child, e))
                        if e == 0 and stem_at[child]:
                            to.add(grown)
                    if e == 0:
                        if useful[node]:
                            to.add((node, 1))  # a letter too many
                        to |= {(c, 1) for c in children[node].values() if useful[c]}  # another letter
                key = closed(to)
                if key not in ids:
                    if len(order) >= limit:
                        raise TooLarge
                    ids[key] = len(order)
                    order.append(key)
                row.append(ids[key])
            table.append(row)
        self.table = np.array(table, np.int32).ravel()
        self.width, self.other = n, other
        self.best = np.array([max([EXACT if e == 0 and node >= 0 and term_at[node] else STEM if node < 0 else FUZZY if e and fuzzy[node] else 0 for node, e in s], default=0) for s in order], np.int8)

    def kinds(self, words: list[str]) -> np.ndarray:
        """What each word is, all words a letter at a time."""
        if not words:
            return np.zeros(0, np.int8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        alphabet = np.array([ord(c) for c in self.letters], np.uint32)  # in order
        letter = np.minimum(np.searchsorted(alphabet, code), max(len(alphabet) - 1, 0)).astype(np.int32)
        letter = np.where(alphabet[letter] == code, letter, self.other) if len(alphabet) else np.full(len(code), self.other, np.int32)
        order = np.argsort(-size, kind="stable")
        pos, size_sorted = (np.cumsum(size) - size)[order], size[order]
        state = np.zeros(len(words), np.int32)
        for k in np.searchsorted(-size_sorted, -np.arange(int(size_sorted[0])), side="left").tolist():
            state[:k] = self.table.take(state[:k] * self.width + letter[pos[:k]])
            pos[:k] += 1
        out = np.empty(len(words), np.int8)
        out[order] = self.best[state]
        return out


class Lexicon:
    """As many automata as it takes to keep each within its limit; a word is the most that any says of it."""

    def __init__(self, terms: list[str], stems: list[str], limit: int = 20_000, exact: frozenset[str] = frozenset()) -> None:
        try:
            self.parts = [LexiconAutomaton(terms, stems, limit, exact, FUZZY_FROM)]
        except TooLarge:
            if len(terms) + len(stems) < 2:
                raise
            halves = [Lexicon(terms[i::2], stems[i::2] if len(terms) > 1 else [*stems][1 - i :: 2], limit, exact) for i in (0, 1)]
            self.parts = halves[0].parts + halves[1].parts

    def kinds(self, words: list[str]) -> np.ndarray:
        """What each word is. One with signs or digits in it is a misspelling at most: as it stands, or read as the letters they look like."""
        out = np.zeros(len(words), np.int8)
        for part in self.parts:
            out = np.maximum(out, part.kinds(words))
        odd = [i for i, w in enumerate(words) if not w.isalpha() and _PLAIN.fullmatch(w) is None]
        if odd:
            read = [words[i].translate(_LOOK) for i in odd]
            for part in self.parts:
                out[odd] = np.maximum(out[odd], part.kinds(read))
            out[odd] = np.minimum(out[odd], FUZZY)
        return out


@dataclass
class Model:
    """Terms, word beginnings, weights; words of clean texts that only look like misspelled terms, and terms with many such."""

    terms: list[str]
    stems: list[str]
    weights: list[float]
    clean: frozenset[str] = frozenset()
    exact: frozenset[str] = frozenset()
    automaton: Lexicon | None = field(default=None, repr=False)

    def ready(self) -> Lexicon:
        if self.automaton is None:
            self.automaton = Lexicon(self.terms, self.stems, exact=self.exact)
        return self.automaton

    def kinds(self, words: list[str]) -> dict[str, int]:
        """What those words are that are anything."""
        kinds = self.ready().kinds(words)
        return {words[i]: int(kinds[i]) for i in np.flatnonzero(kinds).tolist() if not (kinds[i] == FUZZY and words[i] in self.clean)}


#: Of a text: exact, stem and fuzzy hits outside quotation, hits in it, share of hits among its words; each damped.
N_FEATURES = 6


_MARKS = re.compile("[\n" + "".join(sorted({*_QUOTES, *_QUOTES.values()})) + "]")


def _quoted(text: str, places: list[int]) -> list[bool]:
    """For each place (rising) whether a quotation mark opened earlier in its line is still open; one pass over the marks."""
    out, opened, at = [], dict.fromkeys(_QUOTES, False), 0
    marks = [(m.start(), m.group()) for m in _MARKS.finditer(text)]
    for place in places:
        while at < len(marks) and marks[at][0] < place:
            sign = marks[at][1]
            at += 1
            if sign == "\n":
                opened = dict.fromkeys(_QUOTES, False)
                continue
            for a, b in _QUOTES.items():
                if sign == a:
                    opened[a] = not opened[a] if a == b else True
                elif sign == b:
                    opened[a] = False
        out.append(any(opened.values()))
    return out


def text_features(text: str, low: str, hits: dict[str, int]) -> np.ndarray:
    """Features of one text, given what its words are (only hits are in ``hits``)."""
    out, spans = np.zeros(N_FEATURES), [(m.start(), m.group()) for m in _WORD.finditer(low)]
    found = [i for i, (_, word) in enumerate(spans) if word in hits]
    quoted = _quoted(text if len(low) == len(text) else low, [spans[i][0] for i in found])
    for i, inside in zip(found, quoted, strict=True):
        aside = inside or any(w in REPORTING for _, w in spans[max(0, i - CONTEXT) : i + CONTEXT + 1])
        out[3 if aside else {EXACT: 0, STEM: 1, FUZZY: 2}[hits[spans[i][1]]]] += 1
    total = out[:4].sum() - (1 - QUOTED_WEIGHT) * out[3]
    damped = 1 - np.exp(-2 * out)  # the first hit says most
    damped[4], damped[5] = min(1.0, 10 * total / max(1, len(spans))), 1.0
    return damped


def batch_features(model: Model, strings: list[str]) -> np.ndarray:
    lows = [t.lower() for t in strings]
    words = [set(_WORD.findall(t)) for t in lows]
    hits = model.kinds(list(set().union(*words)))
    out = np.zeros((len(strings), N_FEATURES))
    out[:, 5] = 1.0
    for i, own in enumerate(words):
        if not hits.keys().isdisjoint(own):
            out[i] = text_features(strings[i], lows[i], hits)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of the distinct texts of at most ``sample`` labelled ids that aren't held out, chosen by a hash of the id.

    The chosen labels, two numbers a row, are within the bound, so they are broadcast; only the sample's own texts are
    shuffled, where equal ones become one. Rows of ``docs`` that repeat an id all count.
    """
    rows = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    rows = rows.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = written(rows, "toxic-labels")
    n = rows.count()
    share = min(1.0, 0.95 * sample / n) if n else 1.0
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = docs.join(F.broadcast(rows.limit(sample)), docs["doc_id"] == F.col("id")).select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    # A text counts once, however many documents have it.
    return found.groupBy("text").agg(F.max("toxic").alias("toxic"))


def _stems(word: str) -> list[str]:
    return [word[:n] + "*" for n in STEMS if len(word) > n]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text", 16 << 20):
            counts: tuple[Counter, Counter] = Counter(), Counter()
            for t, toxic in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
                words = set(_PLAIN.findall(t.lower()))
                counts[toxic == 1].update(words | {s for w in words for s in _stems(w)})
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["term", "pos", "neg"])


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon and weights. Only bounded tables reach the driver: candidates, and the sample's hits and features."""
    # Never more than the sample's distinct texts.
    train = written(training_rows(plain_columns(docs, "doc_id", "text"), labels, sample).repartition(32), "toxic-train")
    sums = train.groupBy("toxic").count().collect()
    pos_docs = sum(r["count"] for r in sums if r["toxic"] == 1)
    neg_docs = sum(r["count"] for r in sums) - pos_docs
    if not pos_docs or not neg_docs:
        return Model([], [], [0.0] * (N_FEATURES - 1) + [-4.0 if neg_docs or not pos_docs else 4.0])
    counts = train.mapInArrow(_term_counts, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pure = F.col("pos") * neg_docs / (F.col("pos") * neg_docs + F.col("neg") * pos_docs + 1.0)
    rate = pos_docs / (pos_docs + neg_docs)
    counts = written(counts.where(F.col("pos") + F.col("neg") >= LEAST), "toxic-terms")
    seen = counts.count()
    clear = lambda p, n: _by_chance(p, n, rate) * seen < LEVEL
    # What isn't clear on its own can't be what it adds to others; the rest are words of toxic texts of the sample.
    candidates = sorted(r["term"] for r in counts.where(F.col("pos") >= LEAST).where(pure >= PURITY).collect() if clear(r["pos"], r["neg"]))
    chosen = _cover(train, candidates, clear)
    terms, stems = [t for t in chosen if not t.endswith("*")], [t[:-1] for t in chosen if t.endswith("*")]
    model = Model(terms, stems, [])
    model.clean = _clean_words(train, model)
    model.exact = _crowded(model)
    model.automaton = None

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                x = batch_features(model, texts(batch))
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    rows = train.mapInArrow(features, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    x, y = np.array([r["x"] for r in rows]), np.array([float(r["toxic"] == 1) for r in rows])
    model.weights = _logistic(x, y, np.array([r["count"] for r in rows], float)).tolist()
    model.weights[2] = max(model.weights[2], FUZZY_WEIGHT * model.weights[0])
    model.automaton = None
    return model


def _by_chance(pos: int, neg: int, rate: float) -> float:
    """The probability that of pos + neg texts, each toxic at ``rate``, pos or more are."""
    n = pos + neg
    log = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate) for k in range(pos, n + 1)]
    return math.fsum(math.exp(x) for x in log)


def _clean_words(train: DataFrame, model: Model) -> frozenset[str]:
    """Words of clean training texts that the lexicon takes for misspelled terms: they are words of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                words = list(set().union(*(_WORD.findall(t.lower()) for t in texts(batch))))
                yield pa.RecordBatch.from_arrays([pa.array([w for w, k in model.kinds(words).items() if k == FUZZY], pa.string())], ["word"])

    return frozenset(r["word"] for r in train.where("toxic = 0").mapInArrow(run, "word string").distinct().collect())


def _crowded(model: Model) -> frozenset[str]:
    """Terms that CROWDED clean words or more share a spelling with, a letter left out of either."""
    cut = lambda w: {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}
    near: dict[str, set[str]] = {}
    for w in model.clean:
        for x in cut(w):
            near.setdefault(x, set()).add(w)
    return frozenset(t for t in model.terms if len(set().union(*(near.get(x, ()) for x in cut(t)))) >= CROWDED)


def _cover(train: DataFrame, candidates: list[str], clear: Callable[[int, int], bool]) -> list[str]:
    """Terms chosen greedily: most toxic texts that have under DEPTH of the chosen terms, less texts of the other kind.
    What a term adds must be ``clear`` (toxic texts, others), so that words which share texts with better terms stay out.

    Words of copied texts have the very same documents as each other; a set of documents that over three words of
    unlike beginnings share says nothing of any of them.
    """
    index = {c: i for i, c in enumerate(candidates)}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                found = []
                for t in texts(batch):
                    words = set(_PLAIN.findall(t.lower()))
                    found.append(sorted({index[k] for w in words for k in (w, *_stems(w)) if k in index}))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["found", "toxic"])

    rows = train.mapInArrow(hits, "found array<int>, toxic int").where(F.size("found") > 0).collect()
    pos: dict[int, set[int]] = {}
    neg: Counter = Counter()
    for n, r in enumerate(rows):
        for i in r["found"]:
            if r["toxic"] == 1:
                pos.setdefault(i, set()).add(n)
            else:
                neg[i] += 1
    heads: dict[frozenset[int], set[str]] = {}
    for i, p in pos.items():
        heads.setdefault(frozenset(p), set()).add(candidates[i][:4])
    pos = {i: p for i, p in pos.items() if len(heads[frozenset(p)]) <= 3 and clear(len(p), neg[i])}
    chosen: list[str] = []
    depth: Counter = Counter()

    def rank(i: int) -> tuple:
        # Of terms that gain alike the one that says most: a whole word before a beginning, a long one before a short one.
        return -(sum(depth[n] < DEPTH for n in pos[i]) - 2 * neg[i]), candidates[i].endswith("*"), -len(candidates[i]), i

    # Gains only shrink, so a term whose gain is still what it was when it was queued is the best.
    queue = [rank(i) for i in pos]
    heapq.heapify(queue)
    while queue:
        was = heapq.heappop(queue)
        i = was[-1]
        if i not in pos:
            continue
        if (now := rank(i)) != was:
            heapq.heappush(queue, now)
            continue
        if -was[0] < LEAST:
            break
        term, own = candidates[i], pos.pop(i)
        if not clear(sum(depth[n] < DEPTH for n in own), neg[i]):
            continue
        chosen.append(term)
        depth.update(own)
        # What begins with a chosen beginning is known, and a shorter beginning of a chosen term says no more.
        bare = term.rstrip("*")
        pos = {i: p for i, p in pos.items() if not (term.endswith("*") and candidates[i].startswith(bare)) and not (candidates[i].endswith("*") and bare.startswith(candidates[i][:-1]))}
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, count: np.ndarray, l2: float = 0.1) -> np.ndarray:
    """Newton's method on counted rows; the constant isn't held back."""
    w, keep = np.zeros(x.shape[1]), l2 * np.ones(x.shape[1])
    keep[-1] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (count * (p - y)) + keep * w
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + np.diag(keep), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null or empty text has the score of a text without hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(model.weights)
        for whole in batches:
            for batch in chunks(whole, "text"):
                z = batch_features(model, texts(batch)) @ w
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    rows = plain_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on ``labels`` (doc_id, toxic) and score every row of ``docs``.

    Inputs of a score are the text alone. Labels that are null, of unknown documents or held out teach nothing;
    several labels of a document, or of one text, count as toxic if one is. Without labels of both kinds every text has the same
    score. Repeated rows are scored each; an empty table gives an empty result; other columns aren't looked at.
    """
    return scored(docs, fitted(docs, labels, sample))


def explain(model: Model) -> str:
    return f"terms {model.terms} stems {model.stems} weights {[round(x, 3) for x in model.weights]} base {1 / (1 + math.exp(-model.weights[-1])):.4f}"
