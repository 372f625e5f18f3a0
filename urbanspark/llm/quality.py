"""Quality classifier from weak labels.

Heuristic labellers vote bad, good or nothing on every document. Their votes form few patterns, so one partial
aggregate tells how often each occurs in the whole corpus. Expectation-maximisation on those counts estimates each
labeller's accuracy and the posterior of every pattern, without any given label. The posteriors train a linear
scorer on hashed features of the text, on a bounded sample; the scorer then judges every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, plain_columns, text_bytes, tidy, written

#: Features of the scorer, and documents it is trained on, at most.
BUCKETS, SAMPLE = 1 << 12, 6000
#: Documents below this score are rejected by a filter.
KEEP_FROM = 0.5
BAD, GOOD, NONE = 0, 1, 2
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_SYMBOLS = b"#$%&*|~^=<>{}[]\\@!_+"
#: Ends of sentences in several scripts.
_STOPS = [x.encode() for x in ".?。？؟।։"]
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 if b in b" \t\n\r\v\f" else b for b in range(256))
#: Function words of the corpus's languages.
_FUNCTION = frozenset(
    w.encode()
    for w in (
        "the of and to in a is that for it as was with be by on are this from or an at which not but have "
        "le la les de des du et un une en est que qui dans pour par sur au avec ce il pas "
        "der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als "
        "el los las y del que en un una por con no para su al lo se es"
    ).split()
)


@dataclass(frozen=True)
class Facts:
    """What the labellers and the scorer know of a text."""

    words: int
    letters: int
    upper: float
    repeats: float
    variety: float
    symbols: float
    stops: float
    function: float
    length: float
    lines: int
    same_lines: float
    latin: float


def facts(data: bytes) -> Facts:
    words = data.split()
    n = len(words)
    upper = len(data) - len(data.translate(None, _UPPER))
    lower = len(data) - len(data.translate(None, _LOWER))
    lines = [x for x in data.split(b"\n") if x.strip()]
    some = max(n, 1)
    return Facts(
        words=n,
        letters=upper + lower,
        upper=upper / max(upper + lower, 1),
        repeats=sum(map(eq, words, words[1:])) / max(n - 1, 1),
        variety=len(set(words)) / some**0.5,
        symbols=(len(data) - len(data.translate(None, _SYMBOLS))) / some,
        stops=sum(map(data.count, _STOPS)) / some,
        latin=(upper + lower) / max(len(data) - n, 1),
        function=sum(map(_FUNCTION.__contains__, data.lower().split())) / some,
        length=(len(data) - n) / some,
        lines=len(lines),
        same_lines=1 - len(set(lines)) / max(len(lines), 1),
    )


def _vote(known: bool, bad: bool, good: bool) -> int:
    return NONE if not known else BAD if bad else GOOD if good else NONE


#: The labellers. Most look for one defect and say nothing where they don't find it; two also vouch for a text.
LABELLERS = {
    "shouting": lambda f: _vote(f.letters >= 20, f.upper > 0.5, False),
    "stutter": lambda f: _vote(f.words >= 8, f.repeats > 0.2, False),
    "few_words": lambda f: _vote(f.words >= 40, f.variety < 2.5, False),
    "symbols": lambda f: _vote(f.words >= 8, f.symbols > 0.3, False),
    "sentences": lambda f: _vote(f.words >= 30, f.stops < 1 / 80, 1 / 40 < f.stops < 0.5),
    "function_words": lambda f: _vote(f.words >= 25 and f.latin > 0.5, f.function < 0.03, f.function > 0.1),
    "word_length": lambda f: _vote(f.words >= 10, not 2.0 < f.length < 15.0, False),
    "same_lines": lambda f: _vote(f.lines >= 4, f.same_lines > 0.4, False),
}


def pattern(f: Facts) -> int:
    """The votes as a number in base three, the first labeller lowest."""
    return sum(vote(f) * 3**i for i, vote in enumerate(LABELLERS.values()))


def votes_of(number: int) -> list[int]:
    return [number // 3**i % 3 for i in range(len(LABELLERS))]


def expectation_maximisation(counts: dict[int, int], rounds: int = 300) -> tuple[dict[int, float], dict[str, float]]:
    """Posterior of good for each pattern, and each labeller's accuracy where it votes.

    A labeller has a distribution over its three answers for either class, so silence tells something too. It
    starts from the majority of each pattern's votes, and a vote is never taken to speak for the other class, so
    that the classes can't change places.
    """
    keys = sorted(counts)
    if not keys:
        return {}, dict.fromkeys(LABELLERS, 0.5)
    n = np.array([counts[k] for k in keys], float)
    votes = np.array([votes_of(k) for k in keys])
    said = np.stack([votes == v for v in (BAD, GOOD, NONE)], axis=2).astype(float)
    lead = said[:, :, GOOD].sum(axis=1) - said[:, :, BAD].sum(axis=1)
    post = np.where(said[:, :, BAD].any(axis=1) & (lead <= 0), 0.1, np.where(lead > 0, 0.95, 0.7))
    shares = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        prior = np.clip(weight[GOOD].sum() / n.sum(), 0.01, 0.99)
        # An imagined vote of each kind keeps rare answers from being certain.
        shares = np.einsum("ck,kjv->cjv", weight, said) + 0.5
        shares /= shares.sum(axis=2, keepdims=True)
        gain = np.log(shares[GOOD] / shares[BAD])
        gain[:, BAD], gain[:, GOOD] = np.minimum(gain[:, BAD], 0.0), np.maximum(gain[:, GOOD], 0.0)
        log = np.log(prior / (1 - prior)) + np.einsum("kjv,jv->k", said, gain)
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    right = prior * shares[GOOD][:, GOOD] + (1 - prior) * shares[BAD][:, BAD]
    voted = prior * shares[GOOD][:, :NONE].sum(axis=1) + (1 - prior) * shares[BAD][:, :NONE].sum(axis=1)
    return dict(zip(keys, post.tolist(), strict=True)), dict(zip(LABELLERS, (right / voted).tolist(), strict=True))


_bucket: dict[bytes, int] = {}


def _hashed(name: bytes) -> int:
    if name not in _bucket:
        if len(_bucket) > 200_000:
            _bucket.clear()
        _bucket[name] = zlib.crc32(name) % BUCKETS
    return _bucket[name]


def features(data: bytes, f: Facts) -> tuple[list[int], list[float]]:
    """Hashed features: shares of word shapes and of pairs of them, and bands of the text's figures.

    A shape has a letter for each run of upper case, lower case or digits and every run of another sign.
    """
    out: dict[int, float] = {}
    raw = np.frombuffer(data.translate(_SHAPE), np.uint8)
    if len(raw):
        keep = np.ones(len(raw), bool)
        keep[1:] = raw[1:] != raw[:-1]
        shapes = raw[keep].tobytes().split()
        n = max(len(shapes), 1)
        for kind, counted in ((b"1", Counter(shapes)), (b"2", Counter(zip(shapes, shapes[1:], strict=False)))):
            for shape, k in counted.items():
                key = _hashed(kind + (shape if kind == b"1" else b" ".join(shape)))
                out[key] = out.get(key, 0.0) + k / n
    bands = (("r", min(f.repeats, 1.0) * 8), ("v", min(f.variety, 8.0)), ("s", min(f.symbols, 2.0) * 4), ("u", f.upper * 6), ("d", min(f.stops, 0.5) * 12), ("w", min(f.function, 0.6) * 12), ("l", min(f.length, 20.0) / 2), ("e", f.same_lines * 5))
    for name, value in bands:
        key = _hashed(f"b{name}{int(value)}{'+' if f.words >= 30 else '-'}".encode())
        out[key] = out.get(key, 0.0) + 0.5
    return list(out), list(out.values())


def trained(rows: list[tuple[list[int], list[float], float]], steps: int = 150, l2: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer (the last is the constant) for soft labels, by Adam on the whole sample."""
    w = np.zeros(BUCKETS + 1)
    if not rows:
        return w
    col = np.fromiter((c for r in rows for c in r[0]), np.int64)
    val = np.fromiter((v for r in rows for v in r[1]), float)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y, n = np.array([r[2] for r in rows]), len(rows)
    m, v = np.zeros_like(w), np.zeros_like(w)
    # Both classes weigh alike: junk is rare, and clean text must not be what is given up for it.
    weight = np.where(y >= 0.5, 0.5 / max(y.mean(), 0.02), 0.5 / max(1 - y.mean(), 0.02))
    for t in range(1, steps + 1):
        z = np.bincount(row, val * w[col], n) + w[-1]
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.append(np.bincount(col, val * d[row], BUCKETS), d.sum()) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


@dataclass
class Model:
    weights: np.ndarray
    posterior: dict[int, float]
    accuracy: dict[str, float]


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for whole in batches:
        for batch in chunks(whole, "text"):
            counts.update(pattern(facts(x)) for x in text_bytes(batch))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text"):
            known = [(x, facts(x)) for x in text_bytes(batch)]
            cols = [features(x, f) for x, f in known]
            yield pa.RecordBatch.from_arrays(
                [pa.array([pattern(f) for _, f in known], pa.int64()), pa.array([c for c, _ in cols], pa.list_(pa.int32())), pa.array([v for _, v in cols], pa.list_(pa.float64()))],
                ["pattern", "cols", "vals"],
            )


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts every document's votes; trains on ``sample`` distinct texts at most, chosen by a hash. The driver gets the patterns, 3**8 at most, and the sample's features."""
    only = plain_columns(docs, "text")
    rows = only.mapInArrow(tidy(_patterns), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counts = {r["pattern"]: r["n"] for r in rows}
    posterior, accuracy = expectation_maximisation(counts)
    # A bottom-k sample of distinct texts by hash: copies count once, and the bound holds whatever the texts are.
    n = sum(counts.values())
    share = min(1.0, 4 * sample / n) if n else 1.0
    ticked = only.withColumn("tick", F.xxhash64("text", F.lit(9)))
    if share < 1:
        few = ticked.where(F.pmod("tick", F.lit(1 << 30)) < int(share * (1 << 30)))
        ticked = few if few.select("tick").distinct().limit(sample).count() == sample else ticked  # many copies: look at all
    ticks = ticked.select("tick", F.pmod("tick", F.lit(1 << 30)).alias("order")).distinct().orderBy("order", "tick").limit(sample).select("tick")
    texts = ticked.join(F.broadcast(ticks), "tick").groupBy("tick").agg(F.first("text").alias("text")).select("text")
    drawn = written(texts.mapInArrow(tidy(_examples), "pattern long, cols array<int>, vals array<double>"), "quality-sample")
    examples = [(r["cols"], r["vals"], posterior.get(r["pattern"], 0.5)) for r in drawn.collect()]
    return Model(trained(examples), posterior, accuracy)


def _scores(data: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, list[int]]:
    out, numbers = np.zeros(len(data)), []
    for i, x in enumerate(data):
        f = facts(x)
        cols, vals = features(x, f)
        out[i] = weights[cols] @ vals + weights[-1]
        numbers.append(pattern(f))
    return 1 / (1 + np.exp(-np.clip(out, -30, 30))), numbers


def quality_scores(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score (1: good), predicted, posterior (of the weak labels), votes for every row.

    A null text counts as empty; nobody votes on a text without words, and its score follows from the constant and
    the empty bands. Repeated rows are scored alike; an empty table gives an empty result; other columns aren't looked at.
    """
    model = fitted(docs, sample)
    names = {BAD: "-", GOOD: "+", NONE: "0"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                score, numbers = _scores(text_bytes(batch), model.weights)
                posterior = [model.posterior.get(k, 0.5) for k in numbers]
                votes = ["".join(names[v] for v in votes_of(k)) for k in numbers]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(score >= KEEP_FROM).cast(pa.int32()), pa.array(posterior, pa.float64()), pa.array(votes, pa.string())], ["doc_id", "score", "predicted", "posterior", "votes"])

    return plain_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, posterior double, votes string")


def quality_filter(docs: DataFrame, sample: int = SAMPLE, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` with a score of ``keep_from`` or more, with their own columns, whatever their names.

    Scores are those of ``quality_scores``, with its edge cases: a null or empty text has the score of one without words, repeated rows
    stay or go together, an empty table stays empty. A text of any length is scored whole.
    """
    weights = fitted(docs, sample).weights
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole.rename_columns([f"c{i}" if i != at else "text" for i in range(whole.num_columns)]), "text"):
                score, _ = _scores(text_bytes(batch), weights)
                yield batch.filter(pa.array(score >= keep_from)).rename_columns(whole.schema.names)

    return docs.mapInArrow(tidy(run), docs.schema)
