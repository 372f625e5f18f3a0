"""FM-index decontamination, annulus clustering and source divergence against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanspark.llm import centroids, decontamination, divergence
from urbanspark.llm.fm_index import FMIndex, suffix_order

DOC = "doc_id long, text string, lang string, source string"
ITEM = "item_id long, text string"


# FM-index


def test_index_finds_every_place():
    rng = np.random.default_rng(1)
    for _ in range(100):
        sigma = int(rng.integers(2, 9))
        text = np.concatenate([x for _ in range(int(rng.integers(1, 12))) for x in (rng.integers(1, sigma, int(rng.integers(1, 30))), [0])]).astype(np.int32)

        def suffix(i, text=text):
            j = i + int(np.argmax(text[i:] == 0))
            return [*text[i:j].tolist(), 0], i

        assert suffix_order(text, sigma).tolist() == sorted(range(len(text)), key=suffix)
        index = FMIndex(text, sigma, int(rng.integers(1, 7)))
        patterns = [rng.integers(1, sigma, int(rng.integers(1, 5))) for _ in range(20)]
        rows, lengths = np.zeros((20, 5), np.int32), np.array([len(p) for p in patterns])
        for i, p in enumerate(patterns):
            rows[i, : len(p)] = p
        low, high = index.search(rows, lengths)
        for i, p in enumerate(patterns):
            want = [k for k in range(len(text) - len(p) + 1) if (text[k : k + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(low[i], high[i])).tolist()) == want


def test_index_of_copies_is_sorted_in_few_rounds():
    text = np.tile(np.random.default_rng(2).integers(1, 50, 2000), 100).astype(np.int32)
    text[::2000] = 0
    text[-1] = 0
    low, high = FMIndex(text, 50).search(text[None, 5:15], np.array([10]))
    assert high[0] - low[0] == 100


# Decontamination


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            for phrase in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else ():
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) == phrase:
                        hit.update(range(i, i + n))
                        if item is not None:
                            names.add(str(item))
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made_texts(n, seed):
    rng = random.Random(seed)
    items = [(i if i != 3 else None, " ".join(rng.choice("abcdé") for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(12)] + [(5, "a b c"), (20, None), (21, "  "), (22, "a-B,c")]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(8)):
            parts.append(rng.choice(items)[1] or "" if rng.random() < 0.5 else " ".join(rng.choice(["a", "b", "c", "d", "é", "zz", "Q"]) for _ in range(rng.randrange(20))))
        docs.append((i // 2, " ".join(parts).upper() if i % 5 == 0 else "\n".join(parts)))
    return [*docs, (None, "a b c"), (7, None), (8, ""), (9, "a b c d " * 3000)], items


@pytest.mark.parametrize("shard", [1, 50, 1 << 20])
def test_contamination_against_brute_force(spark, shard, monkeypatch):
    docs, items = made_texts(80, 4)
    monkeypatch.setattr(decontamination, "SHARD", shard)
    d = spark.createDataFrame([(*x, "en", 1) for x in docs], "doc_id long, text string, n_words string, items long").repartition(3)
    got = decontamination.contaminated_spans(d, spark.createDataFrame(items, ITEM), shard=shard)
    for r in got.collect():
        ends = [x for s in r["spans"] for x in (s["begin"], s["end"])]
        assert ends == sorted(set(ends)) and (not ends or ends[-1] <= r["n_words"])
    report = decontamination.contamination_report(d, spark.createDataFrame(items, ITEM))
    assert sorted(map(tuple, report.collect()), key=str) == brute_contamination(docs, items)


def test_items_in_blocks_give_the_same(spark):
    docs, items = made_texts(60, 5)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM)
    key = lambda r: (str(r["doc_id"]), r["n_words"], [tuple(s) for s in r["spans"]], sorted(r["items"]))
    whole = sorted(key(r) for r in decontamination.contaminated_spans(d, b).collect())
    assert sorted(key(r) for r in decontamination.contaminated_spans(d, b, block_bytes=40).collect()) == whole


def test_spans_are_cut_out_of_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before, {item.upper()}! After", 1), (2, "clean text", 2), (3, None, 3), (4, f"{item}. {item}", 4), (5, "éé — One  two\nthree four five six seven eight nine TEN end", 5)]
    got = decontamination.decontaminated(spark.createDataFrame(docs, "doc_id long, text string, __row long"), spark.createDataFrame([(1, item)], ITEM))
    assert got.columns == ["doc_id", "text", "__row"]
    assert {r[0]: r[1] for r in got.collect()} == {1: "Before, ! After", 2: "clean text", 3: None, 4: "", 5: "éé —  end"}


def test_contamination_of_empty_tables(spark):
    none, docs = spark.createDataFrame([], ITEM), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontamination.contamination_report(docs, none).collect()[0][2] == 0
    assert decontamination.contamination_report(docs.where("false"), spark.createDataFrame([(1, "a")], ITEM)).count() == 0


def test_contamination_of_a_long_text(spark):
    """20 MB in one text; the passage stands at its end."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("alpha beta gamma other word "), 750_000), F.lit(item)).alias("text"))
    got = decontamination.contamination_report(docs, spark.createDataFrame([(1, item)], ITEM)).collect()[0]
    assert got["n_words"] == 5 * 750_000 + 10 and got["n_hit"] == 10


# Centroids


def brute_clusters(rows, dim=4, k=3, rounds=5, seed=2):
    import math

    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for c in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            if mine:
                cents[c] = [math.floor(Fraction(sum(col), len(mine))) for col in zip(*mine, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for *_, d in out)
    return sorted(((i, c, d, sum(x[2] for x in out if x[1] == c), total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in out), key=str)


VEC = "vec_id long, embedding array<double>, v string, cluster int"


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_clusters_against_brute_force(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i % 90, (rng.integers(-3, 4, 4) / 8).tolist()) for i in range(100)]
    rows += [(200, None), (201, [1.0]), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan")] * 4), (204, [float("inf")] * 4), (205, [0.0] * 4), (206, [1e5, -1e5, 0.001, -0.001]), (None, [0.5] * 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VEC).repartition(5)
    got = centroids.clusters(df, dim=4, k=k)
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, k=k)


def test_clusters_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0] * 4, "", 0), (1, [1.0] * 4, "", 0)], VEC)
    assert sorted(map(tuple, centroids.clusters(df, dim=4).collect())) == brute_clusters([(1, [1.0] * 4)] * 2, k=40)
    assert centroids.clusters(df.where("false"), dim=4).count() == 0
    assert centroids.clusters(spark.createDataFrame([(1, [1e7] * 4, "", 0)], VEC), dim=4).count() == 0


def test_annulus_spares_comparisons_and_keeps_ties():
    rng = np.random.default_rng(5)
    cents = rng.integers(-200, 200, (50, 8)) * rng.integers(1, 40, (50, 1))
    cents[7] = cents[30]
    x = np.concatenate([cents + rng.integers(-20, 20, (50, 8)), (cents[:-1] + cents[1:]) // 2, -cents])
    at, best, n = centroids.Annulus(cents).nearest(x)
    full = ((x[:, None] - cents[None]) ** 2).sum(2)
    assert (at == full.argmin(1)).all() and (best == full.min(1)).all() and n < 0.7 * full.size


# Divergence


def brute_divergence(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in mine}}
        every = sum(count.values(), Counter())
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for s, c in count.items():
            pairs = [(o, sum(f(share(c, t), share(count[o], t)) for t in kept)) for o in count if o != s]
            terms = [(t, f(share(c, t), share(every, t))) for t in kept if c[t] and share(c, t) > share(every, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found[:most])]
    return sorted(out)


def odd_docs(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(12))).title() if i % 7 else None, rng.choice(["en", "en", "fr", None]), rng.choice(["a", "b", "b", "c", "d", "é", "E", "s1", "s2", "s3", None])) for i in range(n)]
    return [*rows, *rows[:20], (1, "rare1 2words", "xx", "only"), (2, "", "yy", "p"), (3, None, "yy", "q")]


@pytest.mark.parametrize("light", [0, 2, 64])
def test_divergence_against_brute_force(spark, light, monkeypatch):
    rows = odd_docs(light)
    heavy = divergence._heavy
    monkeypatch.setattr(divergence, "_heavy", lambda: F.lit(True) if light == 0 else F.lit(False) if light == 64 else heavy(light))
    monkeypatch.setattr(divergence, "HELD", 10)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOC + ", n string, term long").repartition(4)
    assert sorted(map(tuple, divergence.divergence_report(df).collect())) == brute_divergence(rows)


def test_divergence_tiles_of_few_sources_and_terms(spark, monkeypatch):
    rows = odd_docs(9)
    monkeypatch.setattr(divergence, "_heavy", lambda: F.lit(True))
    monkeypatch.setattr(divergence.tile_sums, "__defaults__", (3, 4))
    monkeypatch.setattr(divergence.base_sums, "__defaults__", (3,))
    got = divergence.divergence_report(spark.createDataFrame(rows, DOC), top=5)
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, top=5)


def test_divergence_of_an_empty_table_and_a_long_text(spark):
    assert divergence.divergence_report(spark.createDataFrame([], DOC)).count() == 0
    long = spark.range(3).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word other é "), 1_500_000).alias("text"), F.lit("en").alias("lang"), F.col("id").cast("string").alias("source"))
    got = divergence.divergence_report(long).collect()
    assert len(got) == 6 and all(r["value"] == 0 for r in got)
