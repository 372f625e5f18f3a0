"""Cases in which the operators once did less than the whole job."""

from __future__ import annotations

import random

from urbanspark.llm import exact_dedup, near, url_filters

DOCS = "doc_id long, text string"


def test_exact_dedup_stands_other_splits(spark, tmp_path, monkeypatch):
    """Between the two scans of the table its splits change, as when an executor is lost."""
    rows = [(i, f"text {i % 300}") for i in range(400)]
    spark.createDataFrame(rows, DOCS).repartition(16, "doc_id").write.parquet(str(tmp_path / "docs"))
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    plain = exact_dedup.maybe_broadcast

    def other_splits(df):
        out = plain(df)
        spark.conf.set(name, "1000")
        return out

    monkeypatch.setattr(exact_dedup, "maybe_broadcast", other_splits)
    try:
        got = sorted(r["doc_id"] for r in exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "docs"))).collect())
    finally:
        spark.conf.set(name, before)
    assert got == list(range(300))


def brute_near(rows):
    """Components of all pairs with a Jaccard similarity of 0.8 or more on five-word shingles."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def test_near_dedup_catches_pairs_from_similarity_0_8(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"

    def changed(t, times):
        out = t.split()
        for _ in range(times):
            out[rng.randrange(len(out))] = word()
        return " ".join(out)

    texts = [" ".join(word() for _ in range(rng.randrange(60, 200))) for _ in range(80)]
    texts += [changed(t, 1 + i % 6) for i, t in enumerate(texts)]
    texts += [changed(texts[0], 1 + i % 3) for i in range(60)] + [None, "", " ", "one", "one two", "One  two"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    label = brute_near(rows)
    got = [r["doc_id"] for r in near.near_dedup(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got) == [i for i in range(len(rows)) if label.index(label[i]) == i]
    assert len(got) < len(rows) - 60


def test_near_dedup_ids_repeated_and_null(spark):
    text = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    rows = [(5, text), (5, text + " end"), (5, other), (7, text + " stop"), (None, text + " last"), (None, "alone with no id"), (None, "alone"), (9, "the same row"), (9, "the same row")]
    got = sorted(map(str, near.near_dedup(spark.createDataFrame(rows, DOCS)).collect()))
    kept = [t for t in got if "w1 " in t]
    assert len(kept) == 1 and "doc_id=5" in kept[0]
    assert len(got) == 5 and sum(other in t for t in got) == 1 and sum("alone" in t for t in got) == 2 and sum("same row" in t for t in got) == 1
    assert near.near_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_url_targets_relative_and_repeated(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://x.com/a/b?q", link("/de/1")), (2, "http://y.net/a", link("//x.com/de/2")), (3, "http://x.com/de/c/d", link("../9")), (4, "http://x.com/q/r", link("../de/./3")),
        (5, "http://z.net/1", link("http://other.net/") + link("http://x.com/de/4")), (6, "http://z.net/2", '<meta http-equiv="refresh" content="0; url=//x.com/de/5">'),
        (7, "http://z.net/3", link("mailto:a@x.com")), (8, "http://z.net/4", link("/login?next=http://x.com/de/6")), (9, "nothing", link("/de/1")), (10, "http://x.com", link("de/7")),
        (11, "http://z.net/5/", link("../../../a/..")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    targets = {(r["source"], r["target"]) for r in url_filters.stated_targets(pages).collect()}
    assert ("http://x.com/q/r", "http://x.com/de/3") in targets and ("http://x.com/de/c/d", "http://x.com/de/9") in targets
    assert ("http://z.net/4", "http://z.net/login?next=http://x.com/de/6") in targets and ("http://z.net/5/", "http://z.net/") in targets
    assert not any(s in ("http://z.net/3", "nothing") for s, _ in targets)
    got = {r["page_id"]: r["verdict"] for r in url_filters.url_verdicts(pages).collect()}
    assert [i for i in got if got[i] == "block"] and {i for i in got if got[i] == "block"} == {1, 2, 3, 4, 5, 6, 10}


def test_texts_with_boilerplate_are_told_apart_by_rare_shingles():
    import time

    import numpy as np

    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 62, 70, dtype=np.uint64)
    made = [np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 30, dtype=np.uint64)])) for _ in range(2000)]
    made += [np.unique(np.concatenate([made[k][:95], rng.integers(0, 1 << 62, 4, dtype=np.uint64)])) for k in range(50)]
    sets, n = [x.view(np.int64) for x in made], len(made)
    prints = np.stack([np.frombuffer(near.set_fingerprint(x), np.uint64) for x in made])
    began = time.process_time()
    links = near.file_forest(np.arange(n), np.arange(n), np.zeros(n, int), np.array([len(x) for x in sets]), prints, sets)
    assert time.process_time() - began < 2 and {tuple(sorted(x)) for x in links} == {(k, 2000 + k) for k in range(50)}
