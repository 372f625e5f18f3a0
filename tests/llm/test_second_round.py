"""Limits that were lifted, hot keys, and stages on odd tables."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from urbanspark.llm import exact_dedup, license_scan, mixing, near, packing, quality, secret_scan, toxicity, url_filters

from test_text_operators import DOCS, ODD

PAIRS = "doc_id long, text string"


# Licences


def test_license_scan_is_linear_and_takes_wide_tags():
    began = time.process_time()
    n = license_scan.scanned(b"SPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-2.0)\n" * 20_000)
    assert n[5] == "apache,gpl,mit" and n[6] == 1.0
    got = license_scan.scanned(b"the mit license x " * 20_000)
    assert got[1:4] == (20_000, 1, 4 * 19_999 + 1) and time.process_time() - began < 20
    assert license_scan.scanned(b"SPDX  -  License  -  Identifier: MIT")[5] == "mit"
    strict = license_scan.scanned(b"SPDX-License-Identifier: MIT\nAll rights reserved. GNU General Public License")
    assert strict[5:] == ("gpl,mit,reserved", 0.0)


# Secrets

_RULES = [
    (r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12), ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ("-----BEGIN [A-Z ]*PRIVATE KEY-----", lambda m: True), ("gh[oprsu]_[A-Za-z0-9]+", lambda m: len(m[0]) >= 34), ("xox[abprs]-[A-Za-z0-9-]+", lambda m: len(m[0]) >= 15),
    (r"eyJ([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)", lambda m: min(map(len, m.groups())) >= 8),
]


def brute_spans(text):
    return sorted((m.start(), n, m.end()) for n, (e, ok) in enumerate(_RULES) for m in re.finditer(e, text) if ok(m))


def test_secret_spans_of_all_kinds_on_generated_texts():
    import pyarrow as pa

    rng = random.Random(3)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", '"', "'", " ", ":", "=", "AKIA", "ABCDEF0123", "0123456789abcdef", "ab", "-----BEGIN ", "RSA ", "PRIVATE KEY", "-----", "ghp_", "xoxb-", "eyJ", ".", "abcdefghi", "é", "日", "\n", "Zz09", "-", "hunter2hunter2"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(5000)] + ["", "x" * 3000 + "0" * 5000, "token=" + "a" * 2000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(made))), pa.array(made)], ["doc_id", "text"])
    got = secret_scan.batch_spans(batch)
    assert got == [brute_spans(t) for t in made] and {n for s in got for _, n, _ in s} == set(range(7))
    assert secret_scan.batch_spans(batch.slice(100, 50)) == got[100:150]


# Toxicity


def test_lexicon_of_every_script_and_in_parts():
    one = toxicity.Lexicon(["idiot", "한국바보놈", "漢字語罵", "scum"], ["achlich"])
    assert one.kinds(["한국바보놈", "漢字語罵", "漢字語", "한국바보", "idi0t", "1diot", "sc*m", "achlichten", "calm"]).tolist() == [3, 3, 1, 1, 1, 1, 1, 2, 0]
    rng = random.Random(1)
    terms = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(4, 8))) for _ in range(30)})
    whole, parts = toxicity.Lexicon(terms, ["bad"]), toxicity.Lexicon(terms, ["bad"], limit=150)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + terms
    assert len(whole.parts) == 1 and len(parts.parts) > 2
    assert whole.kinds(words).tolist() == parts.kinds(words).tolist()


def test_quotation_at_any_distance_and_words_after():
    hits = {"idiot": toxicity.EXACT}
    aside = lambda t: toxicity.text_features(t, t.lower(), hits)[3] > 0
    assert aside("he cried “" + "so " * 500 + "idiot”") and not aside("he cried “" + "so " * 500 + "” idiot")
    assert not aside('one " here\nidiot') and aside("idiot is the word") and not aside("idiot a b c d e word")


@pytest.fixture(scope="module")
def labelled(spark):
    """Toxic texts on two thirds of which each term stands, a rare term, and copies of one text."""
    rng = random.Random(8)
    clean = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}ra" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(60)] = "grobbel" if i % 20 == 0 else rng.choice(["idiot", "scum", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, PAIRS), spark.createDataFrame(labels, "doc_id long, toxic int"), rows


def test_misspelled_toxic_texts_are_caught(spark, labelled):
    docs, labels, rows = labelled
    model = toxicity.fitted(docs, labels)
    assert {"idiot", "scum", "moron", "grobbel"} <= set(model.terms)
    plain = rows[1][1]
    texts = [plain, plain + " you idiott", plain + " you idi0t", plain + " sc*m", plain + " grobbell", None, ""]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(spark.createDataFrame(list(enumerate(texts)), PAIRS), model).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0}


def test_toxicity_stands_odd_tables(spark, labelled):
    _, labels, _ = labelled
    odd = spark.createDataFrame(ODD, DOCS)
    clash = odd.selectExpr("*", "1 as toxic", "'x' as id", "2.0 as score", "'y' as tick")
    a, b = (sorted(map(str, toxicity.toxicity_scores(t, labels).collect())) for t in (odd, clash))
    assert a == b and len(a) == len(ODD)
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.toxicity_scores(empty, labels).count() == 0 and toxicity.toxicity_scores(odd, labels.limit(0)).count() == len(ODD)


# Packing


def test_shard_scores_are_bm25_of_all_words():
    rng = np.random.default_rng(4)
    texts = [rng.zipf(1.3, rng.integers(5, 400)).clip(1, 5000).astype(np.uint16) for _ in range(300)]
    df = np.zeros(1 << 16)
    for t in texts:
        df[np.unique(t)] += 1
    idf, mean = np.where(df > 0, np.log(1 + (300 - df + 0.5) / (df + 0.5)), 0).astype(np.float32), 200.0
    shard, sizes = packing.Shard(texts, idf, mean), np.array([len(t) for t in texts])
    used = set(range(0, 220)) | {250}
    for i in sorted(used):
        shard.use(i)

    def score(seed, other):
        out = 0.0
        for t in set(texts[seed].tolist()):
            tf = int((texts[other] == t).sum())
            out += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(texts[other]) / mean))
        return out

    for seed in (3, 250):
        got = list(shard.neighbours(seed, sizes, 1 << 30))
        want = {i: score(seed, i) for i in range(300) if i not in used}
        assert sorted(got) == sorted(want) and np.allclose([want[i] for i in got], sorted(want.values(), reverse=True), rtol=1e-4)


def test_packing_tasks_do_not_grow_with_rows(spark, monkeypatch):
    seen = []
    plain = type(spark.range(1)).repartitionByRange
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda self, n, *c: seen.append(n) or plain(self, n, *c))
    docs = spark.range(30_000).selectExpr("id as doc_id", "concat('a b c ', id % 7) as text")
    out = packing.packed(docs)
    assert max(seen) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert out.selectExpr("sum(length) as n").first()["n"] == docs.count() * out.first()["doc_tokens"]


# Mixing


def test_mixing_report_against_plain_computation(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = mixing.mixing_report(docs).collect()
    size, of = {}, {}
    for r in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        of[r["doc_id"]], size[r["source"]] = (r["source"], n), size.get(r["source"], 0) + n
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, rest, left = {}, set(order), 1.5 * sum(size.values())
    while rest:
        level = left / sum(weight[s] for s in rest)
        full = {s for s in rest if weight[s] * level > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} if full else {s: weight[s] * level for s in rest}
        left, rest = left - sum(2 * size[s] for s in full), rest - full if full else set()
    taken: dict = {}
    for r in got:
        s, n = of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, size[s]) and abs(r["target"] - target[s]) < 1e-6 * max(target[s], 1) and r["taken"] <= 2 * n
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(n for t, n in of.values() if t == s) for s in order)


def test_mixing_repeated_rows_share(spark):
    hot = spark.range(60_000).selectExpr("5L as doc_id", "'two words' as text", "'a' as source", "'x' as lang", "id as n_chars")
    docs = hot.unionByName(spark.range(3000).selectExpr("id + 10 as doc_id", "repeat('w ', cast(id % 5 as int)) as text", "if(id % 2 = 0, 'a', 'b') as source", "'x' as lang", "id as n_chars"))
    got = mixing.mixing_report(docs)
    assert got.count() == 63_000 and got.where("taken > 2 * size").count() == 0
    per = got.groupBy("target").sum("taken").collect()
    assert all(abs(r["target"] - r["sum(taken)"]) <= 4 for r in per)
    assert {r["taken"] for r in got.where("doc_id = 5").select("taken").distinct().collect()} <= {0, 2, 4}
    mix = mixing.mixed(docs)
    assert mix.where("doc_id = 5").count() * 2 == got.where("doc_id = 5").agg({"taken": "sum"}).first()[0]
    assert mix.count() == got.agg({"copies": "sum"}).first()[0]


# Quality


def test_quality_sample_is_bounded_whatever_the_copies(spark, monkeypatch):
    seen = []
    plain = quality.trained
    monkeypatch.setattr(quality, "trained", lambda rows, *a: seen.append(len(rows)) or plain(rows, *a))
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the hot text of all', concat('text number ', id % 900)) as text")
    assert quality.fitted(docs, 100).weights.shape and quality.fitted(docs, 5000).weights.shape
    assert seen[0] == 100 and seen[1] == docs.select("text").distinct().count()


def test_labellers_say_nothing_of_scripts_they_do_not_know():
    text = " ".join(f"{w}{v} городе{v}." for v in "абвгдежзик" for w in ("слово", "улица", "дом")).encode()
    votes = dict(zip(quality.LABELLERS, quality.votes_of(quality.pattern(quality.facts(text))), strict=True))
    assert quality.BAD not in votes.values()


# Urls


def test_url_components_against_brute_force(spark):
    rng = random.Random(2)
    urls = [f"http://h{i % 700}.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['fr', 'de', 'es', 'q'])}/{i % 900}" for i in range(2500)]
    pages = [(i, u, f'<link rel="canonical" href="{rng.choice(urls)}">' if rng.random() < 0.4 else "plain") for i, u in enumerate(urls)]
    moved = [(rng.choice(urls), rng.choice(urls)) for _ in range(400)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.url_verdicts(frame, redirects=spark.createDataFrame(moved, "source string, target string")).collect()}

    def rule(u):
        host, _, path = u.partition("://")[2].partition("/")
        fits = [(len(r), v) for v, r in url_filters.RULES if ("." + host).endswith("." + r.partition("/")[0]) and ("/" + path).startswith("/" + r.partition("/")[2])]
        return max(fits)[1] if fits else None

    up = {u: u for u in urls}

    def root(u):
        while up[u] != u:
            u = up[u]
        return u

    for a, b in [*moved, *((u, h.split('href="')[1][:-2]) for _, u, h in pages if "href" in h)]:
        up[root(a)] = root(b)
    said: dict = {}
    for u in urls:
        if v := rule(u):
            said[root(u)] = min(v, said.get(root(u), v))
    assert got == {i: rule(u) or said.get(root(u), "allow") for i, u in enumerate(urls)} and "block" in set(got.values())


def test_joins_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "BROADCAST_ROWS", 10)
    pages = spark.range(6000).selectExpr("id as page_id", "if(id % 2 = 0, concat('http://hot.net/p?q=', id), concat('http://h', id, '.net/')) as url", "if(id < 500, '<link rel=canonical href=http://x.com/de/1>', '') as html")
    got = url_filters.url_verdicts(pages)
    assert got.count() == 6000 and got.where("page_id % 2 = 0 and verdict = 'block'").count() == 3000 and got.where("page_id % 2 = 1 and verdict = 'block'").count() == 250


# Near copies


def test_near_files_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 3000)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(150):
        t = base[:]
        for _ in range(rng.randrange(6)):
            t[rng.randrange(100)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    from test_whole_job import brute_near

    label = brute_near(list(enumerate(texts)))
    got = sorted(r["doc_id"] for r in near.near_dedup(spark.createDataFrame(list(enumerate(texts)), PAIRS)).collect())
    assert got == [i for i in range(150) if label.index(label[i]) == i]


# Stages on odd tables

STAGES = {"exact": exact_dedup.exact_dedup, "near": near.near_dedup, "mixed": mixing.mixed, "quality": quality.quality_filter}


@pytest.mark.parametrize("name", STAGES)
def test_stages_stand_odd_clashing_and_empty_tables(name, spark):
    odd = spark.createDataFrame(ODD, DOCS)
    clash = odd.selectExpr("*", "1 as __row", "2 as __take", "'x' as row", "3 as size", "'y' as hash", "4 as tick", "5 as m")
    a = sorted(map(str, STAGES[name](odd).collect()))
    out = STAGES[name](clash)
    assert out.columns == clash.columns and sorted(map(str, out.select(*odd.columns).collect())) == a
    empty = STAGES[name](spark.createDataFrame([], DOCS))
    assert empty.columns == odd.columns and empty.count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    for name, rows in (("odd", ODD * 2), ("none", [])):
        spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = p.run(spark, str(tmp_path / name))
        assert (out.count() > 0) == bool(rows)
