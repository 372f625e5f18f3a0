"""Source divergence audit: how far word shares of the sources of a language lie apart, in exact integers.

The divergence of two sources sums a value over all kept terms of their language. Terms that many sources share are
dealt in blocks to dense numpy tiles (sources times terms). For all other terms the sum starts from the value of two
absent counts, known without a look at any term; a source's own counts correct it by a histogram, and terms that two
sources share correct it by pairs from the terms' short posting lists. Both partial sums are integers and add exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, plain_columns, text_bytes, tidy, written

UNIT = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
#: A term is heavy if it occurs in more sources of its language than this, or than a third of them: at most so many postings are listed for a light one.
LIGHT = 64
#: Sources a side and terms of a dense tile.
TILE_SOURCES, TILE_TERMS = 128, 512
#: Distinct (source, term) counts that a task keeps before it hands them on.
HELD = 400_000
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a term that stands ``n`` times in a group with ``total`` words of ``terms`` kept terms."""
    return F.call_function("div", F.lit(UNIT).cast("long") * (n + 1), total + terms) + 1


def value(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): below 1.1e18, so it fits into a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _value(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def source_terms(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed within a task; several rows a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in counts.items():
                terms = list(n)
                for a in range(0, len(terms), 50_000):
                    part = terms[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([d[t] for t in part], pa.int64())],
                        ["lang", "source", "term", "n", "docs"],
                    )

        for whole in batches:
            for batch in chunks(whole, "text"):
                for lang, source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch), strict=True):
                    own = Counter(data.translate(_LETTERS).split())
                    n, d = counts.setdefault((lang, source), (Counter(), Counter()))
                    size -= len(d)
                    n.update(own)
                    d.update(own.keys())
                    size += len(d)
                    if size >= held:
                        yield from out()
                        counts, size = {}, 0
        yield from out()

    rows = plain_columns(docs, "lang", "source", "text").select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    return rows.mapInArrow(tidy(run), "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, total, sources, tid) of terms in at least ``least`` documents of their language: occurrences in the source and in the language, sources that have it, a number of the term; written once.

    One shuffle by language and term serves the sums and the counts per term.
    """
    parts = source_terms(docs).repartition("lang", "term")
    sums = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("rid", F.monotonically_increasing_id())
    w = Window.partitionBy("lang", "term")
    every = sums.select("lang", "source", "term", "n", F.sum("n").over(w).alias("total"), F.sum("docs").over(w).alias("all_docs"), F.count("*").over(w).alias("sources"), F.min("rid").over(w).alias("tid"))
    return written(every.where(F.col("all_docs") >= least).drop("all_docs"), "kept-terms")


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, g, total, terms, lang_total, n_sources, light, base): every occurring group with a number of its own; base is p of an absent term; written once."""
    there = plain_columns(docs, "lang", "source").select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    rows = written(there.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")).withColumn("g", F.monotonically_increasing_id()), "groups")
    many = rows.groupBy("lang").agg(F.count("*").alias("n_sources"))
    # A term once: its total and its number of sources are the same in all its rows.
    terms = kept.groupBy("lang", "tid").agg(F.first("total").alias("total"), F.first("sources").alias("sources"))
    stats = (
        terms.join(many, "lang").groupBy("lang")
        .agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"), F.count_if(~_heavy()).alias("light"))
    )
    langs = many.join(stats, "lang", "left").select("lang", "n_sources", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("terms", "lang_total", "light")])
    out = rows.join(langs, "lang")
    return written(out.withColumn("base", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1))))), "groups")


def _heavy(light: int = LIGHT) -> Column:
    return F.col("sources") > F.least(F.lit(light), F.greatest(F.lit(4), F.floor(F.col("n_sources") / 3)))


def pair_corrections(light: DataFrame) -> DataFrame:
    """(a, b, value): for terms that both groups have, the difference to what either count alone contributes. ``light``: (tid, g, p, base)."""
    lists = light.groupBy("tid").agg(F.collect_list("g").alias("g"), F.collect_list("p").alias("p"), F.collect_list("base").alias("base")).where(F.size("g") > 1).drop("tid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(np.asarray(batch.column(0).offsets))
            g, p, base = (np.asarray(batch.column(i).flatten(), np.int64) for i in range(3))
            first = np.cumsum(size) - size
            names, own = np.unique(g, return_inverse=True)
            total = None
            if len(names) <= 1024:
                total = np.zeros(len(names) ** 2, np.int64)
            for h in np.unique(size).tolist():
                every = first[size == h][:, None] + np.arange(h)
                for at in np.array_split(every, max(1, len(every) * h * h >> 20)):
                    a, b = np.repeat(at, h, 1).ravel(), np.tile(at, (1, h)).ravel()
                    off = a != b
                    a, b = a[off], b[off]
                    v = _value(p[a], p[b]) - _value(p[a], base[b]) - _value(base[a], p[b]) + _value(base[a], base[b])
                    code = own[a] * len(names) + own[b]
                    if total is not None:
                        np.add.at(total, code, v)
                        continue
                    pairs, to = np.unique(code, return_inverse=True)
                    sums = np.zeros(len(pairs), np.int64)
                    np.add.at(sums, to, v)
                    yield _pairs(names[pairs // len(names)], names[pairs % len(names)], sums)
            if total is not None:
                pairs = np.flatnonzero(total)
                yield _pairs(names[pairs // len(names)], names[pairs % len(names)], total[pairs])

    return lists.mapInArrow(tidy(run), "a long, b long, value long")


def _pairs(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(v, pa.int64())], ["a", "b", "value"])


def tile_sums(heavy: DataFrame, groups: DataFrame, sources: int = TILE_SOURCES, terms: int = TILE_TERMS) -> DataFrame:
    """(a, b, value): the plain sum over heavy terms of every pair of groups, by tiles of sources times sources times terms. ``heavy``: (lang, tid, g, p, heavies: how many heavy terms the language has)."""
    block = F.pmod(F.xxhash64("tid"), F.ceil(F.col("heavies") / terms)).alias("tb")
    # How many terms a block has: those that none of a tile's sources has count as well.
    counted = heavy.select("lang", "tid", block).distinct().groupBy("lang", "tb").agg(F.count("*").alias("n"))
    sized = groups.select("lang", "g", "base", F.ceil(F.col("n_sources") / sources).alias("gbs")).withColumn("gb", F.pmod(F.xxhash64("g"), F.col("gbs")))
    heads = sized.join(counted, "lang").select("lang", "tb", "gb", "gbs", "g", F.lit(-1).cast("long").alias("tid"), F.col("base").alias("p"), "n")
    rows = heavy.select("g", "tid", "p", block).join(sized.select("lang", "g", "gb", "gbs"), "g")
    rows = rows.select("lang", "tb", "gb", "gbs", "g", "tid", "p", F.lit(0).cast("long").alias("n"))
    # A block meets every other one once; the tile gives both directions.
    cells = rows.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gbs") - 1)))
    cells = cells.select("lang", "tb", F.least("gb", "other").alias("low"), F.greatest("gb", "other").alias("high"), "gb", "g", "tid", "p", "n")

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        heads = rows[rows.tid < 0]
        low, high = int(rows.low.iloc[0]), int(rows.high.iloc[0])
        g, base, block = heads.g.to_numpy(), heads.p.to_numpy(), heads.gb.to_numpy()
        by = np.argsort(g)
        g, base, block = g[by], base[by], block[by]
        some = rows[rows.tid >= 0]
        tid, column = np.unique(some.tid.to_numpy(), return_inverse=True)
        absent = int(heads.n.iloc[0]) - len(tid)
        p = np.repeat(base[:, None], len(tid), 1)
        p[np.searchsorted(g, some.g.to_numpy()), column] = some.p.to_numpy()
        out = []
        for x, y in {(low, high), (high, low)}:
            side, columns = np.flatnonzero(block == x), np.flatnonzero(block == y)
            q = p[columns]
            for a in side:
                out.append(pd.DataFrame({"a": g[a], "b": g[columns], "value": _value(p[a], q).sum(1) + absent * _value(base[a], base[columns])}))
        every = pd.concat(out)
        return every[every.a != every.b]

    return cells.groupBy("lang", "tb", "low", "high").applyInPandas(tile, "a long, b long, value long")


def base_sums(light: DataFrame, groups: DataFrame, sources: int = TILE_SOURCES) -> DataFrame:
    """(a, b, value) for every ordered pair of groups of a language: all light terms as if absent, corrected by either group's own counts. ``light``: (g, p).

    A group's light counts are a histogram; a source with N words has at most sqrt(2N) different ones.
    """
    counts = light.groupBy("g", "p").agg(F.count("*").alias("k")).groupBy("g").agg(F.collect_list(F.struct("p", "k")).alias("h"))
    rows = groups.join(counts, "g", "left").select("lang", "g", "base", "light", F.ceil(F.col("n_sources") / sources).alias("gbs"), "h").withColumn("gb", F.pmod(F.xxhash64("g"), F.col("gbs")))
    left = rows.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gbs") - 1)).alias("gb"), F.col("g").alias("a"), F.col("base").alias("pa"), F.col("h").alias("ha"), "light")
    right = rows.select("lang", "gb", F.col("g").alias("b"), F.col("base").alias("pb"), F.col("h").alias("hb"))
    both = left.join(right, ["lang", "gb"]).where("a <> b")
    fold = lambda h, f: f"coalesce(aggregate({h}, 0L, (s, x) -> s + x.k * ({f} - ((pa - pb) * (pa - pb)) div pb)), 0L)"
    total = f"light * (((pa - pb) * (pa - pb)) div pb) + {fold('ha', '((x.p - pb) * (x.p - pb)) div pb')} + {fold('hb', '((pa - x.p) * (pa - x.p)) div x.p')}"
    return both.select("a", "b", F.coalesce(F.expr(total), F.lit(0)).cast("long").alias("value"))


def divergence_report(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language by divergence (part ``pair``), and the ``top`` terms that a source has more often than its language (part ``term``).

    Null text, lang and source are empty strings. A source without kept terms is a group as well; in a language without
    kept terms all divergences are 0. Ties go by the item's UTF-8 bytes; repeated documents count each; an empty table
    gives no rows. Texts are read whole and never shuffled; other columns aren't looked at.
    """
    kept = kept_terms(docs, least)
    groups = groups_of(docs, kept)
    by_name = groups.select("lang", "source", "g", F.col("total").alias("g_total"), "terms", "lang_total", "n_sources", "base", (F.col("terms") - F.col("light")).alias("heavies"))
    n = kept.join(by_name, ["lang", "source"])
    counts = written(n.select("lang", "source", "g", "term", "tid", "total", "terms", "lang_total", "base", "heavies", _heavy().alias("heavy"), share(F.col("n"), F.col("g_total"), F.col("terms")).alias("p")), "shares")
    light, heavy = counts.where("not heavy"), counts.where("heavy")
    sums = base_sums(light.select("g", "p"), groups).unionByName(pair_corrections(light.select("tid", "g", "p", "base"))).unionByName(tile_sums(heavy.select("lang", "tid", "g", "p", "heavies"), groups))
    sums = sums.groupBy("a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "source", "g")
    pairs = sums.join(names.withColumnRenamed("g", "a"), "a").join(names.select(F.col("g").alias("b"), F.col("source").alias("item")), "b").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = [F.col("value").desc(), F.col("item")]
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    q = share(F.col("total"), F.col("lang_total"), F.col("terms"))
    terms = counts.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value(F.col("p"), F.col("q")).alias("value"))
    # The best of a large source are found in slices first.
    sliced = terms.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(16)))
    best = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "slice").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "slice")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)
    return pairs.unionByName(best)
