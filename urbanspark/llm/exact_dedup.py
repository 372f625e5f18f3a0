"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

A frequent-items sketch (Spark's ``approx_top_k``, a mergeable Misra-Gries summary) proposes frequent digests
in one partial aggregate. Its counts are off by less than 1.4 rows in ``tracked`` (its counters), which is a
sixth of the share that makes a winner, so every digest above the share is proposed. An exact count verifies
them; the winners, under ``share`` in number, are broadcast. Their rows never meet in a shuffle: each task
reduces them to one row per winner. All other digests hold at most one row in ``share`` and are grouped by an
ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, maybe_broadcast, numbered, scratch, written

#: A winner holds more than one row in so many.
SHARE = 1000
#: Counters of the sketch; a quarter of them is the most digests that are ever broadcast (32 bytes each).
TRACKED = 8 * SHARE


def without_space(text: Column) -> Column:
    """Delete every character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\v\f":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", uid: Column | None = None) -> DataFrame:
    """(doc_id, uid, n, digest): one small row per document, written once; uid (by default a number of this scan) tells repeated rows apart."""
    uid = F.monotonically_increasing_id() if uid is None else uid
    t = F.coalesce(docs[f"`{text}`"], F.lit(""))
    small = docs.select(
        docs[f"`{key}`"].alias("doc_id"), uid.alias("uid"), F.length(t).alias("n"),
        F.unhex(F.sha2(without_space(docs[f"`{text}`"]), 256)).alias("digest"),
    )
    return written(small, "digests")


def winners(small: DataFrame, tracked: int = TRACKED, share: int = SHARE) -> DataFrame:
    """Digests that hold over 1/share of the rows, exactly counted; under ``share`` rows."""
    sketch = small.agg(F.expr(f"approx_top_k(hex(digest), {tracked // 4}, {tracked})").alias("top"), F.count("*").alias("rows"))
    named = sketch.select("rows", F.explode(F.expr("transform(top, x -> unhex(x.item))")).alias("digest"))
    counted = small.join(F.broadcast(named), "digest").groupBy("digest").agg(F.count("*").alias("size"), F.max("rows").alias("rows"))
    return written(counted.where(F.col("size") * share > F.col("rows")).select("digest"), "winners")


def _best(rows: DataFrame) -> DataFrame:
    order = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    return rows.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", uid: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (and uid, the row's number).

    Texts are equal when identical without white space; null counts as empty, and empty texts are equal to each
    other. The row with the most code points stays, then the smallest doc_id (null ids last); of rows that are
    repeated whole, one stays. Columns other than the text and the key are not looked at. An empty table gives
    an empty result.
    """
    small = digests(docs, text, key, uid)
    top = F.broadcast(winners(small))
    hot = small.join(top, "digest", "left_semi")
    rest = small.join(top, "digest", "left_anti")
    # Each winner's best row: under SHARE rows after partial aggregates, so they are broadcast.
    hot = hot.join(F.broadcast(_best(hot)), "digest")
    rest = rest.join(_best(rest), "digest")
    return hot.unionByName(rest).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "uid",
    )


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    The texts aren't shuffled where what goes can be broadcast. Rows have numbers that stay with them (``numbered``); what goes is known by
    that number, which is read, never counted again, so it doesn't matter how either scan is split. Null texts are
    empty and equal; of rows repeated whole one stays; null ids come last. An empty table gives an empty result.
    """
    row = fresh(docs, "__row")
    rows = numbered(docs, row)
    with scratch(docs.sparkSession) as keep:
        gone = keep(exact_groups(rows, text, key, F.col(f"`{row}`")).where("not kept").select(F.col("uid").alias(row)), "exact-gone")
    return rows.join(maybe_broadcast(gone), row, "left_anti").select(*[rows[f"`{c}`"] for c in docs.columns])
