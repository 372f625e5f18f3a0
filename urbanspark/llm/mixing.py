"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copies that each of its documents gets on average. The whole part is
given to all; the fraction is rounded by pairs: mass, in words, moves from one document to the other until one of
them is integral, and chance chooses the direction so that each keeps its expected copies. A block of documents
leaves one residual; a reduction tree pairs the residuals of blocks, level by level, until a source has one, and
a last coin settles it. So a source's words miss its target by less than one document. Rows repeated whole are one
row with a multiple of the copies, and share what it gets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, fresh, maybe_broadcast, numbered, scratch, text_bytes, tidy, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Repeats that are written out by one task.
REPEATS = 4096
#: Documents in a block, and residuals that a node of the tree combines.
BLOCK, FAN_IN = 1024, 64
_EPS = 1e-9


def sizes(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", row: str | None = None) -> DataFrame:
    """(doc_id, source, size, salt, row): row is the column of that name, 0 without one; words of ``[^\\x20\\x09-\\x0D]+``; a null text has none. salt tells unlike rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                n = pa.array([len(x.split()) for x in text_bytes(batch)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, batch.column(3), batch.column(4)], ["doc_id", "source", "size", "salt", "row"])

    t = docs[f"`{text}`"]
    rows = docs.select(docs[f"`{key}`"].alias("doc_id"), docs[f"`{source}`"].alias("source"), t.alias("text"), F.xxhash64(t, docs[f"`{source}`"]).alias("salt"), (docs[f"`{row}`"] if row else F.lit(0).cast("long")).alias("row"))
    return rows.mapInArrow(tidy(run), "doc_id long, source string, size long, salt long, row long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target): one row per source.

    Weights go round by code point, null last. A target stops at ``most`` times its source's size, and the
    excess is shared again among the rest by weight until none is above. The loop exchanges three sums a round.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1  # one row per source
    per = per.withColumn("rank", rank)
    wheel = F.array(*map(F.lit, weights))
    per = written(per.select("source", "source_size", "n", F.element_at(wheel, (F.col("rank") % len(weights) + 1).cast("int")).alias("w"), (F.col("source_size") * most).cast("double").alias("top")), "sources")
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("w") * level > F.col("top") if level else F.lit(False)
        row = per.agg(F.sum(F.when(full, F.col("top"))).alias("held"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        now = (total * share - (row["held"] or 0.0)) / row["w"] if row["w"] else level
        if now <= level * (1 + 1e-12):
            break
        level = now
    return per.select("source", "source_size", "n", F.least(F.col("w") * level, F.col("top")).alias("target"))


def pivotal(size: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> int | None:
    """Round ``part`` in place by pairs, keeping sum(size x part); what is left fractional is told, None if nothing."""
    held = None
    for i, u in zip(range(len(part)), rng.random(len(part)).tolist(), strict=True):
        if _EPS < part[i] < 1 - _EPS:
            if held is None:
                held = i
                continue
            a, b = held, i
            sa, sb, pa_, pb = size[a], size[b], part[a], part[b]
            up = min((1 - pa_) * sa, pb * sb)  # words that may move from b to a, and back
            down = min(pa_ * sa, (1 - pb) * sb)
            move = up if u * (up + down) < down else -down
            part[a], part[b] = pa_ + move / sa, pb - move / sb
            for x in (a, b):
                part[x] = 0.0 if part[x] <= _EPS else 1.0 if part[x] >= 1 - _EPS else part[x]
            held = next((x for x in (a, b) if 0 < part[x] < 1), None)
        else:
            part[i] = round(part[i])
    return held


def _round_block(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([(c, "ascending") for c in ("tick", "doc_id", "salt", "size")])
    part = rows["part"].to_numpy().copy()
    seed = rows["tick"][0].as_py() & 0x7FFFFFFFFFFFFFFF
    held = pivotal(rows["size"].to_numpy().astype(float), part, np.random.default_rng(seed))
    block = rows["block"].to_numpy() // FAN_IN
    for name, values in (("part", part), ("block", block), ("open", np.arange(len(part)) == (-1 if held is None else held))):
        rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values))
    return rows


_SCHEMA = "doc_id long, source string, size long, salt long, m long, row long, source_size long, target double, base long, part double, tick long, block long, open boolean"


def copies(sized: DataFrame, goal: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, source, size, salt, m, row, source_size, target, copies for every distinct row.

    m is how often the row is there, row the smallest of their numbers, copies what all of them get together. Blocks
    are by hash of the row, so the same rows give the same copies however they are partitioned. Documents without
    words get the whole part.
    """
    sized = sized.groupBy("doc_id", "source", "size", "salt").agg(F.count("*").alias("m"), F.min("row").alias("row"))
    both = sized.alias("s").join(maybe_broadcast(goal).alias("g"), F.expr("s.source <=> g.source"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = both.select("doc_id", "s.source", "size", "salt", "m", "row", "source_size", "target", "n", ratio.alias("ratio"))
    tick = F.xxhash64("doc_id", "salt", "source", F.lit(seed))
    whole, due = F.floor(F.col("ratio") + _EPS) * F.col("m"), F.col("ratio") * F.col("m")
    base = F.when(F.col("size") > 0, F.floor(due + _EPS)).otherwise(whole)
    rows = rows.select(
        "doc_id", "source", "size", "salt", "m", "row", "source_size", "target", base.alias("base"),
        F.when(F.col("size") > 0, F.greatest(due - base, F.lit(0.0))).otherwise(0.0).alias("part"), tick.alias("tick"),
        F.pmod(F.shiftright(tick, 8), F.ceil(F.col("n") / BLOCK)).alias("block"), F.lit(True).alias("open"),
    )
    most = goal.agg(F.max("n")).first()[0] or 0
    level = written(rows.groupBy("source", "block").applyInArrow(_round_block, _SCHEMA), "mix-blocks")
    done, blocks = [level.where("not open")], -(-most // BLOCK)
    while blocks > 1:  # the tree; each level has a FAN_IN-th of the residuals
        blocks = -(-blocks // FAN_IN)
        level = written(level.where("open").groupBy("source", "block").applyInArrow(_round_block, _SCHEMA), "mix-level")
        done.append(level.where("not open"))
    coin = F.pmod(F.xxhash64("tick", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    done.append(level.where("open").withColumn("part", F.when(coin < F.col("part"), 1.0).otherwise(0.0)))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "size", "salt", "m", "row", "source_size", "target", (F.col("base") + F.round("part").cast("long")).alias("copies"))


#: What the nth (from 0) of m repeated rows takes of their copies.
_TAKE = "copies div m + if(nth < copies % m, 1, 0)"


def mixing_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times copies), copies for every row.

    A null source is a source, a null text has no words; rows repeated whole share their copies as evenly as can be.
    An empty table gives an empty result; other columns aren't looked at.
    """
    sized = written(sizes(docs), "sizes")
    got = written(copies(sized, targets(sized)), "mix-copies")
    once = got.where("m = 1").withColumn("nth", F.lit(0).cast("long"))
    # A row may be there any number of times: first its thousands are dealt to tasks, then each writes its own.
    parts = got.where("m > 1").withColumn("part", F.explode(F.expr(f"sequence(0L, (m - 1) div {REPEATS})"))).repartition("doc_id", "salt", "part")
    often = parts.withColumn("nth", F.explode(F.expr(f"sequence(part * {REPEATS}, least(m, (part + 1) * {REPEATS}) - 1)"))).drop("part")
    out = once.unionByName(often).withColumn("copies", F.expr(_TAKE))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` with their own columns, whatever their names, each as often as it was given copies.

    Rows have numbers that stay with them (``numbered``); what is taken is known by its number, so texts are
    shuffled only where the rows taken are too many to be broadcast. A null source is a source and a null text has
    no words; rows repeated whole share their copies evenly, in the order of their numbers. An empty table gives an
    empty result.
    """
    row, take = fresh(docs, "__row"), fresh(docs, "__take")
    rows = numbered(docs, row)
    with scratch(docs.sparkSession) as keep:
        sized = written(sizes(rows, row=row), "sizes")
        got = written(copies(sized, targets(sized)), "mix-copies")
        once = got.where("m = 1").select("row", F.col("copies").alias("take"))
        often = written(got.where("m > 1").select(F.col("doc_id").alias("id"), F.col("salt").alias("s"), "m", "copies"), "mix-often")
        shared = sized.join(maybe_broadcast(often), F.expr("doc_id <=> id and salt = s")).select("id", "s", "m", "copies", "row", F.spark_partition_id().alias("part"))
        shared = written(shared, "mix-shared")
        # Numbers of repeats: within a task, after those of the tasks before it; so no task gets a hot row's repeats all.
        before = shared.groupBy("id", "s", "part").count()
        before = before.withColumn("before", F.sum("count").over(Window.partitionBy("id", "s").orderBy("part")) - F.col("count")).select(F.col("id").alias("i"), F.col("s").alias("t"), F.col("part").alias("p"), "before")
        within = F.row_number().over(Window.partitionBy("id", "s", "part").orderBy("row")) - 1
        shared = shared.withColumn("within", within).join(maybe_broadcast(before), F.expr("id <=> i and s = t and part = p")).withColumn("nth", F.col("before") + F.col("within"))
        taken = keep(once.union(shared.select("row", F.expr(_TAKE).alias("take"))).where("take > 0"), "mix-taken")
    out = rows.join(maybe_broadcast(taken.select(F.col("row").alias(row), F.col("take").alias(take))), row)
    return out.withColumn(take, F.explode(F.expr(f"sequence(1L, `{take}`)"))).select(*[F.col(f"`{c}`") for c in docs.columns])
