"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Each round every node hooks onto its smallest neighbour (a partial ``min`` before the shuffle, so a hub
    costs one row per task), pointer doubling flattens the hooks to trees of depth one, and edges are rewritten
    to the trees' roots, where loops and repeats fall away. Chains shrink by doubling and stars in a round or
    two; every round's tables are written to the shared folder. Null ends and self loops are ignored; an edge
    listed any number of times counts once. An empty input gives an empty result.
    """
    e = (
        edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x is not null and y is not null and x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    e = written(e, "cc-edges")
    labels = None
    while not e.isEmpty():
        ends = e.select(F.col("a").alias("node"), F.col("a").alias("to")).union(e.select("b", "a"))
        hook = flattened(written(ends.groupBy("node").agg(F.min("to").alias("root")), "cc-hook"))
        if labels is None:
            labels = hook
        else:
            step = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = written(labels.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "cc-labels")
        left = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = e.join(left, "a").join(right, "b").where("ra <> rb")
        e = written(e.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels


def flattened(labels: DataFrame) -> DataFrame:
    """Pointer doubling: afterwards every root is its own root."""
    while True:
        up = labels.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("up"))
        moved = written(labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "cc-flat")
        labels = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return labels
