"""Neighbourhoods over graphs of buildings: rings of steps, weights by perimeter and shared walls, distances inside a neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import shuffled
from ..functions import geometry as G
from . import urban
from .graphs import connected


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()


def rings(edges: DataFrame, k: int) -> DataFrame:
    """(id, node, ring): every node that can be reached in 1 to ``k`` steps over edges (a, b), seen from both ends, with its least number of steps.

    A round extends only the outermost ring, and leaves out what is known; rounds are cut by checkpoints. Null ends and
    loops don't count; a node without edges has no row.
    """
    if k < 1:
        raise ValueError("k has to be 1 or more")
    step = _both(edges).checkpoint()
    front = step.select(F.col("a").alias("id"), F.col("b").alias("node"))
    out = front.withColumn("ring", F.lit(1))
    for n in range(2, k + 1):
        to = front.join(shuffled(step), front["node"] == step["a"]).select("id", F.col("b").alias("node")).where("id <> node").distinct()
        front = to.join(shuffled(out), ["id", "node"], "left_anti").checkpoint()
        out = out.unionByName(front.withColumn("ring", F.lit(n)))
    return out


def ring_statistics(found: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """(id, neighbours, total, mean) of a column over each node's rings (id, node), for all of ``values`` (id, column); null values count as neighbours, but in no sum."""
    v = values.select(F.col("id").alias("node"), F.col(column).alias("__v"))
    per = found.join(shuffled(v), "node").groupBy("id").agg(F.count("*").alias("neighbours"), F.sum("__v").alias("total"), F.avg("__v").alias("mean"))
    return values.select("id").join(shuffled(per), "id", "left").select("id", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), "total", "mean")


def weighted_neighbours(edges: DataFrame, shapes: DataFrame) -> DataFrame:
    """(id, neighbours, weighted): the number of neighbours, and over the shape's (id, ring) perimeter; null without a perimeter."""
    per = _both(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    rows = shapes.select("id", G.perimeter(F.col("ring")).alias("p")).join(shuffled(per), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("id", F.col("n").alias("neighbours"), F.when(F.col("p") > 0, F.col("n") / F.col("p")).alias("weighted"))


def wall_weighted_mean(buildings: DataFrame, values: DataFrame, column: str, tolerance: float = 1e-3) -> DataFrame:
    """(id, mean): the mean of a column over the neighbours that share walls with a footprint (id, ring), weighted by the walls' length; null without any."""
    pairs = urban.wall_pairs(buildings, tolerance).join(shuffled(values.select(F.col("id").alias("other"), F.col(column).alias("__v"))), "other").where("__v is not null")
    per = pairs.groupBy("id").agg((F.sum(F.col("__v") * F.col("shared")) / F.sum("shared")).alias("mean"))
    return buildings.select("id").join(shuffled(per), "id", "left")


def interbuilding_distance(buildings: DataFrame, adjacency: DataFrame, neighbourhood: DataFrame) -> DataFrame:
    """(id, distance): the mean distance over the adjacency's edges (a, b) whose two ends are in a footprint's neighbourhood (id, node), itself included; null without any.

    Distances are computed once an edge, whichever neighbourhoods it is in.
    """
    rings_ = buildings.select("id", "ring")
    edges = _both(adjacency).where("a < b")
    far = edges.join(shuffled(rings_.select(F.col("id").alias("a"), F.col("ring").alias("ra"))), "a").join(shuffled(rings_.select(F.col("id").alias("b"), F.col("ring").alias("rb"))), "b")
    far = far.select("a", "b", G.distance(F.col("ra"), F.col("rb")).alias("d")).checkpoint()
    own = neighbourhood.select("id", "node").union(buildings.select("id", F.col("id").alias("node"))).distinct()
    inside = far.join(shuffled(own.select("id", F.col("node").alias("a"))), "a").join(shuffled(own.select("id", F.col("node").alias("b"))), ["id", "b"])
    return buildings.select("id").join(shuffled(inside.groupBy("id").agg(F.avg("d").alias("distance"))), "id", "left")


def adjacency_share(contiguity: DataFrame, neighbourhood: DataFrame, buildings: DataFrame) -> DataFrame:
    """(id, adjacency): joined structures among a building's neighbourhood (id, node), over its number of buildings; null without any."""
    roots = connected(contiguity.select("a", "b"))
    label = buildings.select(F.col("id").alias("node")).join(shuffled(roots), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    per = neighbourhood.select("id", "node").distinct().join(shuffled(label), "node").groupBy("id").agg((F.count_distinct("root") / F.count("*")).alias("adjacency"))
    return buildings.select("id").join(shuffled(per), "id", "left")
