"""A street graph from lines: crossings found by tiles, lines split at them, near ends merged, false nodes taken out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tiling
from .graphs import connected

#: Segments a tile, about; a tile's pairs are compared.
CAPACITY = 200


def segments(lines: DataFrame) -> DataFrame:
    """(id, part, x0, y0, x1, y1) of lines (id, line: points); points that are null or not finite are passed over, and steps on the spot left out."""
    good = F.filter("line", lambda p: F.coalesce((F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")), F.lit(False)))
    pts = lines.where("line is not null").select("id", good.alias("p")).where(F.size("p") > 1)
    step = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))
    return pts.select("id", F.posexplode(step).alias("part", "s")).select("id", "part", "s.*").where("x0 <> x1 or y0 <> y1")


def cuts(parts: DataFrame, tolerance: float, capacity: int = CAPACITY) -> DataFrame:
    """(id, part, t): where each segment is to be cut, from 0 to 1: its ends, crossings and touches with others, and the ends of those that lie on it.

    Segments meet in the leaves of a quadtree; a pair that meets in several leaves gives the same cuts, which count once.
    """
    box = parts.withColumns({"min_x": F.least("x0", "x1") - tolerance, "max_x": F.greatest("x0", "x1") + tolerance, "min_y": F.least("y0", "y1") - tolerance, "max_y": F.greatest("y0", "y1") + tolerance})
    middle = box.withColumns({"x": (F.col("min_x") + F.col("max_x")) / 2, "y": (F.col("min_y") + F.col("max_y")) / 2})
    tree = tiling.tree_of(middle, capacity)
    filed = box.withColumn("leaf", F.explode(tiling.leaves_of(tree, *[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")])))
    names = ("id", "part", "x0", "y0", "x1", "y1", "min_x", "max_x", "min_y", "max_y")
    other = filed.select("leaf", *[F.col(c).alias(f"o_{c}") for c in names])
    near = "min_x <= o_max_x and o_min_x <= max_x and min_y <= o_max_y and o_min_y <= max_y"
    met = filed.join(other, "leaf").where("struct(id, part) < struct(o_id, o_part)").where(near)
    met = met.withColumns({"dx": F.expr("x1 - x0"), "dy": F.expr("y1 - y0"), "ex": F.expr("o_x1 - o_x0"), "ey": F.expr("o_y1 - o_y0"), "ox": F.expr("o_x0 - x0"), "oy": F.expr("o_y0 - y0")})
    met = met.withColumns({"det": F.expr("dx * ey - dy * ex"), "n": F.expr("sqrt(dx * dx + dy * dy)"), "m": F.expr("sqrt(ex * ex + ey * ey)")}).withColumn("flat", F.expr("abs(det) <= 1e-9 * n * m"))
    crossed = met.where("not flat").withColumns({"t": F.expr("(ox * ey - oy * ex) / det"), "s": F.expr("(ox * dy - oy * dx) / det")})
    crossed = crossed.where(f"t between -{tolerance!r}D / n and 1 + {tolerance!r}D / n and s between -{tolerance!r}D / m and 1 + {tolerance!r}D / m")
    # Along one line: the ends of either on the other.
    on = lambda px, py, x0, y0, dx, dy, n: f"IF(abs(({px} - {x0}) * {dy} - ({py} - {y0}) * {dx}) / {n} <= {tolerance!r}D, (({px} - {x0}) * {dx} + ({py} - {y0}) * {dy}) / ({n} * {n}), NULL)"
    lying = met.where("flat")
    mine = lying.select("id", "part", F.explode(F.expr(f"array({on('o_x0', 'o_y0', 'x0', 'y0', 'dx', 'dy', 'n')}, {on('o_x1', 'o_y1', 'x0', 'y0', 'dx', 'dy', 'n')})")).alias("t"))
    theirs = lying.select(F.col("o_id").alias("id"), F.col("o_part").alias("part"), F.explode(F.expr(f"array({on('x0', 'y0', 'o_x0', 'o_y0', 'ex', 'ey', 'm')}, {on('x1', 'y1', 'o_x0', 'o_y0', 'ex', 'ey', 'm')})")).alias("t"))
    ends = parts.select("id", "part", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    found = crossed.select("id", "part", "t").unionByName(crossed.select(F.col("o_id").alias("id"), F.col("o_part").alias("part"), F.col("s").alias("t")))
    inside = mine.unionByName(theirs).where("t > 0 and t < 1")
    return found.select("id", "part", F.least(F.greatest("t", F.lit(0.0)), F.lit(1.0)).alias("t")).unionByName(inside).unionByName(ends).distinct()


def graph(lines: DataFrame, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, y) and edges (id, a, b, length) of lines (id, line): every crossing, touch and end is a node.

    Points closer than ``tolerance`` are one node (so are chains of such points); it stands at the least of them. A stretch that two
    lines have in common is an edge of each. Pieces whose ends are one node, and no longer than ``tolerance``, are left out. Both tables are checkpoints.
    """
    parts = segments(lines).checkpoint()
    at = parts.join(cuts(parts, tolerance), ["id", "part"]).select("id", "part", "t", (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("t")).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("t")).alias("y"))
    at = at.withColumn("spot", F.struct(F.floor(F.col("x") / tolerance + 0.5).alias("kx"), F.floor(F.col("y") / tolerance + 0.5).alias("ky"))).checkpoint()
    spots = at.groupBy("spot").agg(F.min(F.struct("x", "y")).alias("p"), F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("ay"), F.max("y").alias("by"))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    beside = spots.withColumn("o", step).select(F.struct((F.col("spot.kx") + F.col("o.i")).alias("kx"), (F.col("spot.ky") + F.col("o.j")).alias("ky")).alias("b"), F.col("spot").alias("a"), "ax", "bx", "ay", "by")
    gap = lambda lo, hi, lo2, hi2: F.greatest(F.col(lo2) - F.col(hi), F.col(lo) - F.col(hi2), F.lit(0.0))
    pairs = beside.join(spots.select(F.col("spot").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("ax", "bx", "ay", "by")]), "b")
    links = pairs.where(F.sqrt(gap("ax", "bx", "ax2", "bx2") ** 2 + gap("ay", "by", "ay2", "by2") ** 2) <= tolerance).select("a", "b")
    roots = connected(links).withColumnRenamed("node", "spot")
    named = spots.select("spot", "p").join(roots, "spot", "left").withColumn("root", F.coalesce("root", "spot"))
    nodes = named.groupBy("root").agg(F.min("p").alias("p")).select("root", F.monotonically_increasing_id().alias("node"), F.col("p.x").alias("x"), F.col("p.y").alias("y")).checkpoint()
    places = at.join(named.select("spot", "root"), "spot").join(nodes.select("root", "node"), "root")
    along = Window.partitionBy("id", "part").orderBy("t")
    pieces = places.select("id", F.col("node").alias("a"), F.lead("node").over(along).alias("b"), F.sqrt((F.lead("x").over(along) - F.col("x")) ** 2 + (F.lead("y").over(along) - F.col("y")) ** 2).alias("length"))
    edges = pieces.where("b is not null").where((F.col("a") != F.col("b")) | (F.col("length") > tolerance))
    return nodes.select("node", "x", "y"), edges.select("id", "a", "b", "length").checkpoint()


def simplified(edges: DataFrame) -> DataFrame:
    """(edge, a, b, length, parts) without false nodes: edges (a, b, length) that meet where nothing else does are one.

    A circle without a true node has its least node at both ends. The edge's number is of this table, a checkpoint.
    """
    e = edges.select("a", "b", "length").withColumn("edge", F.monotonically_increasing_id()).checkpoint()
    ends = e.select("edge", F.explode(F.array("a", "b")).alias("node"))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"), F.min("edge").alias("p"), F.max("edge").alias("q"))
    false = degree.where("degree = 2")
    roots = connected(false.where("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b"))).withColumnRenamed("node", "edge").withColumnRenamed("root", "whole")
    label = e.join(roots, "edge", "left").withColumn("whole", F.coalesce("whole", "edge"))
    true = ends.join(degree.where("degree <> 2").select("node"), "node").join(label.select("edge", "whole"), "edge").groupBy("whole").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    per = label.groupBy("whole").agg(F.sum("length").alias("length"), F.count("*").alias("parts"), F.min(F.least("a", "b")).alias("least"))
    return per.join(true, "whole", "left").select(F.col("whole").alias("edge"), F.coalesce("a", "least").alias("a"), F.coalesce("b", "least").alias("b"), "length", "parts")
