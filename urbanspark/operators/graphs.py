"""Graphs of urban form: triangulation, bounded paths, street openness."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import shuffled


def triangles(xy: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles by insertion from left to right: those whose circle holds a new point are replaced by a fan about it, and those whose circle lies left of it are done."""
    n = len(xy)
    if n < 3:
        return []
    centre, span = xy.mean(axis=0), max(float(np.ptp(xy, axis=0).max()), 1.0)
    pts = np.vstack([xy - centre, [[-40 * span, -20 * span], [40 * span, -20 * span], [0, 40 * span]]])

    def circle(t: tuple[int, int, int]) -> tuple[float, float, float]:
        (ax, ay), (bx, by), (cx, cy) = pts[list(t)]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-12:
            return 0.0, 0.0, np.inf
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / d, (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d
        return float(ux), float(uy), float((ax - ux) ** 2 + (ay - uy) ** 2)

    live, done = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}, []
    for i in np.lexsort((xy[:, 1], xy[:, 0])).tolist():
        x, y = pts[i].tolist()
        gone, left = [], []
        for t, (ux, uy, r2) in live.items():
            dx, dy = x - ux, y - uy
            if dx > 0 and dx * dx >= r2:
                left.append(t)
            elif dx * dx + dy * dy < r2 * (1 - 1e-12):
                gone.append(t)
        for t in left:
            del live[t]
        done += left
        sides: dict[tuple[int, int], int] = {}
        for t in gone:
            for a, b in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                key = (min(a, b), max(a, b))
                sides[key] = sides.get(key, 0) + 1
            del live[t]
        for (a, b), k in sides.items():
            if k == 1:
                live[a, b, i] = circle((a, b, i))
    return [t for t in (*done, *live) if max(t) < n]


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every end of links (a, b): root is the least node that can be reached.

    Every node takes the least root among its neighbours', roots are followed to theirs, until none changes: chains
    shrink by doubling. Rounds are cut by checkpoints in the shared folder.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().checkpoint()
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")).checkpoint()
    while True:
        offered = both.join(shuffled(labels.select(F.col("node").alias("b"), "root")), "b").groupBy("a").agg(F.min("root").alias("offer"))
        near = labels.join(shuffled(offered.withColumnRenamed("a", "node")), "node", "left").select("node", F.least("root", F.coalesce("offer", "root")).alias("near"), F.col("root").alias("was"))
        up = near.select(F.col("node").alias("near"), F.col("near").alias("up"))
        new = near.join(shuffled(up), "near").select("node", F.least("near", "up").alias("root"), "was").checkpoint()
        labels = new.select("node", "root")
        if new.where("root <> was").isEmpty():
            return labels


def delaunay(points: DataFrame, tile: float, halo: float) -> DataFrame:
    """(a, b), a < b: edges of the triangulation of points (id, x, y), per tile with a halo.

    A tile gives the edges whose middle lies in it; with a halo wider than the largest empty circle these are the
    edges of the whole triangulation.
    """
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    keyed = points.select("id", "x", "y").withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        xy, ids = pdf[["x", "y"]].to_numpy(float), pdf["id"].to_numpy()
        tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
        out = set()
        for t in triangles(xy):
            for a, b in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                mx, my = (xy[a] + xy[b]) / 2
                if mx // tile == tx and my // tile == ty:
                    out.add((min(ids[a], ids[b]), max(ids[a], ids[b])))
        return pd.DataFrame(sorted(out), columns=["a", "b"])

    return keyed.groupBy("tx", "ty").applyInPandas(one, "a long, b long").distinct()


def within_reach(edges: DataFrame, limit: float) -> DataFrame:
    """(source, node, dist): nodes no farther than ``limit`` along edges (a, b, length), sources left out.

    Each round extends only distances that the last one found or shortened, and keeps the least per pair; it ends
    when a round shortens none. Edges of negative, infinite or no length are an error.
    """
    if not edges.where(F.col("length").isNull() | F.isnan("length") | (F.col("length") < 0)).isEmpty():
        raise ValueError("an edge without a length of 0 or more")
    both = edges.select("a", "b", "length").union(edges.select("b", "a", "length"))
    best = both.where(F.col("length") <= limit).groupBy(F.col("a").alias("source"), F.col("b").alias("node")).agg(F.min("length").alias("dist")).where("source <> node").checkpoint()
    front = best
    while not front.isEmpty():
        step = front.join(shuffled(both), front["node"] == both["a"]).where((F.col("dist") + F.col("length") <= limit) & (F.col("source") != F.col("b")))
        step = step.groupBy("source", F.col("b").alias("node")).agg(F.min(F.col("dist") + F.col("length")).alias("near"))
        front = step.join(shuffled(best), ["source", "node"], "left").where("dist is null or near < dist").select("source", "node", F.col("near").alias("dist")).checkpoint()
        best = best.unionByName(front).groupBy("source", "node").agg(F.min("dist").alias("dist")).checkpoint()
    return best


def closeness(reach: DataFrame, nodes: int) -> DataFrame:
    """Local closeness of each source: nodes reached over the sum of distances, scaled by the share of nodes reached."""
    per = reach.groupBy("source").agg(F.count("*").alias("n"), F.sum("dist").alias("total"))
    return per.select(F.col("source").alias("node"), (F.col("n") / F.col("total") * F.col("n") / max(nodes - 1, 1)).alias("closeness"))


def meshedness(reach: DataFrame, edges: DataFrame) -> DataFrame:
    """(e - v + 1) / (2 v - 5) of each source's reachable part."""
    own = reach.select("source", "node").union(reach.select("source", F.col("source").alias("node")).distinct())
    v = own.groupBy("source").agg(F.count("*").alias("v"))
    e = edges.select("a", "b").distinct().join(shuffled(own.select("source", F.col("node").alias("a"))), "a").join(shuffled(own.select("source", F.col("node").alias("b"))), ["source", "b"]).groupBy("source").agg(F.count("*").alias("e"))
    return v.join(shuffled(e), "source", "left").select(F.col("source").alias("node"), ((F.coalesce("e", F.lit(0)) - F.col("v") + 1) / (2 * F.col("v") - 5)).alias("meshedness"))


def street_profile(streets: DataFrame, walls: DataFrame, tick: float = 50.0, step: float = 3.0) -> DataFrame:
    """width, deviation and openness of streets (street_id, x0, y0, x1, y1): ticks across every ``step`` run to walls (x0 ... y1), ``tick`` / 2 at most.

    Ticks and walls meet by grid cells; a tick without a wall on a side counts as open there.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length = F.sqrt(dx * dx + dy * dy)
    s = streets.withColumns({"ux": dx / length, "uy": dy / length}).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(length / step).cast("int")))).withColumn("side", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    s = s.withColumns({"px": F.col("x0") + F.col("ux") * F.col("k") * step, "py": F.col("y0") + F.col("uy") * F.col("k") * step, "vx": -F.col("uy") * F.col("side"), "vy": F.col("ux") * F.col("side")})
    s = s.select("street_id", "k", "side", "px", "py", "vx", "vy")
    cell, half = tick, tick / 2
    cover = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
    t = s.withColumn("kx", F.explode(cover(F.col("px"), F.col("px") + F.col("vx") * half))).withColumn("ky", F.explode(cover(F.col("py"), F.col("py") + F.col("vy") * half)))
    w = walls.select(F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by"))
    w = w.withColumn("kx", F.explode(cover(F.col("ax"), F.col("bx")))).withColumn("ky", F.explode(cover(F.col("ay"), F.col("by"))))
    ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    det = F.col("vx") * ey - F.col("vy") * ex
    far = ((F.col("ax") - F.col("px")) * ey - (F.col("ay") - F.col("py")) * ex) / det
    along = ((F.col("ax") - F.col("px")) * F.col("vy") - (F.col("ay") - F.col("py")) * F.col("vx")) / det
    hits = t.join(shuffled(w), ["kx", "ky"]).where(det != 0).where(far.between(0.0, half) & along.between(0.0, 1.0)).groupBy("street_id", "k", "side").agg(F.min(far).alias("dist"))
    both = s.join(shuffled(hits), ["street_id", "k", "side"], "left").withColumn("reach", F.coalesce("dist", F.lit(half)))
    wide = both.groupBy("street_id", "k").agg(F.sum("reach").alias("width"), F.count("dist").alias("closed"))
    return wide.groupBy("street_id").agg(F.avg("width").alias("width"), F.coalesce(F.stddev_samp("width"), F.lit(0.0)).alias("deviation"), (1 - F.sum("closed") / (2 * F.count("*"))).alias("openness"))
