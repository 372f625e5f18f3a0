"""Urban form: measures of footprints, neighbourhood graphs, clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..core import shuffled
from ..functions import geometry as G

# The ten colours of clusters.
TAB10 = ["#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf"]


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise; fewer than three where the points are on a line."""
    p = np.unique(points, axis=0)
    chains = []
    for side in (p, p[::-1]):
        chain: list[np.ndarray] = []
        for q in side:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (q[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (q[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(q)
        chains += chain[:-1]
    return np.array(chains).reshape(-1, 2)


def _hull_area_and_sides(points: np.ndarray) -> tuple[float | None, float | None, float | None]:
    """Area of the hull; shorter and longer side of the smallest rectangle about it, which shares a direction with one of its edges."""
    h = hull(points - points[0]) if len(points) and np.isfinite(points).all() else np.zeros((0, 2))
    if len(h) < 3:
        return None, None, None
    edge = np.roll(h, -1, axis=0) - h
    along = edge / np.hypot(edge[:, 0], edge[:, 1])[:, None]
    spans = np.stack([np.ptp(h @ along.T, axis=0), np.ptp(h @ np.stack([-along[:, 1], along[:, 0]]), axis=0)])
    short, long = sorted(spans[:, np.argmin(spans[0] * spans[1])].tolist())
    return float(abs((h[:, 0] * edge[:, 1] - h[:, 1] * edge[:, 0]).sum()) / 2), short, long


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("hull_area", "short", "long")]))
def _hulls(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for xs, ys in parts:
        rows = [_hull_area_and_sides(np.array([x, y], float).T) if x is not None and y is not None else (None,) * 3 for x, y in zip(xs, ys, strict=True)]
        yield pd.DataFrame(rows, columns=["hull_area", "short", "long"], dtype=float)


def shape_measures(buildings: DataFrame) -> DataFrame:
    """area, perimeter, elongation and equivalent-rectangle index (both of the smallest rotated rectangle), convexity of each ring.

    The last three are null for rings without area.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    name = next(n for n in ("__hull" + "_" * i for i in range(len(buildings.columns) + 1)) if n not in buildings.columns)
    h = F.col(name)
    rows = buildings.withColumn(name, _hulls(xs, ys)).withColumns({"area": G.area(F.col("ring")), "perimeter": G.perimeter(F.col("ring"))})
    eri = F.sqrt(F.col("area") / (h["short"] * h["long"])) * 2 * (h["short"] + h["long"]) / F.col("perimeter")
    return rows.withColumns({"elongation": h["short"] / h["long"], "eri": eri, "convexity": F.col("area") / h["hull_area"]}).drop(name)


def linearity(line: Column) -> Column:
    """Distance between a line's ends over its length; null without a length."""
    length = G.perimeter(line)
    first, last = line[0], F.element_at(line, -1)
    return F.when(length > 0, F.sqrt((last["x"] - first["x"]) ** 2 + (last["y"] - first["y"]) ** 2) / length)


def wall_pairs(buildings: DataFrame, tolerance: float = 1e-3, cell: float = 32.0) -> DataFrame:
    """(id, other, shared): length of the walls that two footprints (id, ring) have in common, seen from both.

    Walls meet by the line they lie on (direction and offset, to ``tolerance``) and by ``cell`` along it, so a long
    street front is many small groups; what overlaps inside a cell adds up. Footprints must not cover each other.
    """
    ends = F.explode(F.zip_with(F.slice("ring", F.lit(1), F.size("ring") - 1), F.slice("ring", F.lit(2), F.size("ring") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q"))))
    e = buildings.where(F.size("ring") > 1).select("id", ends.alias("e")).select("id", F.col("e.p.x").alias("px"), F.col("e.p.y").alias("py"), F.col("e.q.x").alias("qx"), F.col("e.q.y").alias("qy"))
    angle = F.pmod(F.atan2(F.col("qy") - F.col("py"), F.col("qx") - F.col("px")) + 1e-7, F.lit(math.pi)) - 1e-7
    e = e.where("px <> qx or py <> qy").withColumn("angle", F.round(angle, 6))
    ux, uy = F.cos("angle"), F.sin("angle")
    p, q = F.col("px") * ux + F.col("py") * uy, F.col("qx") * ux + F.col("qy") * uy
    walls = e.select("id", "angle", F.floor((F.col("py") * ux - F.col("px") * uy) / tolerance + 0.5).alias("offset"), F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"))
    walls = walls.withColumn("at", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    walls = walls.withColumns({"lo": F.greatest("lo", F.col("at") * cell), "hi": F.least("hi", (F.col("at") + 1) * cell)})
    # A wall whose offset lies at the rim of its step is met from the next step as well.
    other = walls.withColumn("offset", F.explode(F.array(F.col("offset") - 1, F.col("offset"), F.col("offset") + 1))).select(F.col("id").alias("other"), "angle", "offset", "at", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = walls.join(shuffled(other), ["angle", "offset", "at"]).where("id <> other").select("id", "other", (F.least("hi", "hi2") - F.greatest("lo", "lo2")).alias("both")).where("both > 0")
    return met.groupBy("id", "other").agg(F.sum("both").alias("shared"))


def shared_walls(buildings: DataFrame, tolerance: float = 1e-3, cell: float = 32.0) -> DataFrame:
    """(id, shared, share): length of the walls that a footprint has in common with others (see ``wall_pairs``), and over its perimeter."""
    per = wall_pairs(buildings, tolerance, cell).groupBy("id").agg(F.sum("shared").alias("shared"))
    out = buildings.select("id", G.perimeter(F.col("ring")).alias("perimeter")).join(shuffled(per), "id", "left")
    return out.select("id", F.coalesce("shared", F.lit(0.0)).alias("shared"), F.when(F.col("perimeter") > 0, F.coalesce("shared", F.lit(0.0)) / F.col("perimeter")).alias("share"))


def neighbour_distance(buildings: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, distance): mean distance from a footprint to those of its neighbours over edges (a, b), seen from both ends; null without any."""
    rings = buildings.select("id", "ring")
    pairs = edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(shuffled(rings.select(F.col("id").alias("a"), F.col("ring").alias("ring_a"))), "a").join(shuffled(rings.select(F.col("id").alias("b"), F.col("ring").alias("ring_b"))), "b")
    far = pairs.select("a", "b", G.distance(F.col("ring_a"), F.col("ring_b")).alias("d"))
    per = far.select(F.explode(F.array("a", "b")).alias("id"), "d").groupBy("id").agg(F.avg("d").alias("distance"))
    return buildings.select("id").join(shuffled(per), "id", "left")


def covered_area(edges: DataFrame, areas: DataFrame) -> DataFrame:
    """Sum, mean and count of the neighbours' areas over edges (a, b) seen from both ends."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    per = both.join(shuffled(areas.select(F.col("id").alias("b"), "area")), "b").groupBy("a").agg(F.sum("area").alias("covered_area"), F.avg("area").alias("mean_area"), F.count("*").alias("neighbours"))
    return areas.select("id").join(shuffled(per), areas["id"] == per["a"], "left").select("id", F.coalesce("covered_area", F.lit(0.0)).alias("covered_area"), "mean_area", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def node_degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def neighbour_percentiles(edges: DataFrame, values: DataFrame, column: str, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Percentiles of a column over each node's neighbours."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    per = both.join(shuffled(values.select(F.col("id").alias("b"), column)), "b").groupBy("a").agg(F.percentile(column, F.array(*map(F.lit, at))).alias("p"))
    return per.select(F.col("a").alias("id"), *[F.col("p")[i].alias(f"{column}_p{round(q * 100)}") for i, q in enumerate(at)])


def zscore(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns less their mean over their sample deviation; one row of moments is joined."""
    m = rows.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = rows.crossJoin(F.broadcast(m))
    return out.withColumns({f"{c}_z": (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}") for c in columns}).drop(*m.columns)


def numeric_features(rows: DataFrame, skip: tuple[str, ...] = ("id",)) -> list[str]:
    return [n for n, t in rows.dtypes if t in ("int", "bigint", "float", "double", "smallint") and n not in skip]


def clusters(rows: DataFrame, columns: list[str], k: int, seed: int = 42, starts: int = 10) -> DataFrame:
    """id, cluster, colour by k-means on standardised columns, the best of ``starts``; an error if there are fewer rows than clusters or k is over 11."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    if not 1 <= k <= min(11, rows.limit(11).count()):
        raise ValueError("k has to be between 1 and the number of rows, 11 at most")
    z = zscore(rows.na.fill(0.0, columns), *columns).na.fill(0.0, [f"{c}_z" for c in columns])
    table = VectorAssembler(inputCols=[f"{c}_z" for c in columns], outputCol="features").transform(z).select("id", "features").persist()
    tried = [KMeans(k=k, seed=seed + i, maxIter=50).fit(table) for i in range(starts)]
    out = min(tried, key=lambda m: m.summary.trainingCost).transform(table)
    palette = F.array(*map(F.lit, TAB10))
    first = out.groupBy("prediction").agg(F.min("id").alias("first"))
    ranked = first.withColumn("n", F.row_number().over(Window.orderBy("first")) - 1)  # k rows
    return out.join(F.broadcast(ranked), "prediction").select("id", F.col("prediction").alias("cluster"), F.element_at(palette, (F.col("n") % 10 + 1).cast("int")).alias("color"))


def tessellation_areas(buildings: DataFrame, cells: DataFrame) -> DataFrame:
    """Building over cell area (CAR) from nearest-building cells (id, cells, cell_area)."""
    return buildings.join(shuffled(cells), "id").withColumn("car", F.col("area") / F.col("cell_area"))
