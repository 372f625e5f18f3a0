"""Geometry on rings, ``array<struct<x:double,y:double>>``, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column | float, y: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"))


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once: as a lambda's variable it isn't copied into every place that uses it."""
    return F.transform(F.array(value), f)[0]


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring of five points."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def circle(x: Column, y: Column, radius: Column | float, segments: int = 36) -> Column:
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    ring = F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: point(x + r * F.cos(i * (2 * math.pi / segments)), y + r * F.sin(i * (2 * math.pi / segments))))
    return F.concat(ring, F.slice(ring, 1, 1))


def _edges(ring: Column) -> Column:
    """Pairs of points, relative to the first point, which keeps large coordinates from cancelling."""
    a = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    b = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
    x0, y0 = ring[0]["x"], ring[0]["y"]
    return F.zip_with(a, b, lambda p, q: F.struct((p["x"] - x0).alias("ax"), (p["y"] - y0).alias("ay"), (q["x"] - x0).alias("bx"), (q["y"] - y0).alias("by")))


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, e: acc + f(e))


def _cross(e: Column) -> Column:
    return e["ax"] * e["by"] - e["bx"] * e["ay"]


def signed_area(ring: Column) -> Column:
    return bound(ring, _signed_area)


def _signed_area(ring: Column) -> Column:
    return F.when(F.size(ring) > 2, _sum(_edges(ring), _cross) / 2).otherwise(0.0)


def area(ring: Column, holes: Column | None = None) -> Column:
    """Unsigned; holes are taken off."""
    out = F.abs(signed_area(ring))
    return out if holes is None else out - F.coalesce(F.aggregate(holes, F.lit(0.0), lambda acc, h: acc + F.abs(signed_area(h))), F.lit(0.0))


def centroid(ring: Column) -> Column:
    """Of the area; (0, 0) for an empty ring, the vertex mean for one without area."""
    return bound(ring, _centroid)


def _centroid(ring: Column) -> Column:
    edges, twice = _edges(ring), signed_area(ring) * 2
    cx = _sum(edges, lambda e: (e["ax"] + e["bx"]) * _cross(e)) / (3 * twice)
    cy = _sum(edges, lambda e: (e["ay"] + e["by"]) * _cross(e)) / (3 * twice)
    mean = vertex_mean(ring)
    return F.when(F.coalesce(F.size(ring), F.lit(0)) < 1, point(0.0, 0.0)).when(twice == 0, mean).otherwise(point(ring[0]["x"] + cx, ring[0]["y"] + cy))


def vertex_mean(ring: Column) -> Column:
    """Mean of the vertices, the closing one left out."""
    return bound(ring, _vertex_mean)


def _vertex_mean(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(1))
    open_ring = F.slice(ring, F.lit(1), n)
    return point(_sum(open_ring, lambda p: p["x"]) / n, _sum(open_ring, lambda p: p["y"]) / n)


def envelope(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def circumscribed_radius(ring: Column) -> Column:
    """The farthest vertex from the centre of the envelope."""
    return bound(F.struct(ring.alias("ring"), envelope(ring).alias("e")), lambda v: _farthest(v["ring"], v["e"]))


def _farthest(ring: Column, e: Column) -> Column:
    cx, cy = (e["min_x"] + e["max_x"]) / 2, (e["min_y"] + e["max_y"]) / 2
    return F.array_max(F.transform(ring, lambda p: F.sqrt((p["x"] - cx) * (p["x"] - cx) + (p["y"] - cy) * (p["y"] - cy))))


def perimeter(ring: Column) -> Column:
    return _sum(_edges(ring), lambda e: F.sqrt((e["bx"] - e["ax"]) * (e["bx"] - e["ax"]) + (e["by"] - e["ay"]) * (e["by"] - e["ay"])))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting; points on a left or lower side may count as inside, as the half-open rule has it."""
    a = F.slice(ring, F.lit(1), F.size(ring) - 1)
    b = F.slice(ring, F.lit(2), F.size(ring) - 1)
    crosses = F.zip_with(a, b, lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]))
    return F.aggregate(crosses, F.lit(False), lambda acc, c: acc != F.coalesce(c, F.lit(False)))


def strictly_contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting with the boundary left out."""
    a = F.slice(ring, F.lit(1), F.size(ring) - 1)
    b = F.slice(ring, F.lit(2), F.size(ring) - 1)

    def on_edge(p: Column, q: Column) -> Column:
        flat = (q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"])
        return flat & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    return contains(ring, x, y) & ~F.exists(F.zip_with(a, b, on_edge), lambda v: v)


def _to_segments(x: Column, y: Column, ring: Column) -> Column:
    """Smallest squared distance from a point to a ring's sides."""

    def one(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - p["x"]) * dx + (y - p["y"]) * dy) / square))).otherwise(0.0)
        ex, ey = p["x"] + t * dx - x, p["y"] + t * dy - y
        return ex * ex + ey * ey

    return F.array_min(F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), one))


def distance(a: Column, b: Column) -> Column:
    """Between two rings whose sides don't cross: from the corners of either to the sides of the other; 0 where one holds a corner of the other."""

    def of(v: Column) -> Column:
        near = F.array_min(F.concat(F.transform(v["a"], lambda p: _to_segments(p["x"], p["y"], v["b"])), F.transform(v["b"], lambda p: _to_segments(p["x"], p["y"], v["a"]))))
        inside = F.exists(v["a"], lambda p: contains(v["b"], p["x"], p["y"])) | F.exists(v["b"], lambda p: contains(v["a"], p["x"], p["y"]))
        return F.when(inside, 0.0).otherwise(F.sqrt(near))

    return bound(F.struct(a.alias("a"), b.alias("b")), of)


def boxes_overlap(a: Column, b: Column) -> Column:
    """Closed envelopes: touching counts."""
    return (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])


def _clip_side(ring: Column, inside, cut) -> Column:
    """One half-plane of Sutherland and Hodgman's clip, on a closed ring."""
    none = F.array().cast("array<struct<x:double,y:double>>")

    def clipped(r: Column) -> Column:
        n = F.greatest(F.size(r) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(r, F.lit(1), n), F.slice(r, F.lit(2), n), lambda p, q: F.when(inside(p) & inside(q), F.array(q)).when(inside(p), F.array(cut(p, q))).when(inside(q), F.array(cut(p, q), q)).otherwise(none))
        return bound(F.flatten(pairs), lambda kept: F.when(F.size(kept) > 0, F.concat(kept, F.slice(kept, 1, 1))).otherwise(kept))

    return bound(ring, clipped)


def clip_to_box(ring: Column, box: Column) -> Column:
    """The part of a ring inside a box (exact for convex rings; concave ones may keep zero-width bridges)."""
    at_x = lambda x: lambda p, q: point(x, p["y"] + (q["y"] - p["y"]) * (x - p["x"]) / (q["x"] - p["x"]))
    at_y = lambda y: lambda p, q: point(p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]), y)
    out = _clip_side(ring, lambda p: p["x"] >= box["min_x"], at_x(box["min_x"]))
    out = _clip_side(out, lambda p: p["x"] <= box["max_x"], at_x(box["max_x"]))
    out = _clip_side(out, lambda p: p["y"] >= box["min_y"], at_y(box["min_y"]))
    return _clip_side(out, lambda p: p["y"] <= box["max_y"], at_y(box["max_y"]))


def intersects_box(ring: Column, box: Column) -> Column:
    """Exact against a box: envelopes first, then whether anything of the ring is left inside."""
    return boxes_overlap(envelope(ring), box) & (F.size(clip_to_box(ring, box)) > 0)
