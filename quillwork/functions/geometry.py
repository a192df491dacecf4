"""Geometry of normalised boxes and polygons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def clamp_points(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(clamp01(F.get(p, F.lit(0))), clamp01(F.get(p, F.lit(1)))))


def xs(points: Column) -> Column:
    return F.transform(points, lambda p: F.get(p, F.lit(0)))


def ys(points: Column) -> Column:
    return F.transform(points, lambda p: F.get(p, F.lit(1)))


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def bounds(points: Column) -> Column:
    """Bounding rectangle of the points."""
    def around(p: Column) -> Column:
        a, b = xs(p), ys(p)
        return rect(F.array_min(a), F.array_min(b), F.array_max(a) - F.array_min(a), F.array_max(b) - F.array_min(b))

    return F.get(F.transform(F.array(points), around), F.lit(0))  # named once, so the points are worked out once


def polygon_area(points: Column) -> Column:
    """Shoelace area, pairing each point with its successor."""
    turned = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    crosses = F.zip_with(points, turned, lambda p, q: (
        F.get(p, F.lit(0)) * F.get(q, F.lit(1)) - F.get(q, F.lit(0)) * F.get(p, F.lit(1))))
    total = F.aggregate(crosses, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(points) >= 3, F.abs(total) / 2).otherwise(0.0)


def bbox_rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A box clamped into the frame, NULL when a side is missing."""
    x0, y0 = clamp01(x), clamp01(y)
    inside = rect(x0, y0, F.greatest(F.lit(0.0), F.least(w, 1 - x0)), F.greatest(F.lit(0.0), F.least(h, 1 - y0)))
    return F.when(x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull(), inside)
