"""Column expressions for boxes [x0, y0, x1, y1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(*(c.cast("double") for c in (x0, y0, x1, y1)))


def inflate(b: Column, by: float) -> Column:
    return F.array(b[0] - by, b[1] - by, b[2] + by, b[3] + by)


def intersects(a: Column, b: Column) -> Column:
    """Closed: boxes that touch intersect."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def area(b: Column) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = area(a) + area(b) - overlap(a, b)
    return F.when(both > 0, overlap(a, b) / both).otherwise(F.lit(0.0))


def clamp(b: Column, width: Column, height: Column, least: int = 3) -> Column:
    """Whole pixels inside the page; null if a side is under ``least``."""
    out = F.array(F.greatest(F.floor(b[0]), F.lit(0)), F.greatest(F.floor(b[1]), F.lit(0)), F.least(F.ceil(b[2]), width), F.least(F.ceil(b[3]), height))
    return F.when((out[2] - out[0] >= least) & (out[3] - out[1] >= least), out)


def from_points(points: Column) -> Column:
    """The rectangle around a polygon of [x, y] points, or a flat box as it is; null for anything else."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(F.size(points) >= 3, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def from_thousandths(b: Column, width: Column, height: Column) -> Column:
    """[y1, x1, y2, x2] on 0-1000 to pixels; empty unless it has four numbers."""
    out = F.array(b[1] * width / 1000, b[0] * height / 1000, b[3] * width / 1000, b[2] * height / 1000)
    return F.when(F.size(b) == 4, out).otherwise(F.array().cast("array<double>"))


def to_thousandths(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """COCO [x, y, w, h] to [y1, x1, y2, x2] on 0-1000, rounded half to even."""
    return F.array(*(F.bround(v, 0).cast("int") for v in (y / height * 1000, x / width * 1000, (y + h) / height * 1000, (x + w) / width * 1000)))


def union_of(b: Column) -> Column:
    """Aggregate: the box around all boxes."""
    return F.array(F.min(b[0]), F.min(b[1]), F.max(b[2]), F.max(b[3]))
