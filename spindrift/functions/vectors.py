"""Vector and box functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def blend(title: Column, content: Column, weight: float = 0.1) -> Column:
    return F.zip_with(title, content, lambda x, y: x.cast("double") * weight + y.cast("double") * (1 - weight))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """The area that boxes (x0, top, x1, bottom) share."""
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def overlap_share(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """The shared area over that of the first box; 0 for an empty box."""
    area = (a[2] - a[0]) * (a[3] - a[1])
    return F.when(area > 0, overlap(a, b) / area).otherwise(0.0)
