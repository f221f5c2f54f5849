"""Vector arithmetic on ARRAY<DOUBLE> columns, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def total(values: Column | str) -> Column:
    """Sum of an ARRAY<DOUBLE>."""
    return _sum(values)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def unit(a: Column) -> Column:
    """a / (|a| + 1e-8), as feature extractors return it."""
    n = norm(a) + F.lit(1e-8)
    return F.transform(a, lambda x: x / n)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Of unit vectors."""
    return dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def mean(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double"))) / F.size(a)


def mean_abs_diff(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))) / F.size(a)
