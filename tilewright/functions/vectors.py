"""Columns over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products from the first component to the last."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to [-1, 1]; null where either vector has no length."""
    long = norm(a) * norm(b)
    return F.when(long > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / long)))


def euclidean(a: Column, b: Column) -> Column:
    apart = F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    """The vector scaled to length one; null for a vector of no length."""
    long = norm(a)
    return F.when(long > 0, F.transform(doubles(a), lambda x: x / long))
