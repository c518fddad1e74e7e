"""Distances of float vectors, added up in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """With the norm of a zero vector taken as one."""
    one = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def normalised(a: Column) -> Column:
    return F.transform(a, lambda x: (x / norm(a)).cast("float"))


def rank_weight(rank: Column) -> Column:
    """From 1 for rank 1 down to 0.2 for rank 100 and later; 1 without a rank."""
    return F.coalesce(1.0 - 0.8 * F.least(rank - 1, F.lit(99)) / 99.0, F.lit(1.0))
