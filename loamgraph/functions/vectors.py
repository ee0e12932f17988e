"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def normalized(vector: Column) -> Column:
    """The vector over its length; zeros stay zeros."""
    n = norm(vector)
    return F.when(n > 0, F.transform(vector, lambda x: x / n)).otherwise(vector)


def dot(left: Column, right: Column) -> Column:
    """Over the dimensions that both have; 0 if there are none."""
    both = F.least(F.size(left), F.size(right))
    return F.aggregate(F.zip_with(F.slice(left, 1, both), F.slice(right, 1, both), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(left: Column, right: Column) -> Column:
    return dot(normalized(left), normalized(right))


def is_finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
