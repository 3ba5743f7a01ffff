"""Expressions over dense vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; zero when either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def clip_similarity(score: Column) -> Column:
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))
