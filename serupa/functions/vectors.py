"""Vector arithmetic on ARRAY columns, always in DOUBLE."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from serupa.functions.binding import bind

EPSILON = 1e-9


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(vector), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a (nearly) zero vector is returned unchanged."""

    def divide(v: Column) -> Column:
        return bind(norm(v), lambda n: F.when(n > EPSILON, F.transform(v, lambda x: x / n)).otherwise(v))

    return bind(doubles(vector), divide)


def scale(vector: Column, weight: Column) -> Column:
    return bind(weight, lambda w: F.transform(doubles(vector), lambda x: x * w))


def _add(total: Column, part: Column) -> Column:
    return bind(
        F.struct(total.alias("t"), part.alias("p")),
        lambda s: F.when(s["p"].isNull(), s["t"]).otherwise(F.zip_with(s["t"], s["p"], lambda x, y: x + y)),
    )


def weighted_sum(vectors: Sequence[Column], weights: Sequence[Column]) -> Column:
    """Sum of ``vector * weight`` in the given order; a null vector after the first adds nothing."""
    first, *rest = [scale(vector, weight) for vector, weight in zip(vectors, weights, strict=True)]
    return reduce(_add, rest, first)


def weighted_embedding(vectors: Sequence[Column], weights: Sequence[Column]) -> Column:
    return l2_normalize(weighted_sum(vectors, weights)).cast("array<float>")
