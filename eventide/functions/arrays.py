"""Vector arithmetic on array columns, inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null where the lengths differ."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l1(values: Column) -> Column:
    return total(F.transform(values, lambda x: F.abs(x.cast("double"))))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def relu(values: Column) -> Column:
    return F.transform(values, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))


def zeros(values: Column) -> Column:
    """How many values are exactly zero."""
    return F.size(F.filter(values, lambda x: x == 0)).cast("long")


def affine(values: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """``weights`` (a row for each output) times the vector, plus ``bias``: for small matrices, as literals of the plan."""
    return F.array(*[dot(values, F.array(*[F.lit(float(w)) for w in row])) + F.lit(float(b)) for row, b in zip(weights, bias, strict=True)])
