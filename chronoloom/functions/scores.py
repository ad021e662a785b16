"""Column functions for scores: precision and recall, rates, sigmoid, similarity of vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def precision(hits: Column, false_alarms: Column) -> Column:
    return hits / F.greatest(F.lit(1), hits + false_alarms)


def recall(hits: Column, misses: Column) -> Column:
    return hits / F.greatest(F.lit(1), hits + misses)


def f1(p: Column, r: Column) -> Column:
    return 2 * p * r / F.greatest(F.lit(1e-12), p + r)


def error_rate(distance: Column, reference: Column, hypothesis: Column) -> Column:
    """Distance per unit of the reference; without one, 0 if the hypothesis is empty too, else 1."""
    return F.when(reference > 0, distance / reference).otherwise(F.when(hypothesis == 0, 0.0).otherwise(1.0))


def normalised_distance(distance: Column, left: Column, right: Column) -> Column:
    """Distance per unit of the longer side, 0 if both are empty."""
    return F.when(F.greatest(left, right) > 0, distance / F.greatest(left, right)).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """-1 where a vector has no length."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(-1.0)


def truncated_percentile(values: Column, q: float) -> Column:
    """The sorted value at the index (n - 1) q, cut to a whole number; null for no values."""
    at = F.floor((F.size(values) - 1) * F.lit(q)).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), F.greatest(at, F.lit(1))))
