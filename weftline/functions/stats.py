"""Interval and score columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def share(hits: Column, n: Column) -> Column:
    """hits / n, 0 for nothing."""
    return F.when(n > 0, hits / n).otherwise(F.lit(0.0))


def binomial_error(p: Column, n: Column) -> Column:
    return F.when(n > 0, F.sqrt(p * (1 - p) / n)).otherwise(F.lit(0.0))


def binomial_low(p: Column, n: Column, z: float = Z) -> Column:
    return F.greatest(F.lit(0.0), p - z * binomial_error(p, n))


def binomial_high(p: Column, n: Column, z: float = Z) -> Column:
    return F.when(n > 0, F.least(F.lit(1.0), p + z * binomial_error(p, n))).otherwise(F.lit(0.0))


def mean_margin(value: Column, z: float = Z) -> Column:
    """Aggregate: z times the sample deviation over the root of the count; null for a single value."""
    return z * F.stddev_samp(value) / F.sqrt(F.count(value))


def precision(predicted: Column, true: Column) -> Column:
    return share(F.size(F.array_intersect(predicted, true)), F.size(F.array_distinct(predicted)))


def recall(predicted: Column, true: Column) -> Column:
    return share(F.size(F.array_intersect(predicted, true)), F.size(F.array_distinct(true)))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
