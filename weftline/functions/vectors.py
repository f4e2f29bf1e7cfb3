"""Arithmetic on arrays of numbers, in double precision and a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(1e-300)))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def steer_add(v: Column, direction: Column, coefficient: float) -> Column:
    """The direction, brought to the length of ``v`` times the coefficient, added to ``v``."""
    scale = norm(v) * F.lit(coefficient) / F.greatest(norm(direction), F.lit(1e-300))
    return F.zip_with(v, direction, lambda x, d: x + d * scale)


def steer_replace(v: Column, direction: Column, coefficient: float) -> Column:
    """The same in place of ``v``."""
    scale = norm(v) * F.lit(coefficient) / F.greatest(norm(direction), F.lit(1e-300))
    return F.transform(direction, lambda d: d * scale)


def threshold_relu(x: Column, threshold: Column | float) -> Column:
    """x where it exceeds the threshold, else 0; never negative."""
    return F.when(x > threshold, F.greatest(x, F.lit(0.0))).otherwise(F.lit(0.0))
