"""Arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    length = F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0))
    return F.transform(a, lambda x: x.cast("double") / length)


def euclidean(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(_total(F.transform(gap, lambda d: d * d)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine; a zero vector is at distance 1 from everything."""
    return F.lit(1.0) - F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def distance(metric: str):
    """Distance function by name."""
    known = {"euclidean": euclidean, "cosine": cosine_distance}
    if metric not in known:
        raise ValueError(f"unknown distance {metric!r}; use one of {sorted(known)}")
    return known[metric]
