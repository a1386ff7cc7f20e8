"""Statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(hits: Column, total: Column) -> Column:
    """struct(lo, hi) of the 95 % score interval; null without cases."""
    n = total.cast("double")
    p = hits / n
    centre = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    return F.when(total > 0, F.struct(F.greatest(F.lit(0.0), centre - half).alias("lo"), F.least(F.lit(1.0), centre + half).alias("hi")))


def exclusive_quantile(ordered: Column, p: float) -> Column:
    """Quantile at rank p * (n + 1) of a sorted array, interpolated and held inside the array."""
    n = F.size(ordered)
    rank = F.lit(p) * (n + 1)
    at = F.greatest(F.lit(1), F.least(F.floor(rank).cast("int"), n - 1))
    low, high = F.element_at(ordered, at), F.element_at(ordered, at + 1)
    return F.when(n >= 2, low + (high - low) * (rank - at))


def mad(values: Column, centre: Column) -> Column:
    """Median absolute deviation of an array around its median."""
    return median_of(F.transform(values, lambda x: F.abs(x - centre)))


def median_of(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(s)
    return F.when(n > 0, (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2 + 1).cast("int"))) / 2.0)
