"""Aggregates with fixed edge cases: ratios without a denominator, sums that null poisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """0.0 where the denominator is zero or null."""
    return F.when(F.coalesce(denominator, F.lit(0)) != 0, numerator / denominator).otherwise(0.0)


def linear_percentile(value: Column, q: float) -> Column:
    """Linear interpolation at (n-1)q."""
    return F.percentile(value, F.lit(q))


def poisoned_sum(value: Column) -> Column:
    """The sum, or null if any value is null or there is none."""
    return F.when((F.count(F.lit(1)) == F.count(value)) & (F.count(value) > 0), F.sum(value))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
