"""Rounding rules and exact statistics that do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up_int(col: Column) -> Column:
    """Nearest integer, halves upwards."""
    return F.floor(col + F.lit(0.5)).cast("long")


def mean(col: Column) -> Column:
    """Mean of a decimal column: exact sum, one division."""
    return F.sum(col).cast("double") / F.count(col)


def mean_2dp(col: Column) -> Column:
    """Mean of a decimal(3,2) column rounded half away from zero to 2 places."""
    total = F.sum(col).cast("decimal(28,10)")
    return F.round(total / F.count(col).cast("decimal(18,0)"), 2).cast("double")


def stddev_pop_exact(col: Column) -> Column:
    """Population standard deviation of a decimal(3,2) column.

    Works on whole hundredths, so the sums are integers and the value is the
    same whatever the partitioning or merge order.
    """
    hundredths = (col * 100).cast("long")
    n = F.count(col)
    total = F.sum(hundredths)
    squares = F.sum(hundredths * hundredths)
    return F.sqrt((n * squares - total * total).cast("double")) / (n * 100)


def clamp(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))
