"""Null-safe arithmetic shared by every operator.

Missing values are NULL throughout, never NaN: a NaN would poison a sum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(c: Column | str) -> Column:
    """Sum that skips missing values; the sum of nothing is zero."""
    return F.coalesce(F.sum(as_column(c)), F.lit(0))


def safe_div(a: Column, b: Column) -> Column:
    """Division in doubles; a zero divisor gives NULL instead of an ANSI error."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def round_half_even(c: Column, places: int = 2) -> Column:
    """Scale, round half to even, scale back (``round`` and ``bround`` work on the
    decimal text of the double and differ on values such as 1.005)."""
    scale = float(10**places)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def percent_of(part: Column, whole: Column, places: int = 2) -> Column:
    return round_half_even(safe_div(part, whole) * F.lit(100.0), places)


def percent_change(previous: Column, current: Column) -> Column:
    """``(current - previous) / previous * 100``."""
    return safe_div(current - previous, previous) * F.lit(100.0)
