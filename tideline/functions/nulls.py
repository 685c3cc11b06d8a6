"""Sums, extremes and ratios with the null rules that the series need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def sum_or_zero(x) -> Column:
    """Nulls left out; nothing sums to 0."""
    return F.coalesce(F.sum(_col(x)), F.lit(0.0))


def sum_strict(x) -> Column:
    """Null if any value is."""
    return F.when(F.count(_col(x)) == F.count(F.lit(1)), F.sum(_col(x)))


def strict(f, *xs) -> Column:
    """greatest or least that is null if any argument is."""
    known = reduce(lambda a, b: a & b, (_col(x).isNotNull() for x in xs))
    return F.when(known, f(*(_col(x) for x in xs)))


def clip(x, low: float, high: float) -> Column:
    return F.when(_col(x).isNotNull(), F.least(F.greatest(_col(x), F.lit(low)), F.lit(high)))


def ratio(a, b) -> Column:
    return F.try_divide(_col(a), _col(b))


def positive_log(x) -> Column:
    """The natural logarithm of a positive number, null of others."""
    return F.when(_col(x) > 0, F.ln(_col(x)))


def finite(x) -> Column:
    x = _col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)
