"""Places of values among sorted bounds, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rank_below(column: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are smaller, by binary search within the plan; null for null."""
    if not bounds:
        return F.when(column.isNotNull(), F.lit(0))
    known, n = F.lit(bounds).cast("array<long>"), len(bounds)
    steps = F.lit([1 << i for i in reversed(range(n.bit_length()))])
    step = lambda at, s: F.when((at + s <= n) & (F.get(known, at + s - 1) < column), at + s).otherwise(at)
    return F.when(column.isNotNull(), F.aggregate(steps, F.lit(0), step))


def instant(column: Column, kind: T.DataType) -> Column:
    """A whole number that rises with a date, a time or a whole number; several times may share one."""
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):  # by its own fields: no time zone comes in
        return F.unix_date(column.cast("date")).cast("long") * 86400 + F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)
    if isinstance(kind, T.IntegralType):
        return column.cast("long")
    raise TypeError(f"{kind.simpleString()} is not a time")
