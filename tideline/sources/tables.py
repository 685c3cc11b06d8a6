"""Wide and irregular tables as long observations: which column is the label, which are periods, which are dates and flows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels
from ..functions.calendar import month_label, month_start, period_label

#: Names under which a label column is known.
LABEL_NAMES = ("visa subclass", "subclass", "visa_subclass", "visa", "category")
#: Column names that look like a period.
PERIOD_NAME = re.compile(r"^\s*([A-Za-z]{3,9}[ -]\d{4}|\d{4}-\d{2}(-\d{2})?|\d{4}|\d{4}-\d{2}\s*Q[1-4])\s*$")
INBOUND, OUTBOUND = r"(?i)inbound|arriv", r"(?i)outbound|depart"


def label_column(df: DataFrame) -> str | None:
    """The column named like a label, else the first string column with more than 3 and fewer values than there are rows."""
    known = {c.strip().lower(): c for c in df.columns}
    for name in LABEL_NAMES:
        if name in known:
            return known[name]
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and not PERIOD_NAME.match(f.name)]
    if not strings:
        return None
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_distinct(f"`{c}`").alias(c) for c in strings)).first()
    return next((c for c in strings if 3 < counts[c] < counts["_n"]), None)


def wide_to_long(df: DataFrame, label: str | None = None) -> DataFrame:
    """label, category, period, value of a table with a column for each period; what is no number is left out. No label or period column: ValueError."""
    label = label or label_column(df)
    periods = [c for c in df.columns if c != label and PERIOD_NAME.match(c)]
    if label is None or not periods:
        raise ValueError("no label column or no period columns")
    text = df.select(F.col(f"`{label}`").cast("string").alias("label"), *(F.regexp_replace(F.col(f"`{c}`").cast("string"), ",", "").alias(c) for c in periods))
    long = text.unpivot(["label"], [F.col(f"`{c}`") for c in periods], "head", "text")
    value = F.col("text").try_cast("double")
    period = F.coalesce(month_label("head"), period_label("head"))
    return long.select("label", labels.subclass("label").alias("category"), period.alias("period"), value.alias("value")).where("value is not null and period is not null")


def date_column(df: DataFrame) -> str | None:
    """The first date or timestamp column, else the first of which more than half can be read as a month."""
    for f in df.schema:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return f.name
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return None
    share = df.agg(*(F.avg(month_label(F.col(f"`{c}`")).isNotNull().cast("double")).alias(c) for c in texts)).first()
    return next((c for c in texts if (share[c] or 0) > 0.5), None)


def directed_flows(df: DataFrame) -> DataFrame:
    """period, direction, value: the inbound and outbound columns, by their names, as two kinds of rows. Without a date column or either of them: ValueError."""
    date = date_column(df)
    sides = [(next((c for c in df.columns if c != date and re.search(p, c)), None), d) for p, d in ((INBOUND, "arrival"), (OUTBOUND, "departure"))]
    if date is None or not any(c for c, _ in sides):
        raise ValueError("no date column or no flow columns")
    period = month_start(date) if not isinstance(df.schema[date].dataType, T.StringType) else month_label(F.col(f"`{date}`"))
    rows = [df.select(period.alias("period"), F.lit(d).alias("direction"), F.col(f"`{c}`").try_cast("double").alias("value")) for c, d in sides if c]
    out = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    return out.where("period is not null and value is not null")


def stock_unit(period: str) -> Column:
    """quarter for the first day of a quarter's first month, else month."""
    return F.when(F.trunc(period, "quarter") == F.col(period), "quarter").otherwise("month")
