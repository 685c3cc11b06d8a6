"""Periods as columns: quarters, financial years, publication dates, labels. A period is the first day of its month, quarter or year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first month of a financial year.
FY_MONTH = 7


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def quarter_start(d) -> Column:
    return F.trunc(_col(d), "quarter")


def month_start(d) -> Column:
    return F.trunc(_col(d), "month")


def fy_start(d, month: int = FY_MONTH) -> Column:
    """The first day of the financial year that holds d."""
    d = _col(d)
    return F.add_months(F.trunc(F.add_months(d, 1 - month), "year"), month - 1)


def last_completed_quarter(d) -> Column:
    return F.add_months(quarter_start(d), -3)


def quarters(first, last) -> Column:
    """An array of all quarter starts from that of first to that of last."""
    return F.sequence(quarter_start(first), quarter_start(last), F.expr("interval 3 months"))


def quarter_label(d, sep: str = " ") -> Column:
    d = _col(d)
    return F.concat(F.year(d).cast("string"), F.lit(f"{sep}Q"), F.quarter(d).cast("string"))


def first_observable(period, unit, lag_days) -> Column:
    """The day on which a figure for a period is out: the day after the period's end plus the publication lag. An unknown unit counts as a month."""
    p, unit, lag = _col(period), _col(unit), _col(lag_days) if not isinstance(lag_days, int) else F.lit(lag_days)
    after = F.when(unit == "year", F.add_months(p, 12)).when(unit == "quarter", F.add_months(quarter_start(p), 3)).otherwise(F.add_months(month_start(p), 1))
    return F.date_add(after, lag)


def horizon(period, reference) -> Column:
    """Whole quarters from reference to period, both quarter starts."""
    return (F.months_between(_col(period), _col(reference)) / 3).cast("int")


def vintage_status(period, asof, days: int = 90) -> Column:
    """preliminary below three lots of 90 days since the period's start, revised below six, final from there."""
    age = F.datediff(_col(asof), _col(period)) / F.lit(days)
    return F.when(age < 3, "preliminary").when(age < 6, "revised").otherwise("final")


def excel_date(serial) -> Column:
    """The day of a spreadsheet's serial number."""
    return F.date_add(F.lit("1899-12-30").cast("date"), _col(serial).cast("int"))


def month_label(text) -> Column:
    """The month that a label names: Mon-YYYY, Mon YYYY, Month YYYY, YYYY-MM, YYYY-MM-DD or a serial number from 30000 to 60000; null for anything else."""
    t = F.trim(_col(text))
    day = F.coalesce(*(F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("MMM-yyyy", "MMM yyyy", "MMMM yyyy", "yyyy-MM", "yyyy-MM-dd")))
    serial = F.when(t.rlike(r"^\d{5}(\.\d+)?$"), t.try_cast("double"))
    return month_start(F.coalesce(day, F.when(serial.between(30000, 60000), excel_date(serial))))


def period_label(text) -> Column:
    """The first day of YYYY-YY (financial year), YYYY (calendar year) or YYYY-YY Qn (quarter of a financial year, which begins in July); null otherwise."""
    t = _col(text)
    year = F.regexp_extract(t, r"^(\d{4})", 1).try_cast("int")
    part = F.regexp_extract(t, r"^\d{4}-\d{2}\s*Q([1-4])$", 1).try_cast("int")
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}$"), F.make_date(year, F.lit(FY_MONTH), F.lit(1)))
        .when(t.rlike(r"^\d{4}$"), F.make_date(year, F.lit(1), F.lit(1)))
        .when(part.isNotNull(), F.add_months(F.make_date(year, F.lit(FY_MONTH), F.lit(1)), 3 * (part - 1)))
    )


def label_unit(text) -> Column:
    return F.when(_col(text).rlike(r"Q[1-4]$"), "quarter").otherwise("year")
