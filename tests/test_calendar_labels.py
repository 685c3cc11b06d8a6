import datetime as dt

from pyspark.sql import functions as F

from tideline.functions import calendar as cal
from tideline.functions import labels, nulls

D = dt.date.fromisoformat


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_quarters(spark):
    assert one(spark, cal.quarter_start("d"), d=D("2024-05-18")) == D("2024-04-01")
    assert one(spark, cal.quarter_start("d"), d=D("2024-12-31")) == D("2024-10-01")
    assert one(spark, cal.last_completed_quarter("d"), d=D("2024-05-18")) == D("2024-01-01")
    assert one(spark, cal.last_completed_quarter("d"), d=D("2024-01-01")) == D("2023-10-01")
    assert len(one(spark, cal.quarters("a", "b"), a=D("2023-01-15"), b=D("2024-02-15"))) == 5
    assert len(one(spark, cal.quarters("a", "b"), a=D("2020-01-01"), b=D("2021-04-01"))) == 6
    assert one(spark, cal.quarter_label("d"), d=D("2024-05-18")) == "2024 Q2"
    assert one(spark, cal.fy_start("d"), d=D("2024-06-30")) == D("2023-07-01") and one(spark, cal.fy_start("d"), d=D("2024-07-01")) == D("2024-07-01")


def test_first_observable(spark):
    for unit, period, lag, day in (("month", "2024-01-01", 35, "2024-03-07"), ("quarter", "2024-01-01", 183, "2024-10-01"), ("year", "2024-07-01", 45, "2025-08-15"), ("year", "2024-01-01", 0, "2025-01-01"), (None, "2024-01-01", 35, "2024-03-07")):
        assert one(spark, cal.first_observable("p", F.lit(unit), lag), p=D(period)) == D(day)


def test_labels_of_periods(spark):
    for text, day in (("2023-24", "2023-07-01"), ("2024", "2024-01-01"), ("2024-25 Q1", "2024-07-01"), ("2024-25 Q3", "2025-01-01"), ("x", None)):
        assert one(spark, cal.period_label("t"), t=text) == (day and D(day))
    for text in ("Jan-2024", "Jan 2024", "January 2024", "2024-01", "2024-01-15", "45292"):
        assert one(spark, cal.month_label("t"), t=text) == D("2024-01-01"), text
    assert one(spark, cal.month_label("t"), t="Series") is None and one(spark, cal.excel_date("n"), n=45292) == D("2024-01-01")
    assert [one(spark, cal.vintage_status("p", F.lit(D("2024-12-31")).cast("date")), p=D(p)) for p in ("2024-10-01", "2024-03-01", "2023-01-01")] == ["preliminary", "revised", "final"]


def test_classification(spark):
    for text, kind in (("500 — Student", "student"), ("482 Temporary Skill Shortage", "skilled"), ("417 Working Holiday", "working_holiday"), ("820 Partner", "family"), ("444 NZ", "nz_citizen"), ("whatever", "other")):
        assert one(spark, labels.subclass("t"), t=text) == kind
    for text, kind in (("Long-term Arrivals", "arrival"), ("LT departures", "departure"), ("Population", None)):
        assert one(spark, labels.direction("t"), t=text) == kind
    assert one(spark, labels.visa_group("t"), t="Permanent Visas - Total") is None
    assert one(spark, labels.visa_group("t"), t=" Temporary Student Visas - Higher Educ.(h)") == "student"
    assert one(spark, labels.dataset("t"), t="Visitor visas granted") == "visitor"
    assert one(spark, labels.regime_by_breaks("d", ["2020-03-01", "2022-03-01"]), d=D("2021-01-01")) == "R3"


def test_null_rules(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, None)], "k int, v double")
    got = {r.k: (r.a, r.b) for r in df.groupBy("k").agg(nulls.sum_or_zero("v").alias("a"), nulls.sum_strict("v").alias("b")).collect()}
    assert got == {1: (1.0, None), 2: (0.0, None)}
    assert one(spark, nulls.strict(F.greatest, F.lit(None).cast("double"), F.lit(0.0))) is None
    assert one(spark, nulls.clip(F.lit(9.0), 0.0, 1.5)) == 1.5 and one(spark, nulls.positive_log(F.lit(0.0))) is None
    assert one(spark, nulls.finite(F.lit(float("nan")))) is None and one(spark, nulls.ratio(F.lit(1.0), F.lit(0.0))) is None
