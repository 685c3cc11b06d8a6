import datetime as dt

import pytest

from tideline.operators import snapshots
from tideline.sources import tables

D = dt.date.fromisoformat


def test_wide_to_long(spark):
    df = spark.createDataFrame([("500 Student", "1,200", "x", "n"), ("417 WH", "5", None, "n"), ("a", "1", "2", "n"), ("b", "1", "2", "n"), ("b", "1", "2", "n")], "kind string, `Jul 2023` string, `2023-08` string, note string")
    assert tables.label_column(df) == "kind"
    got = sorted((r.label, r.category, str(r.period), r.value) for r in tables.wide_to_long(df).where("label like '%0%' or label like '4%'").collect())
    assert got == [("417 WH", "working_holiday", "2023-07-01", 5.0), ("500 Student", "student", "2023-07-01", 1200.0)]
    assert tables.label_column(df.withColumnRenamed("note", "Visa Subclass")) == "Visa Subclass"
    with pytest.raises(ValueError):
        tables.wide_to_long(df.select("kind", "note"))


def test_directed_flows(spark):
    df = spark.createDataFrame([("Jan-2024", "3", "1"), ("Feb-2024", "4", "x"), ("total", "7", "1")], "Month string, `Inbound pax` string, `Outbound pax` string")
    got = sorted((str(r.period), r.direction, r.value) for r in tables.directed_flows(df).collect())
    assert got == [("2024-01-01", "arrival", 3.0), ("2024-01-01", "departure", 1.0), ("2024-02-01", "arrival", 4.0)]
    with pytest.raises(ValueError):
        tables.directed_flows(df.select("Month"))
    units = spark.createDataFrame([(D("2024-04-01"),), (D("2024-05-01"),)], "p date").select(tables.stock_unit("p").alias("u"))
    assert [r.u for r in units.collect()] == ["quarter", "month"]


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(D("2024-01-01"), 1.0), (D("2024-04-01"), 2.0)], "period date, nom_mean double")
    snapshots.write_snapshot(df, str(tmp_path / "s"), "2024-05-01", model="bayes")
    data, meta = snapshots.read_snapshot(spark, str(tmp_path / "s"))
    assert data.count() == 2 and meta == {"asof_date": "2024-05-01", "rows": 2, "model": "bayes"}
    published = spark.createDataFrame([(D("2024-01-01"), 5.0)], "period date, nom_final double")
    assert snapshots.first_unpublished(df, published).first().period == D("2024-04-01")
    panel = spark.createDataFrame([(D("2024-01-01"), "total", 9.0, 3), (D("2024-04-01"), "total", 4.0, 1), (D("2024-07-01"), "total", None, None)], "period date, category string, oad_lt_arrivals double, oad_months int")
    assert tuple(snapshots.live_edge(panel).first()) == (D("2024-04-01"), 1)
