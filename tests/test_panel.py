import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.operators import panel, ratios, scoring, vintages
from tideline.operators.store import VintageStore

D = dt.date.fromisoformat
FLOW = "period date, category string, direction string, value double"


def monthly(extra):
    """2019-01 to 2026-03, 10000 a month and twice that in the middle of each quarter, and some months more."""
    rows = []
    for k in range(87 + extra):
        y, m = 2019 + k // 12, k % 12 + 1
        rows.append((dt.date(y, m, 1), "total", "arrival", 20000.0 if m % 3 == 2 else 10000.0))
    return rows


def last(spark, extra, how):
    rows = panel.monthly_to_quarterly(spark.createDataFrame(monthly(extra), FLOW), how).orderBy(F.desc("quarter")).limit(1).collect()
    return rows[0].value, rows[0].n_months


def test_partial_quarters(spark):
    assert last(spark, 0, "scale") == (40000.0, 3)
    assert last(spark, 1, "raw") == (10000.0, 1)
    assert last(spark, 2, "drop") == (None, 2)
    assert last(spark, 1, "scale") == (pytest.approx(40000), 1) and last(spark, 2, "scale") == (pytest.approx(40000), 2)
    two = [(D("2025-01-01"), "student", "arrival", 100.0), (D("2025-02-01"), "student", "arrival", 100.0)]
    assert panel.monthly_to_quarterly(spark.createDataFrame(two, FLOW)).first().value == pytest.approx(300)
    with pytest.raises(ValueError):
        panel.monthly_to_quarterly(spark.createDataFrame(two, FLOW), "other")


def test_annual_to_quarterly(spark):
    annual = spark.createDataFrame([(D("2024-07-01"), 400.0)], "period date, value double")
    spread = lambda w: [r.value for r in panel.annual_to_quarterly(annual, w).orderBy("period").collect()]
    weights = lambda ws: spark.createDataFrame(list(zip([D("2024-07-01"), D("2024-10-01"), D("2025-01-01"), D("2025-04-01")], ws)), "period date, weight double")
    assert spread(None) == [100.0] * 4 and spread(weights([None] * 4)) == [100.0] * 4
    assert spread(weights([40.0, 20.0, 30.0, 10.0])) == pytest.approx([160, 80, 120, 40])
    assert sum(spread(weights([-5.0, 20.0, None, 10.0]))) == pytest.approx(400)


def test_incomplete_years(spark):
    rows = [(D(f"{y}-07-01"), c, 1.0) for y in (2023, 2024) for c in ("a", "b", "c")] + [(D("2025-07-01"), "c", 1.0)]
    kept = panel.without_incomplete_years(spark.createDataFrame(rows, "period date, category string, value double")).collect()
    assert len(kept) == 6 and max(r.period for r in kept) == D("2024-07-01")
    rows = [(D(f"{y}-07-01"), c, 1.0) for y, cs in ((2023, "ab"), (2024, "ab"), (2025, "c"), (2026, "c")) for c in cs]
    kept = panel.without_incomplete_years(spark.createDataFrame(rows, "period date, category string, value double"))
    assert {r.period.year for r in kept.collect()} == {2023, 2024, 2026}


def test_panel_is_dense(spark):
    flows = spark.createDataFrame(monthly(1), FLOW)
    none = spark.createDataFrame([], "period date, category string, vintage_status string, value double")
    grants = spark.createDataFrame([], "period date, category string, value double, period_unit string")
    p = panel.build_panel(flows, none, grants, ["student"])
    assert p.columns == panel.PANEL and p.count() == 2 * 30
    end = p.where("category = 'total'").orderBy(F.desc("period")).first()
    assert (end.oad_months, end.oad_lt_arrivals) == (None, pytest.approx(40000)) or end.oad_months == 1


def test_publication_lag(spark):
    rows = [(dt.date(2023, m, 1), "month", float(m)) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "period date, period_unit string, value double")
    assert {r.period.month for r in panel.observable(df, "2023-06-15", 35).collect()} == {1, 2, 3, 4}
    mixed = spark.createDataFrame([(D("2024-01-01"), "quarter"), (D("2024-01-01"), "year")], "period date, period_unit string")
    assert [r.period_unit for r in panel.observable(mixed, "2024-11-01", 183).collect()] == ["quarter"]


def test_vintage_store(spark, tmp_path):
    store = VintageStore(spark, str(tmp_path / "store"))
    obs = lambda v: spark.createDataFrame([("x", D("2023-01-01"), "quarter", v)], "series_id string, period date, period_unit string, value double")
    assert store.write("nom", obs(100.0), "2023-04-01") == 1 and store.write("nom", obs(110.0), "2023-10-01") == 1
    assert store.read_as_of("nom", "2023-05-01").first().value == 100 and store.read_as_of("nom", "2023-12-01").first().value == 110
    assert store.read_as_of("nom", "2023-01-01").count() == 0 and store.read_as_of("nom").first().value == 110
    store.write("nom", obs(111.0), "2023-10-01")
    store.write("nom", obs(None), "2024-01-01")
    assert [r.value for r in store.history("nom", "x").collect()] == [100.0, 111.0, None]
    assert store.read_as_of("nom").first().value is None
    assert store.write("nom", obs(1.0).limit(0), "2025-01-01") == 0
    with pytest.raises(ValueError):
        store.write("nom", obs(1.0).drop("value"), "2025-01-01")
    days = spark.createDataFrame([("2023-05-01",), ("2023-12-01",)], "d string").select(F.col("d").cast("date").alias("asof_date"))
    many = vintages.as_of_many(store.read(), days, ["source", "series_id", "period"]).orderBy("asof_date").collect()
    assert [r.value for r in many] == [100.0, 111.0]


def test_scores(spark):
    rows = [("m", dt.date(2020, 1 + 3 * k, 1), p, 1.0, t, p - 1, p + 1) for k, (p, t) in enumerate([(1.0, 0.0), (2.0, 3.0), (5.0, 3.5), (6.0, 8.0)])]
    df = spark.createDataFrame(rows, "model string, period date, nom_mean double, nom_se double, nom_truth double, lower_80 double, upper_80 double").withColumns({"lower_95": F.col("lower_80") - 1, "upper_95": F.col("upper_80") + 1})
    s = scoring.score(df, ["model"]).first()
    errors = [1.0, -1.0, 1.5, -2.0]
    assert s.rmse == pytest.approx((sum(e * e for e in errors) / 4) ** 0.5) and s.bias == pytest.approx(-0.125) and s.hit_rate == 1.0
    assert (s.cov80, s.cov95, s.n) == (0.5, 1.0, 4)


def test_adjustment(spark):
    cols = "period date, horizon int, nom_mean double, nom_se double, lower_80 double, upper_80 double, lower_95 double, upper_95 double"
    rows = [(D("2024-01-01"), h, m, 10.0, m * 0.9, m * 1.1, m * 0.8, m * 1.2) for h, m in ((-1, 80000.0), (0, 50000.0), (1, 50000.0), (3, 50000.0))]
    table = spark.createDataFrame([(0, 2.0, 1.0, 1.0), (1, 1.5, 1.0, 1.0)], "horizon int, factor double, k80 double, k95 double")
    got = ratios.adjusted(spark.createDataFrame(rows, cols), table).orderBy("horizon").collect()
    assert [round(r.nom_mean) for r in got] == [80000, 100000, 75000, 75000] and [r.adjusted for r in got] == [False, True, True, True]


def test_gamma_weights():
    w = ratios.gamma_weights(2, 1, 6)
    assert len(w) == 7 and sum(w) == pytest.approx(1) and max(range(5), key=ratios.gamma_weights(2, 1, 4).__getitem__) == 1
    falling = ratios.gamma_weights(1, 2, 4)
    assert all(a >= b for a, b in zip(falling, falling[1:]))


def test_ratio_of_complete_quarters(spark):
    rows = [(dt.date(2015 + k // 4, 1 + 3 * (k % 4), 1), c, 100.0, 50.0, f) for k in range(32) for c, f in (("student", 90.0), ("skilled", 400.0))]
    p = spark.createDataFrame(rows, "period date, category string, oad_lt_arrivals double, oad_lt_net double, nom_final double")
    got = ratios.empirical_ratio(p, ceiling=1.5)
    assert got.agg(F.max("period")).first()[0] == dt.date(2021, 4, 1)
    assert {r.category: r.pi_hat for r in got.collect()} == {"student": 0.9, "skilled": 1.5}


def test_total_in_fallback_and_nowcast(spark):
    """Only the total has figures: its ratio stands for categories and total, and the total's own nowcast is the headline."""
    rows = [(dt.date(2015 + k // 4, 1 + 3 * (k % 4), 1), c, a, n, f) for k in range(32) for c, a, n, f in (("student", 100.0, 60.0, None), ("skilled", 50.0, 40.0, None), ("total", 150.0, 100.0, 80.0))]
    p = spark.createDataFrame(rows, "period date, category string, oad_lt_arrivals double, oad_lt_net double, nom_final double")
    got = ratios.empirical_ratio(p)
    assert {(r.category, r.pi_hat, r.n_arrivals) for r in got.collect()} == {("student", 0.8, 150.0), ("skilled", 0.8, 150.0), ("total", 0.8, 150.0)}
    assert {r.category for r in ratios.empirical_ratio(p, levels=["student", "other"]).collect()} == {"student", "other", "total"}
    smoothed = got.select("period", "category", F.col("pi_hat").alias("pi_smoothed"), F.lit(0.1).alias("pi_se"))
    day = D("2024-01-01")
    flows = [("student", "arrival", 100.0), ("student", "departure", 40.0), ("skilled", "arrival", 50.0), ("total", "departure", 60.0)]
    forecasts = spark.createDataFrame([(day, *r, 0.1) for r in flows], "period date, category string, direction string, mean_level double, se_log double")
    single = forecasts.unionByName(spark.createDataFrame([(day, "total", "arrival", 150.0, 0.1)], forecasts.schema))
    joint = spark.createDataFrame([(day, "total", "arrival", 200.0, 0.05)], forecasts.schema)
    heads = {}
    for name, f in (("v1", single), ("pi", ratios.combined_forecasts(single, joint)), ("none", forecasts)):
        by_category = ratios.nowcast_by_category(f, smoothed, ratios.projected(smoothed, ["category"]))
        each = {r.category: r for r in by_category.collect()}
        assert each["student"].nom_mean == pytest.approx(48) and each["skilled"].nom_mean is None and each["skilled"].nom_se == 0
        assert each["student"].nom_se == pytest.approx((0.64 * (10.0**2 + 4.0**2) + 0.01 * 60**2) ** 0.5)
        heads[name] = ratios.headline(by_category).collect()
    # the swap of the total's arrivals moves the headline; without the total's arrivals the categories that have a mean are summed
    assert [round(heads[k][0].nom_mean, 6) for k in ("v1", "pi", "none")] == [72.0, 112.0, 48.0]


def test_headline_by_origin(spark):
    """An origin with a total has only the total's periods, another one sums its categories."""
    rows = [(1, D("2024-01-01"), "a", 5.0), (1, D("2024-01-01"), "total", 9.0), (1, D("2024-04-01"), "a", 6.0), (1, D("2024-04-01"), "total", None), (2, D("2024-01-01"), "a", 3.0), (2, D("2024-01-01"), "b", None), (2, D("2024-01-01"), "total", None)]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "origin int, period date, category string, nom_mean double, nom_se double")
    got = sorted((r.origin, str(r.period), r.nom_mean, round(r.nom_se, 6)) for r in ratios.headline(frame, ["origin"]).collect())
    assert got == [(1, "2024-01-01", 9.0, 1.0), (2, "2024-01-01", 3.0, round(2**0.5, 6))]


def test_last_values_of_two_columns(spark):
    rows = [("x", D(f"2020-0{k}-01"), v, w) for k, (v, w) in enumerate([(1.0, None), (2.0, 5.0), (None, 7.0), (4.0, None)], 1)]
    got = ratios.last_value(spark.createDataFrame(rows, "k string, period date, v double, w double"), ["k"], ["v", "w"], n=2).first()
    assert (got.v, got.w) == (3.0, 6.0)
