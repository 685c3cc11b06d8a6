import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline import config
from tideline.operators import nowcast
from tideline.operators.store import VintageStore


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Six years of flows of two categories and of the total's figures, in a store; figures come nine months late, and one flow was revised later."""
    store = VintageStore(spark, str(tmp_path_factory.mktemp("s") / "store"))
    rows = []
    for k in range(72):
        period = dt.date(2015 + k // 12, k % 12 + 1, 1)
        seen = dt.date(2015 + (k + 2) // 12, (k + 2) % 12 + 1, 1)
        for c, a in (("student", 900.0), ("skilled", 400.0), ("total", 1400.0)):
            rows += [("oad", f"oad:{c}:arrival", period, "month", seen, a + 5 * k + 40 * (k % 3)), ("oad", f"oad:{c}:departure", period, "month", seen, 0.5 * a + 2 * k)]
        if k % 3 == 0:
            rows.append(("nom", "nom:total", period, "quarter", dt.date(2015 + (k + 9) // 12, (k + 9) % 12 + 1, 1), 1800.0 + 10 * k))
    rows.append(("oad", "oad:total:arrival", dt.date(2019, 1, 1), "month", dt.date(2020, 9, 1), 9999.0))
    rows += [("visa_grants", f"visa_grants:{c}", dt.date(2018, 1, 1), "month", dt.date(2018, 3, 1), 7.0) for c in ("500", "600 visitor")]
    frame = spark.createDataFrame(rows, "source string, series_id string, period date, period_unit string, vintage_date date, value double")
    store.load_history(frame)
    return store


def settings(**changes):
    return config.load(asof_date="2020-08-01", categories=["student", "skilled"], regime_breaks=[], ratio_ceiling=5.0, **changes)


def test_the_day_decides_what_is_known(store):
    early = nowcast.run(store, settings(), dt.date(2026, 1, 1))
    assert early.day == dt.date(2020, 8, 1)
    at = lambda r: r.panel.where("category = 'total' and period = date '2019-01-01'").first()
    late = nowcast.run(store, config.load(asof_date="2020-10-01", categories=["student", "skilled"]), dt.date(2026, 1, 1))
    assert at(late).oad_lt_arrivals - at(early).oad_lt_arrivals == pytest.approx(9999 - (1400 + 5 * 48))
    assert early.panel.where("nom_final is not null").agg(F.max("period")).first()[0] == dt.date(2019, 10, 1)
    # only the total has figures, so its ratio stands for all, and its rows are the headline
    assert {r.category for r in early.ratio.select("category").distinct().collect()} == {"student", "skilled", "total"}
    heads = {r.period: r.nom_mean for r in early.headline.collect()}
    whole = {r.period: r.nom_mean for r in early.by_category.where("category = 'total'").collect()}
    assert heads == whole and all(v > 0 for v in heads.values()) and max(heads) > dt.date(2020, 7, 1)


def test_settings_change_the_run(store):
    base = nowcast.run(store, settings(), dt.date(2026, 1, 1))
    tight = nowcast.run(store, config.load(asof_date="2020-08-01", categories=["student"], regime_breaks=[], ratio_ceiling=0.1, completion_quarters=8, grants_exclude=[]), dt.date(2026, 1, 1))
    assert tight.ratio.agg(F.max("pi_hat")).first()[0] == pytest.approx(0.1) and base.ratio.agg(F.max("pi_hat")).first()[0] > 0.1
    last = lambda r: r.ratio.agg(F.max("period")).first()[0]
    assert last(tight) < last(base)
    assert {r.category for r in tight.panel.select("category").distinct().collect()} == {"student", "total"}
    quick = nowcast.run(store, settings(smoother="none", projection="latest"), dt.date(2026, 1, 1))
    assert {(r.category, r.period): round(r.pi_smoothed, 9) for r in quick.smoothed.collect()} == {(r.category, r.period): round(r.pi_hat, 9) for r in quick.ratio.collect()}
