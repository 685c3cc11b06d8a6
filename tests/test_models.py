import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import config
from tideline.operators import fits, replay
from tideline.operators import statespace as ss
from tideline.operators.store import VintageStore


def quarters(n):
    return [dt.date(2015 + k // 4, 1 + 3 * (k % 4), 1) for k in range(n)]


def made_up_panel(spark, n=40):
    rng = np.random.default_rng(1)
    level = np.log(250_000) + 0.01 * np.arange(n) + np.cumsum(rng.normal(0, 0.02, n))
    rows = []
    for k, (p, x) in enumerate(zip(quarters(n), level)):
        season = (0.1, -0.05, -0.1, 0.05)[k % 4]
        rows.append((p, "total", float(np.exp(x + season)), None, float(np.exp(x - 0.7)) if k < n - 2 else None))
        rows.append((p, "student", None, float(np.exp(x - 1)), None))
    return spark.createDataFrame(rows, "period date, category string, oad_lt_arrivals double, visa_grants double, nom_final double")


def test_filter_against_a_dense_gaussian():
    """The likelihood of a local level is that of one big normal distribution."""
    model = ss.Model(np.eye(1), np.ones((1, 1)), np.array([0.5]), np.array([2.0]), np.array([3.0]))
    y = np.array([1.0, 0.5, np.nan, 2.0])
    cov = np.array([[3.0 + 0.5 * min(i, j) for j in range(4)] for i in range(4)]) + 2 * np.eye(4)
    ok = np.isfinite(y)
    c, v = cov[np.ix_(ok, ok)], y[ok]
    want = -0.5 * (len(v) * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + v @ np.linalg.solve(c, v))
    assert ss.filtered(model, y[:, None])["loglik"] == pytest.approx(want)
    state = cov - 2 * np.eye(4)
    a, _ = ss.smoothed(model, y[:, None])
    assert a[:, 0] == pytest.approx(state[:, ok] @ np.linalg.solve(c, v))


def test_joint_model_matrices():
    w = [0.1, 0.2, 0.3, 0.25, 0.15]
    m = ss.joint(w, target=False)
    assert m.T.shape == (9, 9) and m.T[5, 0] == 1 and m.Z[1].sum() == pytest.approx(1) and m.Z[1, 0] == w[-1]
    assert ss.joint(w).Z[2].tolist() == [1] + [0] * 8


def test_smoothers():
    x = np.arange(30.0)
    assert ss.hodrick_prescott(2 + 3 * x) == pytest.approx(2 + 3 * x) and ss.hodrick_prescott(x**2).sum() == pytest.approx((x**2).sum())
    fit, se = ss.local_regression(x, 1 + x + 0.1 * x**2, x, 0.5)
    assert fit == pytest.approx(1 + x + 0.1 * x**2) and (se < 1e-6).all()
    at, value = ss.minimised(lambda v: (v[0] - 3) ** 2 + 10 * (v[1] + 1) ** 2, np.zeros(2))
    assert at == pytest.approx([3, -1], abs=1e-3)


def test_metropolis_finds_a_normal():
    """Means, spreads and correlation of a known density; chains agree, and the effective draws are near those of an autoregression whose worth is known."""
    cov = np.array([[1.0, 1.2], [1.2, 4.0]])
    solve = np.linalg.inv(cov)
    chains, rate = ss.adaptive_metropolis(lambda x: -0.5 * np.einsum("ci,ij,cj->c", x - 5, solve, x - 5), np.array([[0.0, 0.0], [9.0, 1.0], [5.0, 5.0], [2.0, 9.0]]), 4000, 1500, 3, 0.5)
    flat = chains.reshape(-1, 2)
    assert chains.shape == (4, 4000, 2) and flat.mean(0) == pytest.approx([5, 5], abs=0.25) and np.cov(flat.T) == pytest.approx(cov, rel=0.2) and ((0.1 < rate) & (rate < 0.6)).all()
    assert (ss.split_rhat(list(chains)) < 1.03).all() and 500 < ss.effective_draws(chains).min() < 8000
    rng = np.random.default_rng(1)
    noise, path = rng.standard_normal((4, 5000, 1)), np.zeros((4, 5000, 1))
    for t in range(1, 5000):
        path[:, t] = 0.8 * path[:, t - 1] + noise[:, t]
    assert ss.effective_draws(path)[0] == pytest.approx(20000 * (1 - 0.8) / (1 + 0.8), rel=0.2) and ss.effective_draws(noise)[0] == pytest.approx(20000, rel=0.1)


def test_filters_of_many_models_are_those_of_each():
    """The batched filter gives each model's Gaussian log likelihood, from the joint covariance of the observations."""
    rng = np.random.default_rng(0)
    y = rng.normal(10, 0.3, (9, 3))
    y[2, 1] = y[:4, 2] = np.nan
    points = rng.normal(0, 0.3, (4, 12)) + np.array([0, 0, -1, -1, -1, -1, -1, 1.0, 10, 0, -2, -2])
    for seasonal_ in (False, True):
        models = [fits._bayes_model(x[: 12 if seasonal_ else 10], [0.5, 0.3, 0.2], seasonal_) for x in points]
        got = fits._bayes_filter(models, y)
        for (m, first, v, n), value in zip(models, got, strict=True):
            mean, cross, a, P, powers = [], [], first, np.diag(m.p1), []
            for _ in range(9):
                a, P = m.T @ a, m.T @ P @ m.T.T + np.diag(m.q)
                mean.append(m.Z @ a + [0, n, v])
                powers.append(P)
            full = np.zeros((27, 27))
            for i in range(9):
                for j in range(i + 1):
                    c = m.Z @ np.linalg.matrix_power(m.T, i - j) @ powers[j] @ m.Z.T
                    full[3 * i : 3 * i + 3, 3 * j : 3 * j + 3] = c
                    full[3 * j : 3 * j + 3, 3 * i : 3 * i + 3] = c.T
                full[3 * i : 3 * i + 3, 3 * i : 3 * i + 3] += np.diag(m.h)
            ok = np.isfinite(y.ravel())
            r, S = (y.ravel() - np.concatenate(mean))[ok], full[np.ix_(ok, ok)]
            assert value == pytest.approx(-0.5 * (len(r) * np.log(2 * np.pi) + np.linalg.slogdet(S)[1] + r @ np.linalg.solve(S, r)), rel=1e-9)


def test_forecasts_from_groups(spark):
    p = made_up_panel(spark)
    series = p.where("category = 'total'").select("category", "period", F.col("oad_lt_arrivals").alias("value"))
    got = fits.structural_forecasts(series, ["category"]).orderBy("period").collect()
    assert len(got) == 44 and [r.forecast_horizon for r in got] == list(range(-39, 5)) and {r.status for r in got} == {"ok"}
    known = {r.period: r.value for r in series.collect()}
    assert all(abs(r.mean_level / known[r.period] - 1) < 0.1 for r in got if r.period in known)
    short = fits.structural_forecasts(series.limit(5), ["category"]).collect()
    assert len(short) == 1 and short[0].status.startswith("failed")


def test_joint_bridge_and_grid(spark):
    p = made_up_panel(spark)
    got = fits.joint_forecasts(p).orderBy("period").collect()
    truth = {r.period: r.nom_final for r in p.where("nom_final is not null").collect()}
    assert len(got) == 44 and all(abs(r.nom_level / truth[r.period] - 1) < 0.15 for r in got if r.period in truth)
    bridge = fits.bridge_forecasts(p).collect()
    assert {r.category for r in bridge} == {"total"} and sum(r.nom_mean is not None for r in bridge) == 36
    grid = fits.lag_grid(p, [1.0, 2.0], [1.0])
    assert grid.count() == 2 and fits.best_lag(grid).first().loglik == max(r.loglik for r in grid.collect())


def test_grid_search_covers_the_whole_grid(spark):
    grid = fits.lag_grid(made_up_panel(spark, 16)).collect()
    assert {(r.alpha, r.beta) for r in grid} == {(a, b) for a in (1.0, 1.5, 2.0, 2.5, 3.0, 4.0) for b in (0.5, 1.0, 1.5, 2.0)}
    assert {r.status for r in grid} == {"ok"}


def test_bayes_headline_orders_its_intervals(spark):
    draws = fits.bayes_draws(made_up_panel(spark, 24), sampling={"chains": 2, "warmup": 150, "draws": 60, "seed": 7})
    got = fits.bayes_headline(draws).collect()
    assert len(got) == 28 and all(r.lower_95 <= r.lower_80 <= r.upper_80 <= r.upper_95 for r in got)
    assert sorted(got) == sorted(fits.bayes_headline(draws).collect())
    assert {r.chains for r in got} == {2} and all(r.rhat >= 0.9 and 1 <= r.ess <= 120 and 0 < r.acceptance < 1 for r in got)


def test_lags_that_lead_or_are_learned(spark):
    p = made_up_panel(spark, 20)
    for how in ({"lead": 1}, {"learned": True}):
        draws = fits.bayes_draws(p, sampling={"chains": 1, "warmup": 60, "draws": 20, "seed": 3}, **how)
        assert {r.status for r in draws.select("status").distinct().collect()} == {"ok"} and fits.bayes_headline(draws).count() == 24


def test_smoothed_ratios_keep_their_rows(spark):
    rows = [(p, "student", 0.5 + 0.01 * k if k % 7 else None) for k, p in enumerate(quarters(30))]
    r = spark.createDataFrame(rows, "period date, category string, pi_hat double")
    for how in ("none", "loess", "hp", "locallinear"):
        assert fits.smoothed_ratios(r, how, breaks=["2020-03-01"]).where("status = 'ok'").count() == 30


def test_known_at_takes_real_vintages_first(spark):
    days = spark.createDataFrame([("2020-06-01",), ("2021-06-01",)], "d string").select(F.col("d").cast("date").alias("asof_date"))
    current = spark.createDataFrame([(dt.date(2020, 1, 1), "a", 1.0, "quarter"), (dt.date(2019, 7, 1), "a", 2.0, "quarter")], "period date, category string, value double, period_unit string")
    recorded = current.where("value = 1").withColumns({"vintage_date": F.lit("2021-01-01").cast("date"), "value": F.lit(9.0)})
    got = sorted((str(r.asof_date), r.nom_vintage, r.value) for r in replay.known_at(days, recorded, current, ["period", "category"], 183).collect())
    assert got == [("2020-06-01", "pseudo", 2.0), ("2021-06-01", "real", 9.0)]


def test_sources_turn_real_at_days_of_their_own(spark, tmp_path):
    """At the middle origin flows are recorded and figures aren't; at the last both are, grants never; what the store doesn't keep comes back."""
    store = VintageStore(spark, str(tmp_path / "s"))
    cols = "series_id string, period date, period_unit string, value double, unit string, metadata string"
    d = dt.date.fromisoformat
    meta = '{"series": "Students ; Arrivals"}'
    flows = spark.createDataFrame([(f"oad:student:{side}", d(f"2020-{m:02d}-01"), "month", 10.0 * m, None, None) for m in range(1, 7) for side in ("arrival", "departure")], cols)
    figures = spark.createDataFrame([("nom:total", d("2019-10-01"), "quarter", 5.0, None, None), ("nom:total", d("2020-01-01"), "quarter", 6.0, None, None)], cols)
    grants = spark.createDataFrame([("visa_grants:500", d("2020-01-01"), "month", 3.0, None, meta)], cols)
    store.write("oad", flows.where("period <= date '2020-02-01'").withColumn("value", F.lit(1.0)), "2020-04-15")
    store.write("nom", figures.where("value = 5").withColumn("value", F.lit(50.0)), "2020-09-01")
    origins = spark.createDataFrame([("2020-04-10",), ("2020-05-01",), ("2020-10-01",)], "d string").select(F.col("d").cast("date").alias("asof_date"))
    known = replay.known_from_store(store, origins, {"oad": flows, "nom": figures, "visa_grants": grants})
    kinds = {(str(r.asof_date), s): (r.vintage, r.n) for s, rows in known.items() for r in rows.groupBy("asof_date", "vintage").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {
        ("2020-04-10", "oad"): ("pseudo", 4), ("2020-05-01", "oad"): ("real", 4), ("2020-10-01", "oad"): ("real", 4), ("2020-10-01", "nom"): ("real", 1),
        ("2020-04-10", "visa_grants"): ("pseudo", 1), ("2020-05-01", "visa_grants"): ("pseudo", 1), ("2020-10-01", "visa_grants"): ("pseudo", 1),
    }
    panels = {(str(r.asof_date), str(r.period), r.category): r for r in replay.panels_from_store(known, partial="raw").collect()}
    assert panels["2020-04-10", "2020-01-01", "student"].oad_lt_arrivals == 30 and panels["2020-05-01", "2020-01-01", "student"].oad_lt_arrivals == 2
    assert panels["2020-10-01", "2019-10-01", "total"].nom_final == 50 and panels["2020-05-01", "2020-01-01", "student"].visa_grants == 3
    assert known["oad"].where("asof_date < '2020-01-01'").count() == 0 and replay.known_from_store(store, origins, {})["visa_grants"].count() == 0


def test_chains_that_have_not_converged_are_not_scored(spark):
    rows = [("m", dt.date(2020, 1, 1), "total", 0, 5.0, 1.0, 1.5), ("m", dt.date(2020, 4, 1), "total", 0, 7.0, 1.0, 1.05), ("p", dt.date(2020, 1, 1), "total", 0, 4.0, 1.0, None)]
    runs = spark.createDataFrame([(dt.date(2020, 7, 1), *r) for r in rows], "asof_date date, model string, period date, category string, horizon int, nom_mean double, nom_se double, rhat double")
    runs = runs.withColumns({c: F.col("nom_mean") for c in ("lower_80", "upper_80", "lower_95", "upper_95")})
    truth = spark.createDataFrame([(dt.date(2020, 1, 1), "total", 4.0), (dt.date(2020, 4, 1), "total", 4.0)], "period date, category string, nom_truth double")
    got = {r.model: r for r in replay.scored(runs, truth, regimes=None).collect()}
    assert (got["m"].n, got["m"].bias, got["m"].unconverged) == (1, 3.0, 1) and (got["p"].n, got["p"].unconverged) == (1, 0)
    assert {r.model: r.n for r in replay.scored(runs, truth, regimes=None, most_rhat=None).collect()} == {"m": 2, "p": 1}


def test_replay_has_every_stream_at_every_origin(spark):
    p = made_up_panel(spark, 36)
    days = spark.createDataFrame([("2021-07-01",), ("2022-01-01",)], "d string").select(F.col("d").cast("date").alias("asof_date"))
    each = p.where("category = 'total'").select("period", F.lit("student").alias("category"), "oad_lt_arrivals", (F.col("oad_lt_arrivals") * 0.6).alias("oad_lt_departures"), (F.col("oad_lt_arrivals") * 0.4).alias("oad_lt_net"), (F.col("nom_final") * 0.9).alias("nom_final"))
    whole = p.where("category = 'total'").withColumns({"oad_lt_departures": F.col("oad_lt_arrivals") * 0.6, "oad_lt_net": F.col("oad_lt_arrivals") * 0.4})
    grants = p.where("category <> 'total'").withColumn("category", F.lit("student")).select("period", "category", "visa_grants")
    base = each.unionByName(whole.select("period", "category", *[c for c in each.columns[2:]])).join(grants, ["period", "category"], "left").withColumn("nom_preliminary", F.col("nom_final") * 1.01)
    panels = base.crossJoin(days).where("period < asof_date")
    quick = {"chains": 2, "warmup": 60, "draws": 30, "seed": 1}
    runs = replay.replay(panels, sampling=quick, bayes_window=1, ceiling=50.0).cache()
    seen = {(r.model, str(r.asof_date)) for r in runs.collect()}
    for m in (*replay.PLAIN, *replay.BAYES):
        assert (m, "2022-01-01") in seen, m
        assert ((m, "2021-07-01") in seen) == (m not in replay.BAYES), m
    assert {r.horizon for r in runs.collect()} <= {-2, -1, 0, 1}
    truth = base.select("period", "category", F.col("nom_final").alias("nom_truth"))
    first = base.crossJoin(days.where("asof_date = date '2022-01-01'")).select("asof_date", "period", "category", F.col("nom_preliminary").alias("nom_prelim"))
    scores = replay.scored(runs, truth, first, [("a", "2000-01-01", "2021-06-30"), ("b", "2021-07-01", "2030-01-01")]).collect()
    assert {r.regime for r in scores} == {"a", "b"}
    assert all(r.rmse_vs_prelim == pytest.approx(0, abs=1e-6) for r in scores if r.model == "abs_preliminary" and r.regime == "b" and r.horizon in (0, 1))


def test_config(tmp_path):
    f = tmp_path / "c.yml"
    f.write_text("smoother: hp\nhorizons: [0, 1]\n")
    c = config.load(str(f), damping=0.9)
    assert (c.smoother, c.horizons, c.damping, c.seasonal_period) == ("hp", (0, 1), 0.9, 4)
    assert c.day(dt.date(2020, 1, 1)) == dt.date(2020, 1, 1) and config.load(asof_date="2021-05-01").day(dt.date(2020, 1, 1)) == dt.date(2021, 5, 1)
    with pytest.raises(ValueError):
        config.load(nothing=1)
