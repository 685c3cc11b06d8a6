import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import fits, leastsquares, scoring


def test_regressions_against_numpy(spark):
    """Large means, a collinear regressor, a constant one, nulls and NaN; and a key with fewer rows than regressors."""
    rng = np.random.default_rng(2)
    rows = []
    for key, n in (("a", 400), ("b", 60), ("c", 3)):
        x = rng.normal(size=(n, 3)) * [1, 1e4, 1e-3] + [1e6, 5, 0]
        y = 2 + x @ [3.0, -1e-3, 50.0] + rng.normal(size=n)
        rows += [(key, *map(float, r), float(r[0] + 2 * r[1]), 7.0, float(v)) for r, v in zip(x, y)]
    rows += [("a", None, 1.0, 1.0, 1.0, 7.0, 1.0), ("a", 1.0, 1.0, float("nan"), 1.0, 7.0, 1.0), ("a", 1.0, 1.0, 1.0, 1.0, 7.0, None), ("d", 1.0, 1.0, 1.0, 1.0, 7.0, None)]
    names = ["x1", "x2", "x3", "x4", "x5"]
    frame = spark.createDataFrame(rows, "k string, x1 double, x2 double, x3 double, x4 double, x5 double, y double").repartition(6)
    fit = leastsquares.regressions(frame, ["k"], "y", names)
    plan = fit._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Python" not in plan
    got = {}
    for r in frame.join(fit, "k", "left").select("k", *names, "y", leastsquares.predicted(names).alias("p")).collect():
        got.setdefault(r.k, []).append(r)
    for key in "abc":
        own = [r for r in got[key] if all(r[c] is not None and not math.isnan(r[c]) for c in (*names, "y"))]
        X = np.array([[1, *(r[c] for c in names)] for r in own])
        y = np.array([r.y for r in own])
        Z = np.column_stack([np.ones(len(y)), (X[:, 1:4] - X[:, 1:4].mean(0)) / X[:, 1:4].std(0)])  # what is independent
        want = Z @ np.linalg.lstsq(Z, y, rcond=None)[0]
        assert np.allclose([r.p for r in own], want, rtol=0, atol=1e-4 * y.std() + 1e-6)
    assert all(r.p is None for r in got["d"]) and sum(r.p is None for r in got["a"]) == 2
    whole = leastsquares.regressions(frame.where("k = 'b'"), [], "y", names[:2]).first()
    assert whole.n == 60 and len(whole.b) == 2


def test_bridge_has_no_grouped_map(spark):
    rows = [(c, f"20{10 + q // 4}-{1 + 3 * (q % 4):02d}-01", float(100 + q + (q * 7) % 5), float(50 + (q * 3) % 11), float(10 * q) if q < 30 else None) for c in ("total", "a") for q in range(36)]
    p = spark.createDataFrame(rows, "category string, period string, oad_lt_arrivals double, visa_grants double, nom_final double").withColumn("period", F.col("period").cast("date"))
    out = fits.bridge_forecasts(p)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("nom_mean is not null").count() == 64


def density(x, mean, phi):
    """Log likelihood, with the best variance."""
    n, d = len(x), np.asarray(x) - mean
    s = (1 - phi**2) * d[0] ** 2 + ((d[1:] - phi * d[:-1]) ** 2).sum()
    return -n / 2 * math.log(s / n) + 0.5 * math.log(1 - phi**2)


def best(x):
    """By a search that narrows a grid over both parameters."""
    (a, b), (c, d) = (-0.999999, 0.999999), (min(x) - 1, max(x) + 1)
    for _ in range(60):
        phis, means = np.linspace(a, b, 25), np.linspace(c, d, 25)
        values = np.array([[density(x, m, f) for m in means] for f in phis])
        i, j = np.unravel_index(values.argmax(), values.shape)
        (a, b), (c, d) = (phis[max(i - 2, 0)], phis[min(i + 2, 24)]), (means[max(j - 2, 0)], means[min(j + 2, 24)])
    return means[j], phis[i]


def test_exact_likelihood_against_a_dense_search(spark):
    rng = random.Random(6)
    series = {}
    for k, (phi, mean, n) in enumerate([(0.0, 0.0, 8), (0.6, 5.0, 30), (-0.7, 1000.0, 40), (0.95, -3.0, 60), (0.3, 1e5, 12), (-0.2, 0.1, 5)]):
        x, out = 0.0, []
        for _ in range(n):
            x = phi * x + rng.gauss(0, 1)
            out.append(mean + x)
        series[k] = out
    rows = [(k, t, v) for k, x in series.items() for t, v in enumerate(x)] + [(9, t, 4.0) for t in range(7)] + [(1, 99, None)]
    fit = scoring.likelihood_ar1(spark.createDataFrame(rows, "k int, period int, v double").repartition(5), ["k"], "v")
    assert "Python" not in fit._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r for r in fit.collect()}
    for k, x in series.items():
        mean, phi = best(x)
        assert got[k].n == len(x) and abs(got[k].phi - phi) < 1e-5 and abs(got[k].mean - mean) < 1e-5 * max(1, abs(mean))
        assert density(x, got[k].mean, got[k].phi) >= density(x, mean, phi) - 1e-9
    assert (got[9].phi, got[9].mean) == (0.0, 4.0)


def test_fitted_growth(spark):
    values = [100.0, 104.0, 103.0, 110.0, 108.0, 115.0, 117.0, 116.0]
    frame = spark.createDataFrame([("a", t, v) for t, v in enumerate(values)] + [("b", t, 1.0) for t in range(5)], "k string, period int, v double")
    got = {(r.k, r.period): r.nom_mean for r in scoring.autoregression(frame, ["k"], "v").collect()}
    g = [b / a - 1 for a, b in zip(values, values[1:])]
    mean, phi = best(g)
    want = {("a", t + 1): values[t] * (1 + mean + (phi * (g[t - 1] - mean) if t else 0)) for t in range(7)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)
