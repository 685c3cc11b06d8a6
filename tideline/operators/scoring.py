"""Scores of forecasts against what came true, and plain benchmark forecasts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels


def coverage(low: str, high: str, y: str) -> Column:
    """The share of y within [low, high], of rows where all three are known; null if there are none."""
    known = F.col(low).isNotNull() & F.col(high).isNotNull() & F.col(y).isNotNull()
    return F.avg(F.when(known, F.col(y).between(F.col(low), F.col(high)).cast("double")))


def log_score(mean: str, sd: str, y: str) -> Column:
    """The mean Gaussian log density at y, of rows with a positive sd."""
    z = (F.col(y) - F.col(mean)) / F.col(sd)
    return F.avg(F.when(F.col(sd) > 0, F.lit(-0.5 * math.log(2 * math.pi)) - F.ln(sd) - 0.5 * z * z))


def score(runs: DataFrame, keys: list[str], truth: str = "nom_truth", period: str = "period", prelim: str | None = None, also: list[Column] | None = None) -> DataFrame:
    """keys, n, rmse, mae, bias, hit_rate, log_score, cov80, cov95 (and rmse_vs_prelim, and what also adds up) in one aggregation after one window. Rows without a mean count nowhere.

    hit_rate: how often forecast and truth moved the same way since the period before.
    """
    w = Window.partitionBy(*keys).orderBy(period)
    step = lambda c: F.signum(F.col(c) - F.lag(c).over(w))
    rows = runs.withColumns({"_e": F.col("nom_mean") - F.col(truth), "_hit": (step("nom_mean") == step(truth)).cast("double")})
    more = [F.sqrt(F.avg(F.pow(F.col("nom_mean") - F.col(prelim), 2))).alias("rmse_vs_prelim")] if prelim else []
    return rows.groupBy(*keys).agg(
        F.count("_e").alias("n"), F.sqrt(F.avg(F.pow("_e", F.lit(2)))).alias("rmse"), F.avg(F.abs("_e")).alias("mae"), F.avg("_e").alias("bias"), F.avg("_hit").alias("hit_rate"),
        log_score("nom_mean", "nom_se", truth).alias("log_score"), coverage("lower_80", "upper_80", truth).alias("cov80"), coverage("lower_95", "upper_95", truth).alias("cov95"), *more, *(also or []),
    )


def lags(df: DataFrame, columns: list[str], last: int, keys: list[str] | None = None, period: str = "period") -> DataFrame:
    """df with each column's values 0 to last periods before, as column_l0, ..."""
    w = Window.partitionBy(*(keys or [])).orderBy(period)
    return df.withColumns({f"{c}_l{k}": F.lag(c, k).over(w) if k else F.col(c) for c in columns for k in range(last + 1)})


def random_walk(series: DataFrame, keys: list[str], value: str, period: str = "period") -> DataFrame:
    """keys, period, nom_mean: the value one row before."""
    return series.select(*keys, period, F.lag(value).over(Window.partitionBy(*keys).orderBy(period)).alias("nom_mean"))


def growth(series: DataFrame, keys: list[str], value: str, period: str = "period") -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(period))
    return series.withColumn("growth", F.try_divide(F.col(value) - before, before))


def autoregression_ls(series: DataFrame, keys: list[str], value: str, period: str = "period", least: int = 6) -> DataFrame:
    """keys, period, nom_mean: values fitted by a first-order autoregression of growth, by least squares within each key; keys with fewer than `least` growth rates have none."""
    w = Window.partitionBy(*keys).orderBy(period)
    rows = growth(series, keys, value, period).withColumns({"_g": F.lag("growth").over(w), "_y": F.lag(value).over(w)})
    fit = rows.groupBy(*keys).agg(F.regr_slope("growth", "_g").alias("_b"), F.regr_intercept("growth", "_g").alias("_a"), F.count("growth").alias("_n"))
    return rows.join(fit, keys).where(F.col("_n") >= least).select(*keys, period, (F.col("_y") * (1 + F.col("_a") + F.col("_b") * F.col("_g"))).alias("nom_mean"))


#: Steps between the coefficient and the mean; each raises the likelihood.
LIKELIHOOD_STEPS = 100


def likelihood_ar1(rows: DataFrame, keys: list[str], value: str, period: str = "period") -> DataFrame:
    """keys, n, mean, phi: the stationary Gaussian autoregression of first order with the largest exact likelihood, from sums by key.

    Given the mean, the coefficient is the middle root of a cubic whose coefficients are sums of squares and products; given the coefficient, the mean is a ratio of sums. The two alternate. The sums are
    made before the shuffle, and no Python runs. Nulls are left out before neighbours are formed; a constant series has the coefficient 0.
    """
    w = Window.partitionBy(*keys).orderBy(period)
    known = rows.where(F.col(value).isNotNull())
    steps = known.select(*keys, period, F.col(value).alias("_x"), F.lag(value).over(w).alias("_b"))
    # products of deviations from a value of the series keep their digits
    sums = steps.withColumn("_c", F.first("_x").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    x, b = F.col("_x") - F.col("_c"), F.col("_b") - F.col("_c")
    sums = sums.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.first("_c").alias("c"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.coalesce(F.sum(x * b), F.lit(0.0)).alias("p"),
        F.min_by(x, period).alias("x1"), F.max_by(x, period).alias("xn"),
    )
    n, s, q, p, x1, xn = (F.col(c) for c in ("n", "s", "q", "p", "x1", "xn"))

    def step(state, _):
        m = state["m"]
        a = q - 2 * m * s + n * m * m
        cross = p - m * (2 * s - x1 - xn) + (n - 1) * m * m
        inner = a - (x1 - m) * (x1 - m) - (xn - m) * (xn - m)
        a2, a1, a0 = (F.try_divide(v, (n - 1) * inner) for v in (-(n - 2) * cross, -(n * inner + a), n * cross))
        big = (a2 * a2 - 3 * a1) / 9
        turn = F.acos(F.greatest(F.least((2 * a2 * a2 * a2 - 9 * a2 * a1 + 27 * a0) / (54 * big * F.sqrt(big)), F.lit(1.0)), F.lit(-1.0)))
        root = -2 * F.sqrt(big) * F.cos((turn - 2 * math.pi) / 3) - a2 / 3
        phi = F.coalesce(F.nanvl(F.when((a > 0) & (inner > 0), root), F.lit(0.0)), F.lit(0.0))
        # the coefficient is bound before the mean is made of it
        return F.aggregate(F.array(phi), state, lambda _, f: F.struct(f.alias("phi"), (((1 + f) * x1 + (s - x1) - f * (s - xn)) / ((1 + f) + (n - 1) * (1 - f))).alias("m")))

    start = F.struct(F.lit(0.0).alias("phi"), (s / n).alias("m"))
    fit = F.aggregate(F.sequence(F.lit(1), F.lit(LIKELIHOOD_STEPS)), start, step)
    return sums.withColumn("_f", fit).select(*keys, n.cast("long").alias("n"), (F.col("c") + F.col("_f.m")).alias("mean"), F.col("_f.phi").alias("phi"))


def autoregression(series: DataFrame, keys: list[str], value: str, period: str = "period", least: int = 6) -> DataFrame:
    """keys, period, nom_mean: values fitted by a first-order autoregression of growth, by exact likelihood within each key; keys with fewer than `least` known values have none.

    The first growth rate is fitted by the mean. Growth goes from one known value to the next: a missing period shifts what follows, so give a dense series if periods may lack.
    """
    w = Window.partitionBy(*keys).orderBy(period)
    rows = growth(series.where(F.col(value).isNotNull()), keys, value, period).withColumns({"_g": F.lag("growth").over(w), "_y": F.lag(value).over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    rows = rows.where(F.col("_n") >= least)
    fit = likelihood_ar1(rows, keys, "growth", period).select(*keys, F.col("mean").alias("_m"), F.col("phi").alias("_phi"))
    fitted = F.col("_m") + F.coalesce(F.col("_phi") * (F.col("_g") - F.col("_m")), F.lit(0.0))
    return rows.join(fit, keys).where(F.col("_y").isNotNull()).select(*keys, period, (F.col("_y") * (1 + fitted)).alias("nom_mean"))


def offset(pairs: DataFrame, keys: list[str], target: str, reference: str, least: int = 8) -> DataFrame:
    """keys, n, shift: the mean of target less reference over rows where both are known; 0 for fewer than `least`."""
    both = F.col(target).isNotNull() & F.col(reference).isNotNull()
    n = F.count(F.when(both, 1))
    return pairs.groupBy(*keys).agg(n.alias("n"), F.when(n >= least, F.avg(F.when(both, F.col(target) - F.col(reference)))).otherwise(F.lit(0.0)).alias("shift"))


def preliminary(panel: DataFrame) -> DataFrame:
    """period, category, nom_mean: the first published figures as a forecast of the final ones."""
    return panel.where(F.col("nom_preliminary").isNotNull()).select("period", "category", F.col("nom_preliminary").alias("nom_mean"))


def latest_truth(observations: DataFrame, keys: list[str], by: list[str], vintage: str = "vintage_date") -> DataFrame:
    """by, nom_truth: the latest vintage of each key, summed by the columns in by (nothing sums to 0)."""
    last = observations.groupBy(*keys).agg(F.max_by("value", vintage).alias("value"))
    return last.groupBy(*by).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("nom_truth"))


def latest_figures(observations: DataFrame, vintage: str = "vintage_date") -> DataFrame:
    """period, category, nom_truth of stored figures: the latest vintage of each series and period, by the category of the series that its metadata name, total where they name none."""
    last = observations.groupBy("series_id", "period").agg(F.max_by("value", vintage).alias("value"), F.max_by("metadata", vintage).alias("metadata"))
    category = F.coalesce(labels.visa_group(F.get_json_object("metadata", "$.series")), F.lit("total"))
    return last.groupBy("period", category.alias("category")).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("nom_truth"))


def with_preliminary(truth: DataFrame, first: DataFrame, origins: DataFrame, keys: list[str], day: str = "asof_date") -> DataFrame:
    """day, keys, nom_truth, nom_prelim and prelim_is_truth: figures as first published at each origin; where an origin has none at all, the truth stands in for them, and is flagged."""
    has = first.select(day).distinct().withColumn("_has", F.lit(True))
    rows = truth.crossJoin(F.broadcast(origins.select(day).distinct())).join(F.broadcast(has), day, "left").join(first, [day, *keys], "left")
    stand_in = F.col("_has").isNull()
    return rows.select(day, *keys, "nom_truth", F.when(stand_in, F.col("nom_truth")).otherwise(F.col("nom_prelim")).alias("nom_prelim"), stand_in.alias("prelim_is_truth"))
