"""Estimators as grouped maps: a task fits one group, and groups (category and direction, grid point, chain, backtest origin) are spread by Spark.

A fit that fails returns rows with a status instead of raising, so that one bad series doesn't end a job.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.labels import regime_by_breaks
from . import statespace as ss
from .leastsquares import predicted, regressions
from .ratios import gamma_weights
from .scoring import lags
from .staging import staged

#: Tasks that groups are dealt to, for each core.
TASKS_A_CORE = 4
#: Observations that a structural model needs, steps ahead, and the largest standard error on the log scale.
LEAST, STEPS, SE_CAP = 12, 4, 1.0
FORECAST = "period date, mean_log double, se_log double, mean_level double, forecast_horizon int, status string"


def _schema(df: DataFrame, keys: list[str], rest: str) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + T._parse_datatype_string(rest).fields)


def _grouped(df: DataFrame, keys: list[str], fit, rest: str) -> DataFrame:
    """fit(frame of a group) gives a frame with the columns of rest; the keys are put in front. An exception becomes one row with its text as status."""
    schema = _schema(df, keys, rest)
    columns = schema.fieldNames()[len(keys) :]

    def run(key, group):
        try:
            out = fit(group.reset_index(drop=True))
        except Exception as e:  # noqa: BLE001  a failed fit is a result
            out = pd.DataFrame([{c: f"failed: {e}"[:200] if c == "status" else None for c in columns}])
        for k, v in zip(keys, key, strict=True):
            out[k] = v
        return out[keys + columns] if len(out) else out.reindex(columns=keys + columns).astype(object)

    # a fit is slow and its rows are few: dealt by number, groups are not put together again in a few tasks because they are small
    parts = TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts, *keys).groupBy(*keys).applyInPandas(run, schema)


def _future(periods: pd.Series, steps: int) -> list:
    last = pd.Timestamp(periods.iloc[-1])
    return [*periods, *((last + pd.DateOffset(months=3 * (k + 1))).date() for k in range(steps))]


def _levels(periods, mean, se, n: int) -> pd.DataFrame:
    se = np.minimum(se, SE_CAP)
    return pd.DataFrame({"period": periods, "mean_log": mean, "se_log": se, "mean_level": np.expm1(mean + se**2 / 2), "forecast_horizon": [*range(1 - n, 1), *range(1, len(mean) - n + 1)], "status": "ok"})


def structural_forecasts(series: DataFrame, keys: list[str], value: str = "value", trend: str = "damped", phi: float = 0.85, period: int = 4, steps: int = STEPS) -> DataFrame:
    """keys, period, mean_log, se_log, mean_level, forecast_horizon, status: a structural model of log(1 + value) for each key, smoothed and ahead."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("period", ignore_index=True)
        y = np.log1p(np.maximum(group[value].to_numpy(float), 0))[:, None]
        if np.isfinite(y).sum() < LEAST:
            raise ValueError("too few observations")
        model = ss.structural(trend, phi, period)
        season = len(model.q) - period + 1
        free = [0, season] if trend == "level_only" else [0, 1, season]
        model, _ = ss.estimated(model, y, free, [0], [-2.0] + [-4.0] * len(free))
        mean, se = ss.forecast(model, y, 0, steps)
        return _levels(_future(group["period"], steps), mean, se, len(group))

    return _grouped(series.select(*keys, "period", value), keys, fit, FORECAST)


def _joint_series(panel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, period, arrivals, grants, target of the total: grants summed over categories, unknown where they come to nothing. One row a period; periods without the total are left out."""
    total = F.col("category") == "total"
    of_total = lambda c: F.max(F.when(total, F.col(c)))
    grants = F.sum(F.when(~total, F.col("visa_grants")))
    rows = panel.groupBy(*(keys or []), "period").agg(of_total("oad_lt_arrivals").alias("arrivals"), F.when(grants > 0, grants).alias("grants"), of_total("nom_final").alias("target"), F.bool_or(total).alias("_total"))
    return rows.where("_total").drop("_total")


def _offset(target: np.ndarray, reference: np.ndarray, least: int = 8) -> float:
    ok = np.isfinite(target) & np.isfinite(reference) & (target > 0) & (reference > 0)
    return float((target - reference)[ok].mean()) if ok.sum() >= least else 0.0


def _fit_joint(group: pd.DataFrame, weights: list[float] | None, lead: int, target: bool, drifting: bool, phi: float, period: int):
    """(model, observations, log likelihood, offset of the target)."""
    log = lambda c: np.log1p(np.maximum(group[c].to_numpy(float), 0))
    shift = len(weights) - 1 if weights else lead
    y1, grants = log("arrivals"), log("grants")
    y2 = np.concatenate([np.full(min(shift, len(grants)), np.nan), grants[: max(0, len(grants) - shift)]])
    rows, alpha = [y1, y2 - _offset(y2, y1)], 0.0
    if target:
        y3 = log("target")
        alpha = _offset(y3, y1)
        rows.append(y3 - alpha)
    model = ss.joint(weights, target, drifting, phi, period)
    free_h = [0, 1] if drifting or not target else [0, 1, 2]
    if drifting and target:
        model.q[-1], model.h[2] = 0.01, 0.005
    y = np.stack(rows, 1)
    model, loglik = ss.estimated(model, y, [0, 1, 2], free_h, [-2.3] * len(free_h) + [-4.6] * 3)
    return model, y, loglik, alpha


JOINT = FORECAST.replace(", status", ", nom_log double, nom_se_log double, nom_level double, status")


def joint_forecasts(panel: DataFrame, keys: list[str] | None = None, alpha: float = 2.0, beta: float = 1.0, lag: int = 4, gamma_lag: bool = True, lead: int = 1, target: bool = True, drifting: bool = False, phi: float = 0.85, period: int = 4, steps: int = STEPS) -> DataFrame:
    """The total's arrivals, grants and published figures on one latent level; forecasts of arrivals and of the figure.

    keys: columns of panel by which it is fitted separately (backtest origins).
    """
    keys = keys or []
    weights = gamma_weights(alpha, beta, lag) if gamma_lag else None
    series = _joint_series(panel, keys)
    if not keys:
        series = series.withColumn("_one", F.lit(1))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("period", ignore_index=True)
        model, y, _, shift = _fit_joint(group, weights, lead, target, drifting, phi, period)
        mean, se = ss.forecast(model, y, 0, steps)
        out = _levels(_future(group["period"], steps), mean, se, len(group))
        if target:
            level, error = ss.forecast(model, y, 2, steps) if drifting else (mean, se)
            error = np.minimum(error, SE_CAP)
            out["nom_log"], out["nom_se_log"] = level + shift, error
            out["nom_level"] = np.expm1(level + shift + error**2 / 2)
        else:
            out["nom_log"] = out["nom_se_log"] = out["nom_level"] = np.nan
        return out

    by = keys or ["_one"]
    return _grouped(series, by, fit, JOINT).drop("_one")


#: Shapes and rates of the lag that are searched.
ALPHAS, BETAS = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0), (0.5, 1.0, 1.5, 2.0)


def lag_grid(panel: DataFrame, alphas: Sequence[float] = ALPHAS, betas: Sequence[float] = BETAS, lag: int = 4, target: bool = True, phi: float = 0.85, period: int = 4) -> DataFrame:
    """alpha, beta, loglik, status: the joint model's likelihood at each point of a grid of lag shapes, a task for each. The panel's total is one short series, joined to every point."""
    spark = panel.sparkSession
    grid = spark.createDataFrame([(a, b) for a in alphas for b in betas], "alpha double, beta double").repartition(len(alphas) * len(betas))
    rows = grid.crossJoin(_joint_series(panel))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        weights = gamma_weights(float(group["alpha"].iloc[0]), float(group["beta"].iloc[0]), lag)
        _, _, loglik, _ = _fit_joint(group.sort_values("period", ignore_index=True), weights, 1, target, False, phi, period)
        return pd.DataFrame([{"loglik": loglik, "status": "ok"}])

    return _grouped(rows, ["alpha", "beta"], fit, "loglik double, status string")


def best_lag(grid: DataFrame) -> DataFrame:
    """The grid point with the largest finite likelihood."""
    ok = grid.where("loglik is not null and not isnan(loglik)")
    return ok.agg(F.max_by(F.struct("alpha", "beta", "loglik"), "loglik").alias("b")).select("b.*")


def smoothed_ratios(ratios: DataFrame, smoother: str = "loess", span: float = 0.5, weight: float = 1600.0, breaks: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """category, regime, period, pi_smoothed, pi_se, status of each category and regime: loess, hp, locallinear or none. Below five known points the ratio itself."""
    if smoother not in ("loess", "hp", "locallinear", "none"):
        raise ValueError(smoother)
    keys = keys or []
    rows = ratios.withColumn("regime", regime_by_breaks("period", breaks or [])).select(*keys, "category", "regime", "period", "pi_hat")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("period", ignore_index=True)
        y = group["pi_hat"].to_numpy(float)
        ok = np.isfinite(y)
        spread = lambda v: float(np.std(v[np.isfinite(v)], ddof=1)) if np.isfinite(v).sum() > 1 else 0.0
        mean, se = y.copy(), np.full(len(y), spread(y))
        if ok.sum() >= 5 and smoother != "none":
            filled = np.where(ok, y, y[ok].mean())
            if smoother == "loess":
                x = pd.to_datetime(group["period"]).to_numpy().astype("datetime64[D]").astype(float)
                mean, se = ss.local_regression(x[ok], y[ok], x, span)
                bad = ~np.isfinite(mean) | ((mean == 0) & ok & (y != 0))
                mean, se = np.where(bad, y, mean), np.where(np.isfinite(se), se, spread(y))
            elif smoother == "hp":
                mean = np.where(ok, ss.hodrick_prescott(filled, weight), np.nan)
                se = np.full(len(y), spread(y - mean))
            else:
                model = ss.structural("local_linear", period=2)
                model = ss.Model(model.T[:2, :2], model.Z[:, :2], model.q[:2], model.h, model.p1[:2])
                model, _ = ss.estimated(model, filled[:, None], [0, 1], [0], [-4.0, -6.0, -6.0])
                mean, se = ss.forecast(model, filled[:, None], 0, 0)
        return pd.DataFrame({"period": group["period"], "pi_smoothed": mean, "pi_se": se, "status": "ok"})

    return _grouped(rows, [*keys, "category", "regime"], fit, "period date, pi_smoothed double, pi_se double, status string")


def bridge_forecasts(panel: DataFrame, last: int = 4, keys: list[str] | None = None) -> DataFrame:
    """keys, category, period, nom_mean, status: least squares of the published figure on arrivals and grants of this and the last quarters; null where a regressor is.

    The total's grants are those of all categories, where nothing counts as 0. Categories without enough figures (last + 4) have no rows. Sums of products by category make the
    fit, so no category is gathered. Lags are rows before: a missing quarter shifts them, so give a dense panel.
    """
    keys = keys or []
    w = Window.partitionBy(*keys, "period")
    of_all = F.coalesce(F.sum(F.when(F.col("category") != "total", F.col("visa_grants"))).over(w), F.lit(0.0))
    rows = panel.withColumn("visa_grants", F.when(F.col("category") == "total", of_all).otherwise(F.col("visa_grants")))
    names = [f"{c}_l{k}" for c in ("oad_lt_arrivals", "visa_grants") for k in range(last + 1)]
    each = [*keys, "category"]
    enough = F.count("nom_final").over(Window.partitionBy(*each)) >= last + 4
    features = staged(lags(rows.withColumn("_enough", enough), ["oad_lt_arrivals", "visa_grants"], last, each).where("_enough").select(*each, "period", "nom_final", *names), "bridge")
    fit = regressions(features, each, "nom_final", names)
    return features.join(fit, each, "left").select(*each, "period", predicted(names).alias("nom_mean"), F.lit("ok").alias("status"))


#: Priors of the Bayesian model on log figures, and how it is sampled.
PRIORS = {"mu0": 11.0, "mu0_sd": 1.5, "slope0_sd": 0.1, "obs_sd": 0.3, "state_sd": 0.1, "alpha_sd": 1.0, "phi": 0.85, "phi_conc": 10.0, "seas0_sd": 0.5, "seas_sd": 0.05}
#: Chains walk side by side at little more than the cost of one; every `thin`-th draw is used.
SAMPLING = {"chains": 24, "warmup": 500, "draws": 500, "thin": 10, "seed": 20260520}
SIMULATIONS = 20


def _bayes_model(x: np.ndarray, weights: list[float], seasonal_: bool) -> tuple[ss.Model, np.ndarray, float, float]:
    """(model, mean of the first state, offsets of grants and figure) at a point of the parameter space.

    x: grants' and figure's offsets, logs of three observation, two state (and two seasonal) standard deviations, logit of the damping, first level and slope.
    """
    lags_ = len(weights) - 1
    m = 2 + lags_ + 6 * seasonal_
    sd = np.exp(x[2:7])
    phi = 1 / (1 + np.exp(-x[7]))
    T_ = np.zeros((m, m))
    T_[0, 0] = T_[0, 1] = 1
    T_[1, 1] = phi
    for k in range(lags_):
        T_[2 + k, 0 if k == 0 else 1 + k] = 1
    Z = np.zeros((3, m))
    Z[0, 0] = Z[1, 0] = 1
    for k in range(lags_ + 1):
        Z[2, 0 if k == 0 else 1 + k] = weights[lags_ - k]
    q, first = np.zeros(m), np.zeros(m)
    q[0], q[1] = sd[3] ** 2, sd[4] ** 2
    p1 = np.full(m, PRIORS["mu0_sd"] ** 2)
    p1[1] = PRIORS["slope0_sd"] ** 2
    first[: 2 + lags_] = x[8]
    first[1] = x[9]
    if seasonal_:
        for b in range(2):
            s = 2 + lags_ + 3 * b
            ss.seasonal(T_, s, 4)
            q[s] = np.exp(2 * x[10 + b])
            p1[s : s + 3] = PRIORS["seas0_sd"] ** 2
        Z[0, 2 + lags_] = Z[2, 2 + lags_] = Z[1, 5 + lags_] = 1
    return ss.Model(T_, Z, q, sd[[0, 2, 1]] ** 2, p1), first, x[0], x[1]


def _bayes_filter(models: list[tuple[ss.Model, np.ndarray, float, float]], y: np.ndarray, steps: int | None = None):
    """Log likelihoods of y under many models at once; with steps also the figure's signals with their standard deviations: filtered, then ahead. Each step moves before it observes."""
    stack = lambda f: np.stack([f(m) for m in models])
    T_, Z, Q, h = stack(lambda m: m[0].T), stack(lambda m: m[0].Z), stack(lambda m: np.diag(m[0].q)), stack(lambda m: m[0].h)
    a, P = stack(lambda m: m[1]), stack(lambda m: np.diag(m[0].p1))
    back = T_.transpose(0, 2, 1).copy()
    shift = np.array([[0.0, m[3], m[2]] for m in models])
    known, loglik, mean, sd = np.isfinite(y), np.zeros(len(models)), [], []
    for t in range(len(y) + (steps or 0)):
        a, P = (T_ @ a[:, :, None])[:, :, 0], T_ @ P @ back + Q
        if t < len(y):
            for i in np.flatnonzero(known[t]):
                z = Z[:, i]
                Pz = (P @ z[:, :, None])[:, :, 0]
                f = (z * Pz).sum(1) + h[:, i]
                v = y[t, i] - shift[:, i] - (z * a).sum(1)
                gain = Pz / f[:, None]
                a = a + gain * v[:, None]
                P = P - gain[:, :, None] * Pz[:, None, :]
                loglik -= 0.5 * (np.log(2 * np.pi * f) + v * v / f)
        if steps is not None:
            z = Z[:, 1]
            mean.append((z * a).sum(1))
            sd.append(np.sqrt(np.maximum((z * (P @ z[:, :, None])[:, :, 0]).sum(1), 0)))
    return loglik if steps is None else (loglik, np.stack(mean, 1), np.stack(sd, 1))


#: Bounds of a learned lag shape, and the spread of its logarithms around the given one.
LAG_BOUNDS, LAG_SD = ((0.3, 10.0), (0.1, 5.0)), 0.5


def _bayes_prior(x: np.ndarray, seasonal_: bool) -> float:
    """Normal and half-normal priors; logs and the logit bring their own Jacobians."""
    p, sd = PRIORS, np.exp(x[2:7])
    value = -0.5 * (x[:2] ** 2).sum() / p["alpha_sd"] ** 2 - 0.5 * (sd[:3] ** 2).sum() / p["obs_sd"] ** 2 - 0.5 * (sd[3:] ** 2).sum() / p["state_sd"] ** 2 + x[2:7].sum()
    a, b = p["phi"] * p["phi_conc"], (1 - p["phi"]) * p["phi_conc"]
    value += -a * np.log1p(np.exp(-x[7])) - b * np.log1p(np.exp(x[7]))
    value += -0.5 * ((x[8] - p["mu0"]) / p["mu0_sd"]) ** 2 - 0.5 * (x[9] / p["slope0_sd"]) ** 2
    if seasonal_:
        value += (-0.5 * np.exp(2 * x[10:]) / p["seas_sd"] ** 2 + x[10:]).sum()
    return float(value)


class _Posterior:
    """The log posterior at many points; with shape, the last two parameters are the logs of the lag's shape and rate, around it."""

    def __init__(self, y: np.ndarray, weights: list[float], seasonal_: bool, shape: tuple[float, float] | None = None):
        self.y, self.weights, self.seasonal, self.shape = y, weights, seasonal_, shape

    def split(self, x: np.ndarray) -> tuple[np.ndarray, list[float], float] | None:
        """The other parameters, the lag's weights and the lag's log prior; None out of bounds."""
        used, lag = self.weights, 0.0
        if self.shape:
            ab, x = np.exp(x[-2:]), x[:-2]
            if any(not low <= v <= high for v, (low, high) in zip(ab, LAG_BOUNDS, strict=True)):
                return None
            lag = -0.5 * float(((np.log(ab / np.array(self.shape)) / LAG_SD) ** 2).sum())
            used = gamma_weights(float(ab[0]), float(ab[1]), len(self.weights) - 1)
        if np.abs(x[2:8]).max() > 12 or self.seasonal and np.abs(x[10:]).max() > 12:
            return None
        return x, used, lag

    def models(self, points: np.ndarray) -> list:
        return [_bayes_model(x, used, self.seasonal) for x, used, _ in map(self.split, points)]

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out, parts = np.full(len(points), -np.inf), [self.split(x) for x in points]
        inside = [k for k, part in enumerate(parts) if part is not None]
        if inside:
            fit = _bayes_filter([_bayes_model(parts[k][0], parts[k][1], self.seasonal) for k in inside], self.y)
            out[inside] = [fit[j] + parts[k][2] + _bayes_prior(parts[k][0], self.seasonal) for j, k in enumerate(inside)]
        return np.where(np.isnan(out), -np.inf, out)


DRAWS = "chain int, draw int, period date, signal double, sd double, shift double, obs_sd double, rhat double, ess double, acceptance double, status string"


def bayes_draws(panel: DataFrame, seasonal_: bool = False, alpha: float = 2.0, beta: float = 1.0, lag: int = 4, steps: int = STEPS, warm_quarters: int = 8, sampling: dict = SAMPLING, lead: int | None = None, learned: bool = False, keys: list[str] | None = None, variants: dict[str, dict] | None = None) -> DataFrame:
    """keys (and model), chain, draw, period, signal, sd, shift, obs_sd: what each draw says of the published figure's logarithm; rhat (the worst of all parameters), ess (the least effective number of draws) and acceptance of the chains.

    A group of keys (a backtest origin) is a task, whose chains walk side by side. lead: grants stand for the level so many quarters later, instead of a spread over lags; learned: the spread's shape is sampled too.
    variants: by the name of a model its seasonal_, lead and learned; each origin and model is then a group of its own, and all of them are fitted in one stage.
    """
    options = variants or {"": {"seasonal_": seasonal_, "lead": lead, "learned": learned}}
    series = _joint_series(panel, keys)
    groups = [*(keys or ["_one"]), *(["model"] if variants else [])]
    if not keys:
        series = series.withColumn("_one", F.lit(1))
    if variants:
        series = series.withColumn("model", F.explode(F.array(*map(F.lit, variants))))

    def sample(group: pd.DataFrame) -> pd.DataFrame:
        own = options[group["model"].iloc[0] if variants else ""]
        seasonal_, lead, learned = own.get("seasonal_", False), own.get("lead"), own.get("learned", False)
        weights = [1.0] if lead is not None else gamma_weights(alpha, beta, lag)
        first_grants, shape = (lead if lead is not None else lag), (alpha, beta) if learned and lead is None else None
        group = group.sort_values("period", ignore_index=True)
        seen = np.flatnonzero(group["target"].notna())
        group = group.iloc[max(0, int(seen[0]) - warm_quarters) if len(seen) else 0 :].reset_index(drop=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = np.log(group[["arrivals", "target", "grants"]].to_numpy(float))
        y[~np.isfinite(y)] = np.nan
        if np.isfinite(y[:, 0]).sum() < LEAST:
            raise ValueError("too few observations")
        if lead:
            y[lead:, 2] = y[:-lead, 2].copy()
        y[:first_grants, 2] = np.nan
        level = np.nanmean(y[:4, 0]) if np.isfinite(y[:4, 0]).any() else PRIORS["mu0"]
        gap = lambda k: np.nan_to_num(np.nanmean(y[:, k] - y[:, 0]) if np.isfinite(y[:, k] - y[:, 0]).any() else 0.0)
        start = np.array([gap(2), gap(1), -2, -2, -2, -3, -4, 1.5, level, 0.0, *([-3.5] * 2 if seasonal_ else []), *(np.log(shape) if shape else [])])
        posterior = _Posterior(y, weights, seasonal_, shape)
        starts = start + 0.1 * np.random.default_rng(sampling["seed"]).standard_normal((sampling["chains"], len(start)))
        chains, accepted = ss.adaptive_metropolis(posterior, starts, sampling["draws"], sampling["warmup"], sampling["seed"])
        used = chains[:, :: sampling.get("thin", 1)]
        points = used.reshape(-1, used.shape[-1])
        models = posterior.models(points)
        _, mean, sd = _bayes_filter(models, y, steps)
        periods, n = _future(group["period"], steps), mean.shape[1]
        which = np.repeat(np.arange(len(points)), n)
        rhat, ess = float(ss.split_rhat(list(chains)).max()), float(ss.effective_draws(chains).min())
        return pd.DataFrame({
            "chain": which // used.shape[1], "draw": which % used.shape[1], "period": list(periods) * len(points), "signal": mean.ravel(), "sd": sd.ravel(), "shift": np.array([m[3] for m in models])[which], "obs_sd": np.exp(points[:, 4])[which],
            "rhat": rhat, "ess": ess, "acceptance": float(accepted.mean()), "status": "ok",
        })

    return _grouped(series, groups, sample, DRAWS).drop("_one")


def bayes_headline(draws: DataFrame, seed: int = SAMPLING["seed"], keys: list[str] | None = None) -> DataFrame:
    """keys, period, nom_mean, nom_se, intervals, and of the chains behind them their number, rhat, ess and acceptance: the mean from the signal, the intervals from simulated figures.

    Groups whose fit failed have no rows; draws.where("status <> 'ok'") has them with the reason.
    """
    keys = keys or []
    center = F.exp(F.col("signal") + F.col("shift") + F.col("sd") * F.col("sd") / 2)
    total = F.sqrt(F.col("sd") * F.col("sd") + F.col("obs_sd") * F.col("obs_sd"))
    rows = draws.where("status = 'ok'").withColumn("mean", center)
    normal = F.expr(f"sequence(1, {SIMULATIONS})")
    chain = ["rhat", "ess", "acceptance"]
    sims = rows.select(*keys, "period", "mean", F.explode(normal).alias("k"), (F.col("signal") + F.col("shift")).alias("m"), total.alias("s"), "chain", "draw", *chain)
    # a normal from two uniforms of a hash, so that a repeated task gives the same figures
    u = lambda tag: (F.pmod(F.xxhash64("chain", "draw", "period", "k", F.lit(seed), F.lit(tag)), F.lit(10**12)) + 0.5) / 1e12
    z = F.sqrt(-2 * F.ln(u("r"))) * F.cos(2 * F.pi() * u("a"))
    sims = sims.withColumn("figure", F.exp(F.col("m") + F.col("s") * z))
    ends = {"lower_80": 0.10, "upper_80": 0.90, "lower_95": 0.025, "upper_95": 0.975}
    # one list of figures for all four ends
    out = sims.groupBy(*keys, "period").agg(
        F.avg("mean").alias("nom_mean"), F.stddev_samp("mean").alias("nom_se"), F.percentile("figure", F.array(*map(F.lit, ends.values()))).alias("_ends"),
        (F.max("chain") + 1).alias("chains"), *(F.max(c).alias(c) for c in chain),
    )
    return out.select(*keys, "period", "nom_mean", "nom_se", *(F.get("_ends", F.lit(i)).alias(c) for i, c in enumerate(ends)), "chains", *chain)
