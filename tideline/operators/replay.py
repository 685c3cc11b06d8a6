"""Backtests as one plan: origins are a column, and every later step groups by it.

What was known at an origin is the latest vintage not after it; a source without any vintage at that origin falls back to today's
figures, less those that were not out yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import first_observable, horizon, quarter_start, vintage_status
from ..functions.labels import regime_by_ranges
from . import fits, panel, ratios, scoring
from .staging import staged
from .store import VintageStore
from .vintages import as_of_many, reenriched_figures, reenriched_flows, reenriched_grants

DAY = "asof_date"
# Names of the model streams, regimes that scores are split by, and how the Bayesian variants differ.
HORIZONS = (-2, -1, 0, 1)
REGIMES = [("pre_covid", "1900-01-01", "2019-12-31"), ("covid", "2020-01-01", "2021-12-31"), ("post_covid", "2022-01-01", "2099-12-31")]
BAYES = {"bayes_headline": {"lead": 1}, "bayes_gamma_learned": {"learned": True}, "bayes_kalman": {}, "bayes_kalman_seasonal": {"seasonal_": True}}
PLAIN = ("kalman_multi_v2", "kalman_multi_pi", "kalman_v1", "bridge", "ar1", "random_walk", "abs_preliminary")
#: Latest origins that the Bayesian variants are fitted at.
BAYES_WINDOW = 12
#: Their walks are half as long as a single fit's.
SAMPLING = fits.SAMPLING | {"warmup": 250, "draws": 250, "thin": 5}
COLUMNS = [DAY, "model", "category", "period", "horizon", "nom_mean", "nom_se", "lower_80", "upper_80", "lower_95", "upper_95", "rhat", "ess"]
#: Chains with a larger rhat have not converged: what they say is not scored.
MOST_RHAT = 1.1
#: The sources of a store, and the days after a period's end when its figures are out.
LAGS = {"oad": 35, "nom": 183, "visa_grants": 45}
OBSERVED = ["series_id", "period", "period_unit", "value", "unit", "metadata"]


def known_at(origins: DataFrame, recorded: DataFrame, current: DataFrame, keys: list[str], lag_days: int, unit: str = "period_unit", label: str = "nom_vintage") -> DataFrame:
    """The rows of current's columns (keys and value among them) known at each origin, and a label: real or pseudo.

    recorded: the same columns and vintage_date; current: today's figures, of which those are taken at an origin before the first recorded vintage
    that were out by then. A recorded vintage is what was out: no lag applies to it.
    """
    first = F.broadcast(recorded.agg(F.min("vintage_date").alias("_first")))
    days = origins.select(DAY).distinct().crossJoin(first).withColumn("_real", F.coalesce(F.col(DAY) >= F.col("_first"), F.lit(False)))
    real = as_of_many(recorded, days.where("_real"), keys, "vintage_date", DAY).select(DAY, *current.columns, F.lit("real").alias(label))
    period_unit = F.coalesce(F.col(unit), F.lit("month")) if unit in current.columns else F.lit("month")
    pseudo = current.crossJoin(F.broadcast(days.where("not _real").select(DAY))).where(first_observable("period", period_unit, lag_days) <= F.col(DAY))
    return real.unionByName(pseudo.select(DAY, *current.columns, F.lit("pseudo").alias(label)))


def known_from_store(store: VintageStore, origins: DataFrame, current: dict[str, DataFrame], lags: dict[str, int] = LAGS) -> dict[str, DataFrame]:
    """By source what was known at each origin: asof_date, series_id, period, period_unit, value, unit, metadata and vintage (real or pseudo).

    Each source decides by its own first vintage: at one origin one can be real and another pseudo. current: by source today's observations with the columns of OBSERVED; a source
    without any has only what the store recorded.
    """
    out = {}
    for source, lag in lags.items():
        recorded = store.read(source).select(*OBSERVED, "vintage_date")
        today = current[source].select(*OBSERVED) if source in current else recorded.limit(0).select(*OBSERVED)
        out[source] = known_at(origins, recorded, today, ["series_id", "period"], lag, label="vintage")
    return out


def panels_from_store(known: dict[str, DataFrame], partial: str = "scale", share_years: int = 5) -> DataFrame:
    """panels_at() of what known_from_store() gives: what the store doesn't keep is found again in the ids and the metadata, and series of one category are added up.

    Flows are by month, figures by quarter, grants by month or quarter; rows of other units, or of no category, are left out.
    """
    summed = lambda df, *more: df.where("category is not null").groupBy(DAY, "period", "category", *more).agg(F.sum("value").alias("value"))
    flows = summed(reenriched_flows(known["oad"].where("period_unit = 'month'")).where("direction in ('arrival', 'departure')"), "direction")
    figures = summed(reenriched_figures(known["nom"].where("period_unit = 'quarter'")))
    grants = summed(reenriched_grants(known["visa_grants"].where("period_unit in ('month', 'quarter')")))
    return panels_at(flows, figures, grants, partial, share_years)


def panels_at(flows: DataFrame, published: DataFrame, grants: DataFrame | None = None, partial: str = "scale", share_years: int = 5) -> DataFrame:
    """asof_date, period, category (and total), oad_lt_arrivals, oad_lt_departures, oad_lt_net, visa_grants, nom_preliminary, nom_final: the panel of each origin.

    flows: asof_date, period, category, direction, value by month; published: asof_date, period, category, value (and vintage_status, else by age) by quarter;
    grants: asof_date, period, category, value (and period_unit). A total that is not given is the sum of the categories.
    """
    cell = [DAY, "period", "category"]
    moved = panel.by_direction(panel.monthly_to_quarterly(flows, partial, share_years, [DAY]), [DAY]).drop("oad_months")
    moved = _with_total(moved, ["oad_lt_arrivals", "oad_lt_departures", "oad_lt_net"])
    status = published if "vintage_status" in published.columns else published.withColumn("vintage_status", vintage_status("period", DAY))
    figures = _with_total(panel.by_status(status, [DAY]).drop("nom_revised"), ["nom_preliminary", "nom_final"])
    out = moved.join(figures, cell, "full")
    if grants is None:
        return out.withColumn("visa_grants", F.lit(None).cast("double"))
    finer = grants.groupBy(DAY, quarter_start("period").alias("period"), "category").agg(F.sum("value").alias("visa_grants"))
    return out.join(finer, cell, "full")


def _with_total(df: DataFrame, values: list[str]) -> DataFrame:
    """df and, at origins that have no category total, the sum of the others by period."""
    given = df.where("category = 'total'").select(DAY).distinct()
    total = df.join(given, DAY, "left_anti").groupBy(DAY, "period").agg(*(F.sum(c).alias(c) for c in values)).withColumn("category", F.lit("total"))
    return df.unionByName(total, allowMissingColumns=True)


def _ratio_nowcasts(panels: DataFrame, forecasts: DataFrame, smoother: str, ceiling: float, breaks: list[str]) -> DataFrame:
    """Nowcasts by category of each origin: ratio times net flow."""
    empirical = ratios.empirical_ratio(panels, ceiling=ceiling, keys=[DAY])
    smoothed = staged(fits.smoothed_ratios(empirical, smoother, breaks=breaks, keys=[DAY]).where("status = 'ok'"), "ratios")
    return ratios.nowcast_by_category(forecasts, smoothed, ratios.projected(smoothed, [DAY, "category"]), [DAY])


def replay(panels: DataFrame, horizons: tuple[int, ...] = HORIZONS, models: tuple[str, ...] = (*PLAIN, *BAYES), bayes_window: int = BAYES_WINDOW, smoother: str = "loess", ceiling: float = 1.2, breaks: list[str] | None = None, lags: int = 4, sampling: dict = SAMPLING) -> DataFrame:
    """asof_date, model, category, period, horizon, nom_mean, nom_se and intervals of each origin's models at the evaluated horizons; rhat and ess of sampled ones.

    Horizon 0 is the quarter that was just complete on the origin's day. Each model is one grouped map over all origins together, so a backtest is a plan whose tasks are fits.
    The Bayesian variants are fitted at the last bayes_window origins, all of them in one stage. A fit that fails at an origin leaves no rows there. panels is read many times: hand it over written.
    """
    streams: list[DataFrame] = []
    add = lambda df, name: streams.append(df.withColumn("model", F.lit(name)))
    total = lambda df: df.withColumn("category", F.lit("total"))
    flows = panels.select(DAY, "period", "category", F.inline(F.array(*(F.struct(F.lit(d).alias("direction"), F.col(f"oad_lt_{d}s").alias("value")) for d in ("arrival", "departure"))))).where("value is not null")
    by_ratio = {"kalman_v1", "kalman_multi_pi", "kalman_multi_v2"} & set(models)
    joint = single = None
    if by_ratio:
        single = staged(fits.structural_forecasts(flows, [DAY, "category", "direction"]).where("status = 'ok'").select(DAY, "period", "category", "direction", "mean_level", "se_log"), "forecasts")
    if by_ratio & {"kalman_multi_pi", "kalman_multi_v2"}:
        joint = staged(fits.joint_forecasts(panels, [DAY]).where("status = 'ok'"), "joint")
        arrivals = joint.select(DAY, "period", F.lit("total").alias("category"), F.lit("arrival").alias("direction"), "mean_level", "se_log")
        # the joint forecast takes the place of the total's arrivals at origins where it was made
        kept = single.join(joint.select(DAY).distinct().withColumns({"category": F.lit("total"), "direction": F.lit("arrival")}), [DAY, "category", "direction"], "left_anti")
        by_category = staged(_ratio_nowcasts(panels, kept.unionByName(arrivals), smoother, ceiling, breaks or []), "nowcasts")
    if "kalman_multi_v2" in models:
        add(total(ratios.lognormal_headline_rows(joint, [DAY], "nom_level", "nom_se_log")), "kalman_multi_v2")
        add(by_category.where("category <> 'total'"), "kalman_multi_v2")
    if "kalman_multi_pi" in models:
        add(total(ratios.headline(by_category, [DAY])), "kalman_multi_pi")
    if "kalman_v1" in models:
        add(total(ratios.headline(_ratio_nowcasts(panels, single, smoother, ceiling, breaks or []), [DAY])), "kalman_v1")
    figures = panels.select(DAY, "category", "period", "nom_final")
    if "structural" in models:
        add(ratios.lognormal_headline_rows(fits.structural_forecasts(figures, [DAY, "category"], "nom_final").where("status = 'ok'"), [DAY, "category"]), "structural")
    if "bridge" in models:
        add(fits.bridge_forecasts(panels, lags, [DAY]).where("status = 'ok' and nom_mean is not null").select(DAY, "category", "period", "nom_mean"), "bridge")
    known = figures.where("nom_final is not null")
    w = Window.partitionBy(DAY, "category")
    if "random_walk" in models:
        last = known.withColumn("_last", F.max("period").over(w)).where(F.col("period") == F.col("_last"))
        step = last.select(DAY, "category", F.add_months("period", 3).alias("period"), F.col("nom_final").alias("nom_mean"))
        add(scoring.random_walk(known, [DAY, "category"], "nom_final").unionByName(step), "random_walk")
    if "ar1" in models:
        add(scoring.autoregression(known.where("category = 'total'"), [DAY, "category"], "nom_final"), "ar1")
    if "abs_preliminary" in models:
        add(panels.where("nom_preliminary is not null").select(DAY, "category", "period", F.col("nom_preliminary").alias("nom_mean")), "abs_preliminary")
    if variants := [m for m in BAYES if m in models]:
        nth = F.dense_rank().over(Window.orderBy(F.desc(DAY)))  # a row for each origin
        recent = staged(panels.join(panels.select(DAY).distinct().withColumn("_n", nth).where(F.col("_n") <= bayes_window).select(DAY), DAY, "left_semi"), "recent")
        draws = fits.bayes_draws(recent, keys=[DAY], sampling=sampling, variants={name: BAYES[name] for name in variants})
        streams.append(total(fits.bayes_headline(draws, keys=[DAY, "model"])))
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    for c in ("nom_se", "lower_80", "upper_80", "lower_95", "upper_95", "rhat", "ess"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    out = out.withColumn("horizon", horizon("period", quarter_start(F.date_sub(DAY, 1))))
    return out.where(F.col("horizon").isin(list(horizons)) & F.col("nom_mean").isNotNull()).select(*COLUMNS)


def scored(runs: DataFrame, truth: DataFrame, first: DataFrame | None = None, regimes: list[tuple[str, str, str]] | None = REGIMES, most_rhat: float | None = MOST_RHAT) -> DataFrame:
    """Scores by model, horizon, regime and category; truth: period, category, nom_truth. Forecasts of chains whose rhat is above most_rhat are counted in unconverged and not scored; None scores all.

    first: asof_date, period, category, nom_prelim as known at each origin; without any the truth stands in. Without regimes all periods are `all`; a period in none has a null regime.
    """
    origins = runs.select(DAY).distinct()
    none = truth.sparkSession.createDataFrame([], f"{DAY} date, period date, category string, nom_prelim double")
    both = scoring.with_preliminary(truth, none if first is None else first, origins, ["period", "category"], DAY)
    rows = runs.join(both, [DAY, "period", "category"], "left")
    rhat = F.col("rhat") if "rhat" in runs.columns else F.lit(None).cast("double")
    loose = F.coalesce(rhat > F.lit(most_rhat).cast("double"), F.lit(False))
    rows = rows.withColumns({"_loose": loose, "nom_mean": F.when(~loose, F.col("nom_mean")), **{c: F.when(~loose, F.col(c)) for c in ("nom_se", "lower_80", "upper_80", "lower_95", "upper_95")}})
    regime = regime_by_ranges("period", regimes) if regimes else F.lit("all")
    return scoring.score(rows.withColumn("regime", regime), ["model", "horizon", "regime", "category"], prelim="nom_prelim", also=[F.count_if("_loose").alias("unconverged")])
