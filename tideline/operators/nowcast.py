"""A run from the store to the headline, driven by the configuration alone."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.calendar import vintage_status
from . import fits, panel, ratios, replay
from .staging import staged
from .store import VintageStore
from .vintages import reenriched_figures, reenriched_flows, reenriched_grants


@dataclass(frozen=True)
class Run:
    """day: what was known then was used. panel, ratio, smoothed, by_category, headline: the steps' results."""

    day: date
    panel: DataFrame
    ratio: DataFrame
    smoothed: DataFrame
    by_category: DataFrame
    headline: DataFrame


def run(store: VintageStore, config: Config, today: date, current: dict[str, DataFrame] | None = None) -> Run:
    """Reads the store as of the configured day, builds the panel, estimates and smooths ratios, forecasts flows and puts nowcasts together, each by the settings for it.

    current: observations of sources that had no vintage by then (see replay.known_from_store). Grants whose id or series contains a name of grants_exclude are left out. Categories outside of the configured
    ones and `total` have no rows in the panel.
    """
    day = config.day(today)
    origin = store.spark.createDataFrame([(day,)], f"{replay.DAY} date")
    lags = {"oad": config.flow_lag_days, "nom": config.figure_lag_days, "visa_grants": config.grants_lag_days}
    known = {source: rows.drop(replay.DAY) for source, rows in replay.known_from_store(store, origin, current or {}, lags).items()}
    named = F.lower(F.concat_ws(" ", "series_id", F.get_json_object("metadata", "$.series")))
    grants = known["visa_grants"]
    for word in config.grants_exclude:
        grants = grants.where(~named.contains(word.lower()))
    flows = reenriched_flows(known["oad"].where("period_unit = 'month'")).where("category is not null and direction in ('arrival', 'departure')")
    flows = flows.groupBy("period", "category", "direction").agg(F.sum("value").alias("value"))
    figures = reenriched_figures(known["nom"].where("period_unit = 'quarter'")).where("category is not null")
    figures = figures.select("period", "category", "value", vintage_status("period", F.lit(day)).alias("vintage_status"))
    built = panel.build_panel(flows, figures, reenriched_grants(grants).where("category is not null"), list(config.categories), config.partial_quarter, config.share_years, config.disaggregation == "proportional")
    built = staged(built, "panel")
    ratio = staged(ratios.empirical_ratio(built, config.completion_quarters, config.ratio_floor, config.ratio_ceiling, levels=list(config.categories)), "ratio")
    smoothed = staged(fits.smoothed_ratios(ratio, config.smoother, config.loess_span, config.hp_lambda, list(config.regime_breaks)).where("status = 'ok'"), "smoothed")
    sides = F.inline(F.array(*(F.struct(F.lit(d).alias("direction"), F.col(f"oad_lt_{d}s").alias("value")) for d in ("arrival", "departure"))))
    series = built.select("period", "category", sides).where("value is not null")
    forecasts = fits.structural_forecasts(series, ["category", "direction"], trend=config.trend, phi=config.damping, period=config.seasonal_period).where("status = 'ok'")
    later = ratios.projected(smoothed, ["category"], config.projection, config.projection_window)
    by_category = staged(ratios.nowcast_by_category(forecasts.select("period", "category", "direction", "mean_level", "se_log"), smoothed, later), "by-category")
    return Run(day, built, ratio, smoothed, by_category, ratios.headline(by_category))
