"""Ratios of published figures to flows, their projection, and nowcasts made from them."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.nulls import clip

Z80, Z95 = NormalDist().inv_cdf(0.90), NormalDist().inv_cdf(0.975)


def empirical_ratio(panel: DataFrame, completion_quarters: int = 6, floor: float = 0.0, ceiling: float = 1.2, keys: list[str] | None = None, levels: list[str] | None = None) -> DataFrame:
    """period, category, n_arrivals, nom_final, pi_hat of quarters that are complete: published over arrivals, clipped.

    Where no category has a figure of its own, the total's ratio of published to net flow stands for all levels (by default the categories of the panel) and for the total itself.
    keys: columns by which it is done separately, in front of the others.
    """
    keys = keys or []
    cut = panel.groupBy(*keys).agg(F.add_months(F.max("period"), -3 * completion_quarters).alias("_cut"))
    ripe = (panel.join(cut, keys) if keys else panel.crossJoin(F.broadcast(cut))).where(F.col("period") <= F.col("_cut")).drop("_cut")
    own = ripe.where((F.col("category") != "total") & (F.col("oad_lt_arrivals") > 0) & F.col("nom_final").isNotNull())
    own = own.select(*keys, "period", "category", F.col("oad_lt_arrivals").alias("n_arrivals"), "nom_final", clip(F.col("nom_final") / F.col("oad_lt_arrivals"), floor, ceiling).alias("pi_hat"))
    total = ripe.where((F.col("category") == "total") & (F.col("oad_lt_net") > 0) & F.col("nom_final").isNotNull())
    shared = total.select(*keys, "period", F.col("oad_lt_arrivals").alias("n_arrivals"), "nom_final", clip(F.col("nom_final") / F.col("oad_lt_net"), floor, ceiling).alias("pi_hat"))
    if levels is None:
        every = panel.select("category").union(panel.limit(1).select(F.lit("total"))).distinct()
        spread = shared.crossJoin(F.broadcast(every))
    else:
        spread = shared.withColumn("category", F.explode(F.lit(sorted({*levels, "total"}))))
    if keys:
        spread = spread.join(own.select(*keys).distinct(), keys, "left_anti")
    else:
        spread = spread.crossJoin(F.broadcast(own.agg(F.count(F.lit(1)).alias("_own")))).where("_own = 0")
    return own.unionByName(spread.select(*own.columns))


def last_value(df: DataFrame, keys: list[str], value: str | list[str], method: str = "median_n", n: int = 8, period: str = "period") -> DataFrame:
    """keys and each value summarised over its last n known values: latest, mean_n or median_n; null where none is known."""
    values = [value] if isinstance(value, str) else value
    rows, how = {"latest": (1, F.max), "mean_n": (n, F.avg), "median_n": (n, F.median)}[method]
    # how many known values follow, so that each value has its own last n
    later = Window.partitionBy(*keys).orderBy(F.desc(period)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = df.withColumns({f"_r{i}": F.count(v).over(later) for i, v in enumerate(values)})
    known = ranked if len(values) > 1 else ranked.where(F.col(values[0]).isNotNull())
    return known.groupBy(*keys).agg(*(how(F.when(F.col(f"_r{i}") <= rows, F.col(v))).alias(v) for i, v in enumerate(values)))


def projected(smoothed: DataFrame, keys: list[str], method: str = "median_n", n: int = 8) -> DataFrame:
    """keys, pi_smoothed, pi_se: the ratio and its error that hold for periods without their own."""
    return last_value(smoothed, keys, ["pi_smoothed", "pi_se"], method, n)


def with_intervals(df: DataFrame, mean: str = "nom_mean", se: str = "nom_se") -> DataFrame:
    m, s = F.col(mean), F.col(se)
    return df.withColumns({"lower_80": m - Z80 * s, "upper_80": m + Z80 * s, "lower_95": m - Z95 * s, "upper_95": m + Z95 * s})


def nowcast_by_category(forecasts: DataFrame, smoothed: DataFrame, later: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """period, category (the total among them, if it was forecast), nom_mean, nom_se and intervals: ratio times net flow, its variance by the delta method.

    forecasts: period, category, direction, mean_level, se_log; smoothed: period, category, pi_smoothed, pi_se; later: category, pi_smoothed, pi_se where smoothed has none;
    all with keys in front, if there are any. A category without a forecast of both directions, or without a ratio, has a null mean. A variance of which a part is unknown counts as 0 as a whole.
    Numbers that are not finite count as unknown.
    """
    keys = keys or []
    known = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))  # noqa: E731  null for NaN too, which is the largest
    sides = forecasts.select(*keys, "period", "category", "direction", known("mean_level").alias("mean_level"), known("se_log").alias("se_log"))
    wide = sides.groupBy(*keys, "period", "category").pivot("direction", ["arrival", "departure"]).agg(F.first("mean_level").alias("level"), F.first("se_log").alias("se"))
    rest = later.select(*keys, "category", F.col("pi_smoothed").alias("_later"), F.col("pi_se").alias("_later_se"))
    rows = wide.join(smoothed.select(*keys, "period", "category", "pi_smoothed", "pi_se"), [*keys, "period", "category"], "left").join(rest, [*keys, "category"], "left")
    rows = rows.withColumns({"_pi": F.coalesce("pi_smoothed", "_later"), "_se": F.coalesce("pi_se", "_later_se"), "_net": F.col("arrival_level") - F.col("departure_level")})
    square = lambda x: x * x
    spread = square(F.col("arrival_level") * F.col("arrival_se")) + square(F.col("departure_level") * F.col("departure_se"))
    rows = rows.withColumn("_variance", square(F.col("_pi")) * spread + square(known("_se") * F.col("_net")))
    return with_intervals(rows.select(*keys, "period", "category", (F.col("_pi") * F.col("_net")).alias("nom_mean"), F.sqrt(F.coalesce(known("_variance"), F.lit(0.0))).alias("nom_se")))


def headline(by_category: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """period, nom_mean, nom_se and intervals: the rows of the total where there are any with a mean (by keys), else the sums of the categories with independent errors.

    Categories without a mean are left out of the sum; without any it is 0.
    """
    keys = keys or []
    total = F.col("category") == "total"
    rows = by_category.groupBy(*keys, "period").agg(
        F.max(F.when(total, F.col("nom_mean"))).alias("_m"), F.max(F.when(total & F.col("nom_mean").isNotNull(), F.col("nom_se"))).alias("_s"), F.count(F.when(~total, 1)).alias("_n"),
        F.coalesce(F.sum(F.when(~total, F.col("nom_mean"))), F.lit(0.0)).alias("_sum"), F.sqrt(F.coalesce(F.sum(F.when(~total, F.col("nom_se") * F.col("nom_se"))), F.lit(0.0))).alias("_root"),
    )
    has = rows.groupBy(*keys).agg(F.count("_m").alias("_totals"))
    rows = rows.join(has, keys) if keys else rows.crossJoin(F.broadcast(has))
    by_total = F.col("_totals") > 0
    rows = rows.where((by_total & F.col("_m").isNotNull()) | (~by_total & (F.col("_n") > 0)))
    return with_intervals(rows.select(*keys, "period", F.when(by_total, F.col("_m")).otherwise(F.col("_sum")).alias("nom_mean"), F.when(by_total, F.col("_s")).otherwise(F.col("_root")).alias("nom_se")))


def lognormal_headline(forecasts: DataFrame, level: str = "nom_level", se_log: str = "nom_se_log") -> DataFrame:
    """period, nom_mean, nom_se and intervals from a log-normal forecast; lower ends stop at 0."""
    return lognormal_headline_rows(forecasts, [], level, se_log)


def lognormal_headline_rows(forecasts: DataFrame, keys: list[str], level: str = "mean_level", se_log: str = "se_log") -> DataFrame:
    """lognormal_headline by keys and period."""
    mean, s = F.col(level), F.col(se_log)
    rows = with_intervals(forecasts.select(*keys, "period", mean.alias("nom_mean"), (mean * F.sqrt(F.exp(s * s) - 1)).alias("nom_se")))
    return rows.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in ("lower_80", "lower_95")})


def combined_forecasts(single: DataFrame, joint: DataFrame) -> DataFrame:
    """single, with joint's rows in place of its own for the total's arrivals."""
    kept = single.where(~((F.col("category") == "total") & (F.col("direction") == "arrival")))
    return kept.unionByName(joint, allowMissingColumns=True).select(*single.columns)


def adjusted(forecasts: DataFrame, table: DataFrame) -> DataFrame:
    """forecasts recentred by a factor and with intervals widened on the log scale, by horizon; beyond the table's last horizon its last row holds.

    Horizons before the table's first, and rows with an interval end or mean that isn't positive, stay as they are (adjusted is false).
    """
    ends = F.broadcast(table.agg(F.min("horizon").alias("_first"), F.max("horizon").alias("_last")))
    rows = forecasts.crossJoin(ends).withColumn("_h", F.least("horizon", "_last"))
    t = F.broadcast(table.select(F.col("horizon").alias("_h"), F.col("factor").alias("_f"), F.col("k80").alias("_k80"), F.col("k95").alias("_k95")))
    rows = rows.join(t, "_h", "left")
    parts = ["nom_mean", "lower_80", "upper_80", "lower_95", "upper_95"]
    positive = F.coalesce(F.least(*parts) > 0, F.lit(False))
    for c in parts:
        positive = positive & F.col(c).isNotNull()
    ok = positive & F.coalesce((F.col("horizon") >= F.col("_first")) & F.col("_f").isNotNull(), F.lit(False))
    centre = F.col("nom_mean") * F.col("_f")
    new = {"nom_mean": centre, "nom_se": F.col("nom_se") * F.col("_f") * F.col("_k80")}
    for c in parts[1:]:
        k = F.col("_k80") if c.endswith("80") else F.col("_k95")
        new[c] = centre * F.exp(k * F.ln(F.col(c) / F.col("nom_mean")))
    return rows.select(*(F.when(ok, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in forecasts.columns), ok.alias("adjusted"))


def calibration(runs: DataFrame, z80: float = Z80, z95: float = Z95) -> DataFrame:
    """horizon, n, factor, k80, k95: the ratio of truth to forecast sums, and how much wider intervals must be on the log scale.

    runs: horizon, nom_mean, upper_80, upper_95, nom_truth; rows without positive figures are left out.
    """
    ok = runs.where((F.col("nom_mean") > 0) & (F.col("nom_truth") > 0) & (F.col("upper_80") > F.col("nom_mean")) & (F.col("upper_95") > F.col("nom_mean")))
    w = Window.partitionBy("horizon")
    rows = ok.withColumn("factor", F.sum("nom_truth").over(w) / F.sum("nom_mean").over(w))
    off = F.abs(F.ln(F.col("nom_truth") / (F.col("nom_mean") * F.col("factor"))))
    rows = rows.withColumns({"r80": off / F.ln(F.col("upper_80") / F.col("nom_mean")), "r95": off / F.ln(F.col("upper_95") / F.col("nom_mean"))})
    return rows.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.first("factor").alias("factor"), F.percentile("r80", F.lit(0.80)).alias("k80"), F.percentile("r95", F.lit(0.95)).alias("k95"))


def gamma_weights(alpha: float, beta: float, last: int) -> list[float]:
    """Weights of lags 0 to last: the gamma distribution's mass around each, normalised."""

    def below(x: float) -> float:
        """The regularised lower incomplete gamma function of alpha at beta * x, by its series."""
        y = beta * x
        if y <= 0:
            return 0.0
        term = total = 1 / alpha
        k = alpha
        while term > total * 1e-17:
            k += 1
            term *= y / k
            total += term
        return total * math.exp(alpha * math.log(y) - y - math.lgamma(alpha))

    mass = [below(k + 0.5) - below(max(k - 0.5, 0)) for k in range(last + 1)]
    return [m / sum(mass) for m in mass]


def distributed_lag(series: DataFrame, keys: list[str], value: str, weights: list[float], period: str = "period") -> DataFrame:
    """series with lagged: the weighted sum of each key's value and those before it, weights[k] for k rows before; null until all of them are there."""
    w = Window.partitionBy(*keys).orderBy(period)
    total = F.lit(weights[0]) * F.col(value)
    for k, x in enumerate(weights[1:], 1):
        total = total + F.lit(x) * F.lag(value, k).over(w)
    return series.withColumn("lagged", total)
