"""Queries on forecasts, nowcasts and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel, quantiles, ratios, scoring
from ..operators.ratios import Z80, Z95
from ..operators.staging import staged
from .frames import PANEL_SQL, RATIO_SQL, SCALED, WIDE, _panel
from .registry import registry, rounded
from .sources import FLOW_SQL, flow, read

QUERIES, ORACLES, query = registry()
ENDS = ("lower_80", "upper_80", "lower_95", "upper_95")
BAND = f"m - {Z80!r}::DOUBLE * s AS lower_80, m + {Z80!r}::DOUBLE * s AS upper_80, m - {Z95!r}::DOUBLE * s AS lower_95, m + {Z95!r}::DOUBLE * s AS upper_95"
OUT = "round(nom_mean, 4) AS nom_mean, round(nom_se, 4) AS nom_se, " + ", ".join(f"round({c}, 4) AS {c}" for c in ENDS)

#: Forecasts made of what is there: the level of each cell, with an error that grows with its horizon.
FORECAST_SQL = f"""{RATIO_SQL}, fc AS (SELECT quarter AS period, category, direction, value AS mean_level, 0.05::DOUBLE + 0.01::DOUBLE * month(quarter) AS se_log FROM scaled WHERE value IS NOT NULL),
fw AS (SELECT period, category, max(mean_level) FILTER (direction = 'arrival') AS la, max(mean_level) FILTER (direction = 'departure') AS ld, max(se_log) FILTER (direction = 'arrival') AS sa, max(se_log) FILTER (direction = 'departure') AS sd FROM fc GROUP BY 1, 2),
sm AS (SELECT period, category, pi_hat, 0.02::DOUBLE + 0.001::DOUBLE * month(period) AS se FROM ratio),
later AS (SELECT category, median(pi_hat) AS p, median(se) AS q FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY period DESC) AS r FROM sm) WHERE r <= 8 GROUP BY 1),
nc AS (SELECT period, category, coalesce(pi_hat, p) AS pi, coalesce(se, q) AS se, la - ld AS net, (la * sa) ^ 2 + (ld * sd) ^ 2 AS v FROM fw LEFT JOIN sm USING (period, category) LEFT JOIN later USING (category)),
ns AS (SELECT period, category, pi * net AS m, coalesce(sqrt(pi ^ 2 * v + (se * net) ^ 2), 0) AS s FROM nc),
nowcast AS (SELECT period, category, m AS nom_mean, s AS nom_se, {BAND} FROM ns)"""


def _forecasts(spark, sf_dir):
    q = panel.monthly_to_quarterly(flow(spark, sf_dir)).where("value is not null")
    return q.select(F.col("quarter").alias("period"), "category", "direction", F.col("value").alias("mean_level"), (F.lit(0.05) + F.lit(0.01) * F.month("quarter")).alias("se_log"))


def _nowcast(spark, sf_dir):
    pi = staged(ratios.empirical_ratio(_panel(spark, sf_dir), ceiling=12000.0).select("period", "category", F.col("pi_hat").alias("pi_smoothed"), (F.lit(0.02) + F.lit(0.001) * F.month("period")).alias("pi_se")), "ratio")
    return ratios.nowcast_by_category(_forecasts(spark, sf_dir), pi, ratios.projected(pi, ["category"]))


@query(f"{FORECAST_SQL} SELECT period, category, {OUT} FROM nowcast")
def nowcast_category(spark, sf_dir):
    return rounded(_nowcast(spark, sf_dir), "nom_mean", "nom_se", *ENDS, places=4)


HEADLINE_SQL = f"{FORECAST_SQL}, hs AS (SELECT period, coalesce(sum(nom_mean), 0) AS m, sqrt(sum(nom_se ^ 2)) AS s FROM nowcast GROUP BY 1), head AS (SELECT period, m AS nom_mean, s AS nom_se, {BAND} FROM hs)"


@query(f"{HEADLINE_SQL} SELECT period, {OUT} FROM head")
def nowcast_headline(spark, sf_dir):
    return rounded(ratios.headline(_nowcast(spark, sf_dir)), "nom_mean", "nom_se", *ENDS, places=4)


#: The same with a total: its ratio stands for all, its flows are those of the categories, and one category has arrivals only.
TOTAL_SQL = f"""{RATIO_SQL}, t AS (SELECT period, sum(oad_lt_arrivals) * 0.8::DOUBLE AS n, sum(nom_final) AS f FROM panel WHERE category <> 'total' GROUP BY 1),
sm AS (SELECT period, least(greatest(f / n, 0), 12000) AS pi_hat, 0.02::DOUBLE AS se FROM t WHERE period <= (SELECT max(period) - INTERVAL 18 MONTH FROM panel) AND n > 0 AND f IS NOT NULL),
later AS (SELECT median(pi_hat) AS p, median(se) AS q FROM (SELECT *, row_number() OVER (ORDER BY period DESC) AS r FROM sm) WHERE r <= 8),
fc AS (SELECT quarter AS period, category, direction, value AS mean_level, 0.05::DOUBLE AS se_log FROM scaled WHERE value IS NOT NULL AND NOT (category = '5-LOW' AND direction = 'departure')),
ft AS (SELECT * FROM fc UNION ALL SELECT period, 'total', direction, sum(mean_level), 0.03::DOUBLE FROM fc GROUP BY 1, 3),
fw AS (SELECT period, category, max(mean_level) FILTER (direction = 'arrival') AS la, max(mean_level) FILTER (direction = 'departure') AS ld, max(se_log) FILTER (direction = 'arrival') AS sa, max(se_log) FILTER (direction = 'departure') AS sd FROM ft GROUP BY 1, 2),
nc AS (SELECT period, category, coalesce(pi_hat, p) AS pi, coalesce(se, q) AS se, la - ld AS net, (la * sa) ^ 2 + (ld * sd) ^ 2 AS v FROM fw LEFT JOIN sm USING (period) CROSS JOIN later),
ns AS (SELECT period, category, pi * net AS m, coalesce(sqrt(pi ^ 2 * v + (se * net) ^ 2), 0) AS s FROM nc),
nowcast AS (SELECT period, category, m AS nom_mean, s AS nom_se, {BAND} FROM ns)"""


def _nowcast_by_total(spark, sf_dir):
    p = _panel(spark, sf_dir)
    arrivals = F.sum("oad_lt_arrivals")
    total = p.where("category <> 'total'").groupBy("period").agg(arrivals.alias("oad_lt_arrivals"), (arrivals * 0.8).alias("oad_lt_net"), F.sum("nom_final").alias("nom_final")).withColumn("category", F.lit("total"))
    bare = p.where("category <> 'total'").withColumn("nom_final", F.lit(None).cast("double"))
    ratio = ratios.empirical_ratio(bare.unionByName(total, allowMissingColumns=True), ceiling=12000.0)
    pi = staged(ratio.select("period", "category", F.col("pi_hat").alias("pi_smoothed"), F.lit(0.02).alias("pi_se")), "ratio")
    each = _forecasts(spark, sf_dir).where("not (category = '5-LOW' and direction = 'departure')").withColumn("se_log", F.lit(0.05))
    joint = each.groupBy("period", "direction").agg(F.sum("mean_level").alias("mean_level")).withColumns({"category": F.lit("total"), "se_log": F.lit(0.03)})
    return ratios.nowcast_by_category(each.unionByName(joint), pi, ratios.projected(pi, ["category"]))


@query(f"{TOTAL_SQL} SELECT period, category, {OUT} FROM nowcast")
def nowcast_category_total(spark, sf_dir):
    return rounded(_nowcast_by_total(spark, sf_dir), "nom_mean", "nom_se", *ENDS, places=4)


@query(f"{TOTAL_SQL} SELECT period, {OUT} FROM nowcast WHERE category = 'total' AND nom_mean IS NOT NULL")
def nowcast_headline_total(spark, sf_dir):
    """The total's own rows make the headline, and only they."""
    return rounded(ratios.headline(_nowcast_by_total(spark, sf_dir)), "nom_mean", "nom_se", *ENDS, places=4)


@query(f"""{SCALED}, lg AS (SELECT quarter AS period, sum(value) AS m, sum(value) * sqrt(exp(0.09::DOUBLE) - 1) AS s FROM scaled WHERE direction = 'arrival' GROUP BY 1),
head AS (SELECT period, m AS nom_mean, s AS nom_se, greatest(m - {Z80!r} * s, 0) AS lower_80, m + {Z80!r} * s AS upper_80, greatest(m - {Z95!r} * s, 0) AS lower_95, m + {Z95!r} * s AS upper_95 FROM lg) SELECT period, {OUT} FROM head""")
def headline_lognormal(spark, sf_dir):
    q = panel.monthly_to_quarterly(flow(spark, sf_dir)).where("direction = 'arrival'").groupBy(F.col("quarter").alias("period")).agg(F.sum("value").alias("nom_level"))
    return rounded(ratios.lognormal_headline(q.withColumn("nom_se_log", F.lit(0.3))), "nom_mean", "nom_se", *ENDS, places=4)


@query(f"""{SCALED}, a AS (SELECT quarter AS period, CASE WHEN category = '5-LOW' THEN 'total' ELSE category END AS category, direction, value AS mean_level FROM scaled)
SELECT period, category, direction, round(mean_level, 6) AS mean_level FROM a WHERE NOT (category = 'total' AND direction = 'arrival')
UNION ALL SELECT period, category, direction, round(mean_level * 1.5, 6) FROM a WHERE category = 'total' AND direction = 'arrival' AND year(period) >= 1998""")
def combine_forecasts(spark, sf_dir):
    single = _forecasts(spark, sf_dir).select("period", F.when(F.col("category") == "5-LOW", "total").otherwise(F.col("category")).alias("category"), "direction", "mean_level")
    joint = single.where("category = 'total' and direction = 'arrival' and year(period) >= 1998").withColumn("mean_level", F.col("mean_level") * 1.5)
    return rounded(ratios.combined_forecasts(single, joint), "mean_level")


ADJ_SQL = f"""{HEADLINE_SQL}, hz AS (SELECT *, ((year(period) - 1999) * 4 + quarter(period) - 1)::INT AS horizon FROM head WHERE year(period) BETWEEN 1998 AND 2000),
adj(h, f, k80, k95) AS (VALUES (0, 1.10::DOUBLE, 1.5::DOUBLE, 1.2::DOUBLE), (1, 0.95::DOUBLE, 2.0::DOUBLE, 1.8::DOUBLE)),
aj AS (SELECT hz.*, f, k80, k95, horizon >= 0 AND nom_mean > 0 AND lower_80 > 0 AND lower_95 > 0 AND upper_80 > 0 AND upper_95 > 0 AS ok FROM hz LEFT JOIN adj ON h = least(horizon, 1))"""


@query(f"""{ADJ_SQL} SELECT period, horizon, round(CASE WHEN ok THEN nom_mean * f ELSE nom_mean END, 4) AS nom_mean, round(CASE WHEN ok THEN nom_se * f * k80 ELSE nom_se END, 4) AS nom_se,
{', '.join(f"round(CASE WHEN ok THEN nom_mean * f * exp(k{c[-2:]} * ln({c} / nom_mean)) ELSE {c} END, 4) AS {c}" for c in ENDS)}, coalesce(ok, false) AS adjusted FROM aj""")
def adjust_apply(spark, sf_dir):
    head = ratios.headline(_nowcast(spark, sf_dir)).where("year(period) between 1998 and 2000").withColumn("horizon", F.expr("int((year(period) - 1999) * 4 + quarter(period) - 1)"))
    table = spark.createDataFrame([(0, 1.10, 1.5, 1.2), (1, 0.95, 2.0, 1.8)], "horizon int, factor double, k80 double, k95 double")
    return rounded(ratios.adjusted(head.select("period", "horizon", "nom_mean", "nom_se", *ENDS), table), "nom_mean", "nom_se", *ENDS, places=4)


#: A backtest: each cell's figure foretold by the one a year before, with bands around it.
RUNS_SQL = f"""{SCALED}, runs AS (SELECT category, direction, quarter AS period, month(quarter) AS horizon, value AS nom_truth, lag(value, 4) OVER w AS nom_mean, 0.1 * lag(value, 4) OVER w AS nom_se FROM scaled WINDOW w AS (PARTITION BY category, direction ORDER BY quarter)),
banded AS (SELECT *, nom_mean - {Z80!r} * nom_se AS lower_80, nom_mean + {Z80!r} * nom_se AS upper_80, nom_mean - {Z95!r} * nom_se AS lower_95, nom_mean + {Z95!r} * nom_se AS upper_95 FROM runs WHERE nom_mean IS NOT NULL)"""
DENSITY = "-0.5 * ln(2 * pi()) - ln(nom_se) - 0.5 * ((nom_truth - nom_mean) / nom_se) ^ 2"
METRICS = ("rmse", "mae", "bias", "hit_rate", "log_score", "cov80", "cov95")
SCORE_SQL = f"""{RUNS_SQL}, stepped AS (SELECT *, (sign(nom_mean - lag(nom_mean) OVER w) = sign(nom_truth - lag(nom_truth) OVER w))::INT::DOUBLE AS hit FROM banded WINDOW w AS (PARTITION BY category, direction ORDER BY period)),
scores AS (SELECT category, direction, count(*)::BIGINT AS n, sqrt(avg((nom_mean - nom_truth) ^ 2)) AS rmse, avg(abs(nom_mean - nom_truth)) AS mae, avg(nom_mean - nom_truth) AS bias, avg(hit) AS hit_rate, avg(CASE WHEN nom_se > 0 THEN {DENSITY} END) AS log_score,
avg((nom_truth BETWEEN lower_80 AND upper_80)::INT::DOUBLE) AS cov80, avg((nom_truth BETWEEN lower_95 AND upper_95)::INT::DOUBLE) AS cov95 FROM stepped GROUP BY 1, 2)"""


def _runs(spark, sf_dir):
    q = panel.monthly_to_quarterly(flow(spark, sf_dir)).select("category", "direction", F.col("quarter").alias("period"), F.month("quarter").alias("horizon"), F.col("value").alias("nom_truth"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("category", "direction").orderBy("period")
    rows = q.withColumn("nom_mean", F.lag("nom_truth", 4).over(w)).where("nom_mean is not null").withColumn("nom_se", F.lit(0.1) * F.col("nom_mean"))
    return ratios.with_intervals(rows)


@query(f"{SCORE_SQL} SELECT category, direction, n, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)} FROM scores")
def score_backtest(spark, sf_dir):
    return rounded(scoring.score(_runs(spark, sf_dir), ["category", "direction"]), *METRICS)


@query(f"""{SCORE_SQL}, long AS (UNPIVOT (SELECT direction, cov80, cov95, rmse FROM scores) ON cov80, cov95, rmse INTO NAME metric VALUE v)
SELECT direction, metric, round(avg(v), 6) AS value FROM long GROUP BY 1, 2""")
def score_rollup(spark, sf_dir):
    scores = scoring.score(_runs(spark, sf_dir), ["category", "direction"])
    long = scores.select("direction", "cov80", "cov95", "rmse").unpivot(["direction"], ["cov80", "cov95", "rmse"], "metric", "v")
    return long.groupBy("direction", "metric").agg(F.round(F.avg("v"), 6).alias("value"))


@query(f"{RUNS_SQL} SELECT horizon::INT AS horizon, round(avg((nom_truth BETWEEN lower_80 AND upper_80)::INT::DOUBLE), 6) AS cov80 FROM banded GROUP BY 1")
def coverage(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("horizon").agg(F.round(scoring.coverage("lower_80", "upper_80", "nom_truth"), 6).alias("cov80"))


@query(f"{RUNS_SQL} SELECT horizon::INT AS horizon, round(avg(CASE WHEN nom_se > 0 THEN {DENSITY} END), 6) AS log_score FROM banded GROUP BY 1")
def log_score(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("horizon").agg(F.round(scoring.log_score("nom_mean", "nom_se", "nom_truth"), 6).alias("log_score"))


@query(f"{SCORE_SQL} SELECT category, direction, round(hit_rate, 6) AS hit_rate FROM scores")
def hit_rate(spark, sf_dir):
    return scoring.score(_runs(spark, sf_dir), ["category", "direction"]).select("category", "direction", F.round("hit_rate", 6).alias("hit_rate"))


@query(f"""{RUNS_SQL}, ok AS (SELECT * FROM banded WHERE nom_mean > 0 AND nom_truth > 0 AND upper_80 > nom_mean AND upper_95 > nom_mean),
f AS (SELECT *, sum(nom_truth) OVER (PARTITION BY horizon) / sum(nom_mean) OVER (PARTITION BY horizon) AS factor FROM ok),
r AS (SELECT *, abs(ln(nom_truth / (nom_mean * factor))) AS d FROM f)
SELECT horizon::INT AS horizon, count(*)::BIGINT AS n, round(any_value(factor), 6) AS factor, round(quantile_cont(d / ln(upper_80 / nom_mean), 0.8), 6) AS k80, round(quantile_cont(d / ln(upper_95 / nom_mean), 0.95), 6) AS k95 FROM r GROUP BY 1""")
def adjust_calibrate(spark, sf_dir):
    return rounded(ratios.calibration(_runs(spark, sf_dir)), "factor", "k80", "k95")


@query("""SELECT l_returnflag, share::DOUBLE AS share, count(*)::BIGINT AS n, round(CASE share WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) WHEN 0.8 THEN quantile_cont(l_extendedprice, 0.8) ELSE quantile_cont(l_extendedprice, 0.95) END, 6) AS quantile
FROM lineitem, (VALUES (0.5), (0.8), (0.95)) t(share) GROUP BY l_returnflag, share""")
def exact_quantiles(spark, sf_dir):
    """Median and two upper quantiles of a few large groups, without gathering any."""
    prices = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return rounded(quantiles.quantiles(prices, ["l_returnflag"], "l_extendedprice", [0.5, 0.8, 0.95], sorted_rows=5000), "quantile")


@query(f"""{SCALED}, {WIDE} SELECT category, count(*) FILTER (a IS NOT NULL AND d IS NOT NULL)::BIGINT AS n, round(CASE WHEN count(*) FILTER (a IS NOT NULL AND d IS NOT NULL) >= 8 THEN avg(d - a) ELSE 0 END, 8) AS shift
FROM (SELECT category, CASE WHEN oad_lt_arrivals > 0 THEN ln(oad_lt_arrivals) END AS a, CASE WHEN oad_lt_departures > 0 THEN ln(oad_lt_departures) END AS d FROM wide) GROUP BY 1""")
def offset_calibrate(spark, sf_dir):
    from ..functions.nulls import positive_log

    wide = panel.by_direction(panel.monthly_to_quarterly(flow(spark, sf_dir))).withColumns({"a": positive_log("oad_lt_arrivals"), "d": positive_log("oad_lt_departures")})
    return rounded(scoring.offset(wide, ["category"], "d", "a"), "shift", places=8)


@query("""WITH k AS (SELECT unnest(range(7))::INT AS lag), m AS (SELECT lag, greatest(lag - 0.5, 0)::DOUBLE AS a, (lag + 0.5)::DOUBLE AS b FROM k), w AS (SELECT lag, (1 - exp(-b) * (1 + b)) - (1 - exp(-a) * (1 + a)) AS w FROM m)
SELECT lag, round(w / sum(w) OVER (), 10) AS weight FROM w""")
def gamma_weights(spark, sf_dir):
    """Shape 2, rate 1: the distribution function has a closed form."""
    return spark.createDataFrame([(k, round(w, 10)) for k, w in enumerate(ratios.gamma_weights(2.0, 1.0, 6))], "lag int, weight double")


@query(f"""WITH {FLOW_SQL}, k AS (SELECT unnest(range(5))::INT AS lag), m AS (SELECT lag, greatest(lag - 0.5, 0)::DOUBLE AS a, (lag + 0.5)::DOUBLE AS b FROM k), w AS (SELECT lag, (1 - exp(-b) * (1 + b)) - (1 - exp(-a) * (1 + a)) AS w FROM m),
v AS (SELECT lag, w / sum(w) OVER () AS w FROM w), r AS (SELECT category, period, value, row_number() OVER (PARTITION BY category ORDER BY period) AS n FROM flow WHERE direction = 'arrival')
SELECT r.category, r.period, round(CASE WHEN count(b.value) = 5 THEN sum(v.w * b.value) END, 6) AS lagged FROM r CROSS JOIN v LEFT JOIN (SELECT category, n, value FROM r) AS b ON b.category = r.category AND b.n = r.n - v.lag GROUP BY r.category, r.period""")
def distributed_lag(spark, sf_dir):
    """Arrivals spread over later months by the weights of the lag."""
    arrivals = flow(spark, sf_dir).where("direction = 'arrival'")
    out = ratios.distributed_lag(arrivals, ["category"], "value", ratios.gamma_weights(2.0, 1.0, 4))
    return rounded(out.select("category", "period", "lagged"), "lagged")



@query(f"""WITH RECURSIVE {FLOW_SQL}, s AS (SELECT category, value AS y, row_number() OVER (PARTITION BY category ORDER BY period) AS t FROM flow WHERE direction = 'arrival'),
kf AS (SELECT category, t, y AS level, 2.0::DOUBLE AS p FROM s WHERE t = 1
UNION ALL SELECT s.category, s.t, kf.level + (kf.p + 0.5) / (kf.p + 0.5 + 2.0) * (s.y - kf.level), (kf.p + 0.5) * (1 - (kf.p + 0.5) / (kf.p + 0.5 + 2.0)) FROM kf JOIN s ON s.category = kf.category AND s.t = kf.t + 1)
SELECT category, count(*)::BIGINT AS n, round(arg_max(level, t), 6) AS level, round(arg_max(p, t), 6) AS variance FROM kf GROUP BY 1""")
def kalman_local_level(spark, sf_dir):
    """A local-level filter with known variances (0.5 and 2), as a fold over each ordered series."""
    series = flow(spark, sf_dir).where("direction = 'arrival'").groupBy("category").agg(F.sort_array(F.collect_list(F.struct("period", "value"))).alias("ys"))
    first = F.struct(F.col("ys")[0]["value"].alias("level"), F.lit(2.0).alias("p"))

    def step(s, x):
        p = s["p"] + 0.5
        gain = p / (p + 2.0)
        return F.struct((s["level"] + gain * (x["value"] - s["level"])).alias("level"), (p * (1 - gain)).alias("p"))

    end = F.aggregate(F.slice("ys", F.lit(2), F.size("ys") - 1), first, step)
    return series.select("category", F.size("ys").cast("long").alias("n"), F.round(end["level"], 6).alias("level"), F.round(end["p"], 6).alias("variance"))


@query("""SELECT series_id, round(coalesce(sum(value), 0), 4) AS nom_truth FROM (SELECT event_type AS series_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1 GROUP BY 1""")
def latest_truth(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "user_id", "ts", "value")
    return rounded(scoring.latest_truth(rows, ["series_id", "user_id"], ["series_id"], "ts"), "nom_truth", places=4)


@query(f"{PANEL_SQL} SELECT period, category, round(nom_preliminary, 6) AS nom_mean FROM panel WHERE nom_preliminary IS NOT NULL")
def preliminary_forecast(spark, sf_dir):
    return rounded(scoring.preliminary(_panel(spark, sf_dir)), "nom_mean")


@query("""WITH t AS (SELECT event_type AS series_id, sum(value) AS nom_truth FROM events GROUP BY 1), o(asof_date) AS (VALUES (DATE '2023-12-31'), (DATE '2024-01-15')),
f AS (SELECT asof_date, event_type AS series_id, sum(value) AS nom_prelim FROM events JOIN o ON ts::DATE <= asof_date WHERE event_type <> 'click' GROUP BY 1, 2)
SELECT asof_date, series_id, round(nom_truth, 4) AS nom_truth, round(CASE WHEN asof_date IN (SELECT asof_date FROM f) THEN nom_prelim ELSE nom_truth END, 4) AS nom_prelim, asof_date NOT IN (SELECT asof_date FROM f) AS prelim_is_truth
FROM t CROSS JOIN o LEFT JOIN f USING (asof_date, series_id)""")
def truth_and_preliminary(spark, sf_dir):
    """Figures known at two origins, one before there were any."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "value")
    origins = spark.createDataFrame([("2023-12-31",), ("2024-01-15",)], "d string").select(F.col("d").cast("date").alias("asof_date"))
    first = e.where("series_id <> 'click'").join(F.broadcast(origins), F.col("ts").cast("date") <= F.col("asof_date")).groupBy("asof_date", "series_id").agg(F.sum("value").alias("nom_prelim"))
    truth = e.groupBy("series_id").agg(F.sum("value").alias("nom_truth"))
    return rounded(scoring.with_preliminary(truth, first, origins, ["series_id"]), "nom_truth", "nom_prelim", places=4)
