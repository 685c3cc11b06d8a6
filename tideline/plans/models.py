"""Queries that fit models: no SQL says the same, so tests hold them against known results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import quarters
from ..config import load
from ..operators import fits, longseries, nowcast, panel, replay
from ..operators.staging import fresh_folder, staged
from ..operators.store import VintageStore
from ..operators.vintages import reenriched_figures
from ..streaming.capture import windowed_counts
from .registry import registry, rounded
from .sources import FLOW_SQL, PUBLISHED_SQL, flow, published, read

QUERIES, ORACLES, query = registry()


def _total_panel(spark, sf_dir):
    """A panel whose total has arrivals and figures, and whose categories have grants."""
    q = staged(panel.by_direction(panel.monthly_to_quarterly(flow(spark, sf_dir))), "quarterly")
    total = q.groupBy("period").agg(F.sum("oad_lt_arrivals").alias("oad_lt_arrivals"), F.sum("oad_lt_net").alias("oad_lt_net"), (F.sum("oad_lt_departures") * 0.6).alias("nom_final")).withColumn("category", F.lit("total"))
    each = q.select("period", "category", "oad_lt_arrivals", "oad_lt_net", F.col("oad_lt_departures").alias("visa_grants"))
    return staged(each.unionByName(total, allowMissingColumns=True), "panel")


@query()
def ssm_fit(spark, sf_dir):
    q = panel.monthly_to_quarterly(flow(spark, sf_dir))
    return fits.structural_forecasts(q.withColumn("period", F.col("quarter")), ["category", "direction"])


@query()
def ssm_multi(spark, sf_dir):
    return fits.joint_forecasts(_total_panel(spark, sf_dir))


@query()
def grid_search(spark, sf_dir):
    return fits.best_lag(fits.lag_grid(_total_panel(spark, sf_dir)))


@query()
def bridge_regression(spark, sf_dir):
    return fits.bridge_forecasts(_total_panel(spark, sf_dir))


@query()
def loess_smooth(spark, sf_dir):
    return fits.smoothed_ratios(_ratio(spark, sf_dir), "loess", breaks=["1998-01-01"])


@query()
def hp_filter(spark, sf_dir):
    return fits.smoothed_ratios(_ratio(spark, sf_dir), "hp")


@query()
def local_linear_smooth(spark, sf_dir):
    return fits.smoothed_ratios(_ratio(spark, sf_dir), "locallinear")


def _ratio(spark, sf_dir):
    q = panel.by_direction(panel.monthly_to_quarterly(flow(spark, sf_dir)))
    return q.select("category", "period", (F.col("oad_lt_departures") / F.col("oad_lt_arrivals")).alias("pi_hat"))


@query()
def bayes_kalman(spark, sf_dir):
    return fits.bayes_headline(fits.bayes_draws(_total_panel(spark, sf_dir)))


@query()
def bayes_kalman_seasonal(spark, sf_dir):
    return fits.bayes_headline(fits.bayes_draws(_total_panel(spark, sf_dir), seasonal_=True))


@query()
def bayes_single_lead(spark, sf_dir):
    return fits.bayes_headline(fits.bayes_draws(_total_panel(spark, sf_dir), lead=1))


@query()
def bayes_learned_lag(spark, sf_dir):
    return fits.bayes_headline(fits.bayes_draws(_total_panel(spark, sf_dir), learned=True))


#: Regimes of the example's years.
PERIODS = [("early", "1992-01-01", "1995-12-31"), ("late", "1996-01-01", "2099-12-31")]


@query("""WITH RECURSIVE s AS (SELECT event_type AS series_id, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) AS t FROM events WHERE value IS NOT NULL),
kf AS (SELECT series_id, t, y AS level, 2.0::DOUBLE AS p FROM s WHERE t = 1
UNION ALL SELECT s.series_id, s.t, kf.level + (kf.p + 0.5) / (kf.p + 0.5 + 2.0) * (s.y - kf.level), (kf.p + 0.5) * (1 - (kf.p + 0.5) / (kf.p + 0.5 + 2.0)) FROM kf JOIN s ON s.series_id = kf.series_id AND s.t = kf.t + 1)
SELECT series_id, count(*)::BIGINT AS n, round(avg(level), 6) AS mean_level, round(max(level), 6) AS highest, round(min(variance_), 6) AS variance FROM (SELECT *, p AS variance_ FROM kf) GROUP BY 1""")
def kalman_long_series(spark, sf_dir):
    """Every event of a type as a step of one series: blocks of time are filtered side by side."""
    steps = read(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("series_id"), F.col("ts").alias("period"), "value")
    levels = longseries.filtered_levels(steps, ["series_id"], "value", 0.5, 2.0, block_steps=1000)
    return levels.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("level"), 6).alias("mean_level"), F.round(F.max("level"), 6).alias("highest"), F.round(F.min("variance"), 6).alias("variance"))


@query()
def configured_nowcast(spark, sf_dir):
    """The headline from the store as of a configured day: flows recorded, figures and grants as they were out by then."""
    store, today = _recorded(spark, sf_dir, {"oad": ("1992-01-01", 2)})
    ends = today["oad"].agg(F.add_months(F.max("period"), -6)).first()[0]
    settings = load(categories=tuple(name for name, _ in CATEGORIES.values()), ratio_ceiling=12000.0, regime_breaks=("1996-01-01",), smoother="hp")
    return nowcast.run(store, settings, ends, today).headline


#: The example's categories, and the subclass that stands for each in the ids of grants.
CATEGORIES = {"1-URGENT": ("student", "500"), "2-HIGH": ("skilled", "189"), "3-MEDIUM": ("working_holiday", "417"), "4-NOT SPECIFIED": ("family", "309"), "5-LOW": ("other", "")}


def _named(df):
    return df.withColumn("category", F.create_map(*(F.lit(x) for k, (name, _) in CATEGORIES.items() for x in (k, name)))[F.col("category")])


def _recorded(spark, sf_dir, recorded_from: dict[str, tuple[str, int]]):
    """(store, by source today's observations): flows by month, figures by quarter and grants (all departures but one category's) by month; of each source periods from a day on were recorded so many months later."""
    monthly = _named(flow(spark, sf_dir)).withColumn("period_unit", F.lit("month"))
    figures = _named(published(spark, sf_dir)).withColumns({"period_unit": F.lit("quarter"), "direction": F.lit(None).cast("string")})
    codes = F.create_map(*(F.lit(x) for name, code in CATEGORIES.values() for x in (name, code)))
    grants = monthly.where("direction = 'departure' and category <> 'other'").withColumn("category", codes[F.col("category")])
    today = {}
    for source, rows in (("oad", monthly), ("nom", figures), ("visa_grants", grants)):
        parts = [F.lit(source), "category", "direction"] if source == "oad" else [F.lit(source), "category"]
        series = F.to_json(F.struct(F.lit(source).alias("from")))
        today[source] = staged(rows.select(F.concat_ws(":", *parts).alias("series_id"), "period", "period_unit", F.col("value").cast("double").alias("value"), F.lit("persons").alias("unit"), series.alias("metadata")), source)
    store = VintageStore(spark, fresh_folder(spark, "store"))
    history = None
    for source, (first, months) in recorded_from.items():
        rows = today[source].where(F.col("period") >= F.lit(first).cast("date")).withColumns({"source": F.lit(source), "vintage_date": F.add_months("period", months)})
        history = rows if history is None else history.unionByName(rows)
    store.load_history(history)
    return store, today


def _origins(spark, sf_dir):
    """A quarterly grid over all years."""
    ends = flow(spark, sf_dir).agg(F.min("period").alias("a"), F.max("period").alias("b"))
    return staged(ends.select(F.explode(quarters(F.add_months("a", 24), F.add_months("b", 3))).alias("asof_date")), "origins")


def _backtest_panels(spark, sf_dir):
    """(panels, figures known at each origin, figures of today): what the store has of figures from the middle of 1995 on, and today's less what was not out by then of all else."""
    store, today = _recorded(spark, sf_dir, {"nom": ("1995-07-01", 9)})
    known = {source: staged(rows, f"known-{source}") for source, rows in replay.known_from_store(store, _origins(spark, sf_dir), today, replay.LAGS | {"visa_grants": 35}).items()}
    panels = staged(replay.panels_from_store(known), "panels")
    return panels, reenriched_figures(known["nom"]), reenriched_figures(today["nom"])


NAMED_SQL = ", ".join(f"('{k}', '{name}', '{code}')" for k, (name, code) in CATEGORIES.items())
#: Rows that each source shows at each origin: recorded ones from its first vintage on, today's less what was not out before.
STORE_SQL = f"""{FLOW_SQL}, {PUBLISHED_SQL}, o AS (SELECT unnest(generate_series(date_trunc('quarter', min(period) + INTERVAL 24 MONTH), date_trunc('quarter', max(period) + INTERVAL 3 MONTH), INTERVAL 3 MONTH))::DATE AS asof_date FROM flow),
nm(category, name, code) AS (VALUES {NAMED_SQL}),
t AS (SELECT 'oad' AS source, 'oad:' || name || ':' || direction AS series_id, name, period, value, (period + INTERVAL 1 MONTH)::DATE + 35 AS seen, CASE WHEN period >= DATE '1994-01-01' THEN (period + INTERVAL 2 MONTH)::DATE END AS vintage FROM flow JOIN nm USING (category)
UNION ALL SELECT 'nom', 'nom:' || name, name, period, value, (period + INTERVAL 3 MONTH)::DATE + 183, CASE WHEN period >= DATE '1995-07-01' THEN (period + INTERVAL 9 MONTH)::DATE END FROM published JOIN nm USING (category)
UNION ALL SELECT 'visa_grants', 'visa_grants:' || code, name, period, value, (period + INTERVAL 1 MONTH)::DATE + 45, NULL FROM flow JOIN nm USING (category) WHERE direction = 'departure' AND category <> '5-LOW'),
f AS (SELECT source, min(vintage) AS first FROM t GROUP BY 1),
k AS (SELECT asof_date, source, coalesce(asof_date >= first, false) AS real, series_id, name, period, value FROM o CROSS JOIN t JOIN f USING (source) WHERE CASE WHEN coalesce(asof_date >= first, false) THEN vintage <= asof_date ELSE seen <= asof_date END)"""


@query(f"WITH {STORE_SQL} SELECT asof_date, source, CASE WHEN real THEN 'real' ELSE 'pseudo' END AS vintage, count(*)::BIGINT AS n, max(period) AS latest, round(sum(value), 4) AS total FROM k GROUP BY 1, 2, 3")
def replay_known(spark, sf_dir):
    """What each of three sources shows at each origin: two of them turn from pseudo to real at days of their own, one never does."""
    store, today = _recorded(spark, sf_dir, {"oad": ("1994-01-01", 2), "nom": ("1995-07-01", 9)})
    known = replay.known_from_store(store, _origins(spark, sf_dir), today)
    each = [rows.groupBy("asof_date", F.lit(source).alias("source"), "vintage").agg(F.count(F.lit(1)).alias("n"), F.max("period").alias("latest"), F.round(F.sum("value"), 4).alias("total")) for source, rows in known.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"""WITH {STORE_SQL}, c AS (SELECT asof_date, date_trunc('quarter', period)::DATE AS period, name AS category, sum(value) AS visa_grants FROM k WHERE source = 'visa_grants' GROUP BY 1, 2, 3),
n AS (SELECT asof_date, period, name AS category, sum(value) AS nom_final, sum(CASE WHEN (asof_date - period) / 90.0 < 3 THEN value END) AS nom_preliminary FROM k WHERE source = 'nom' GROUP BY 1, 2, 3),
m AS (SELECT * FROM n UNION ALL SELECT asof_date, period, 'total', sum(nom_final), sum(nom_preliminary) FROM n GROUP BY 1, 2)
SELECT asof_date, period, category, round(visa_grants, 4) AS visa_grants, round(nom_final, 4) AS nom_final FROM c FULL JOIN m USING (asof_date, period, category)""")
def replay_panels(spark, sf_dir):
    """Grants and figures of the panel of each origin, made from what the store and today's sources show there."""
    store, today = _recorded(spark, sf_dir, {"oad": ("1994-01-01", 2), "nom": ("1995-07-01", 9)})
    panels = replay.panels_from_store(replay.known_from_store(store, _origins(spark, sf_dir), today))
    return rounded(panels.where("visa_grants is not null or nom_final is not null").select("asof_date", "period", "category", "visa_grants", "nom_final"), "visa_grants", "nom_final", places=4)


def _summed(df, keys, value, name):
    """By category, and all of them as total."""
    rows = df.select(*keys, "period", "category", F.col(value).alias(name))
    return rows.unionByName(rows.groupBy(*keys, "period").agg(F.sum(name).alias(name)).withColumn("category", F.lit("total")))


@query()
def backtest_replay(spark, sf_dir):
    """Every model stream at every origin of the quarterly grid, the Bayesian ones at the last twelve, scored by horizon, regime and category."""
    panels, known, figures = _backtest_panels(spark, sf_dir)
    runs = staged(replay.replay(panels, ceiling=12000.0), "runs")
    return replay.scored(runs, _summed(figures, [], "value", "nom_truth"), _summed(known, ["asof_date"], "value", "nom_prelim"), PERIODS)


@query("""SELECT date_trunc('day', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_events(spark, sf_dir):
    return rounded(windowed_counts(read(spark, sf_dir, "events"), "ts", "event_type"), "total", places=4)


@query("""SELECT make_date(year(o_orderdate)::INT, 1, 1) AS period, count(*)::BIGINT AS n, sum(o_totalprice > 200000)::BIGINT AS large FROM orders GROUP BY 1""")
def conditional_counts(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "year").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))


