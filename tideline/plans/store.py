"""Queries on vintages, publication lags and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import labels
from ..operators import panel, vintages
from ..operators.staging import fresh_folder
from ..operators.store import VintageStore
from .registry import registry
from .sources import FLOW_SQL, VINTAGE_SQL, flow, read
from .sources import vintages as events

KEYS = ["series_id", "period_key"]
DAYS = ["2024-01-08 00:00:00", "2024-01-15 00:00:00", "2024-01-22 00:00:00"]
QUERIES, ORACLES, query = registry()


@query(f"""WITH {VINTAGE_SQL} SELECT series_id, period_key, vintage_ts, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id, period_key ORDER BY vintage_ts DESC) AS r
FROM vintages WHERE vintage_ts <= TIMESTAMP '2024-01-15') WHERE r = 1""")
def vintage_asof(spark, sf_dir):
    return vintages.as_of(events(spark, sf_dir), DAYS[1], KEYS, "vintage_ts")


@query(f"""WITH {VINTAGE_SQL}, days(asof_date) AS (VALUES (TIMESTAMP '2024-01-08'), (TIMESTAMP '2024-01-15'), (TIMESTAMP '2024-01-22'))
SELECT asof_date, series_id, period_key, vintage_ts, value FROM (SELECT *, row_number() OVER (PARTITION BY asof_date, series_id, period_key ORDER BY vintage_ts DESC) AS r
FROM vintages JOIN days ON vintage_ts <= asof_date) WHERE r = 1""")
def vintage_asof_many(spark, sf_dir):
    days = spark.createDataFrame([(d,) for d in DAYS], "asof_date string").select(F.col("asof_date").cast("timestamp_ntz"))
    return vintages.as_of_many(events(spark, sf_dir), days, KEYS, "vintage_ts")


@query(f"""WITH {VINTAGE_SQL}, g AS (SELECT unnest(generate_series(min(vintage_ts), max(vintage_ts) + INTERVAL 10 MINUTE, INTERVAL 10 MINUTE)) AS asof_date FROM vintages),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, vintage_ts ORDER BY period_key DESC, value DESC) AS r FROM vintages) WHERE r = 1)
SELECT g.asof_date, v.series_id, v.period_key, v.vintage_ts, v.value FROM g CROSS JOIN (SELECT DISTINCT series_id FROM vintages) AS k ASOF JOIN v ON k.series_id = v.series_id AND g.asof_date >= v.vintage_ts""")
def vintage_asof_grid(spark, sf_dir):
    """The latest event of each type at thousands of times: spans and times meet by buckets."""
    e = events(spark, sf_dir)
    ends = e.agg(F.min("vintage_ts").alias("a"), F.max("vintage_ts").alias("b"))
    grid = ends.select(F.explode(F.expr("sequence(a, b + interval 10 minutes, interval 10 minutes)")).alias("asof_date"))
    return vintages.as_of_many(e, grid, ["series_id"], "vintage_ts")


DAILY_SQL = "d AS (SELECT event_type AS series_id, ts::DATE AS period, sum(value) AS value FROM events GROUP BY 1, 2)"


def _daily(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("period")).agg(F.sum("value").alias("value")).withColumn("period_unit", F.lit("day"))


@query(f"""WITH {DAILY_SQL}, w AS (SELECT 1 AS n, * FROM d WHERE series_id <= 'click' UNION ALL SELECT 2, * FROM d WHERE series_id > 'click' UNION ALL SELECT 3, series_id, period, value * 2 FROM d WHERE day(period) % 3 = 0)
SELECT 'events' AS source, series_id, period, DATE '2024-02-01' AS vintage_date, round(arg_max(value, n), 6) AS value FROM w GROUP BY series_id, period UNION ALL SELECT 'events', series_id, period, DATE '2024-02-02', round(value + 1, 6) FROM d WHERE day(period) = 5""")
def vintage_store_upsert(spark, sf_dir):
    """Two series written for one day one after the other, some of their rows again, and a second day: all rows that the store has then."""
    daily, store = _daily(spark, sf_dir), VintageStore(spark, fresh_folder(spark, "store"))
    store.write("events", daily.where("series_id <= 'click'"), "2024-02-01")
    store.write("events", daily.where("series_id > 'click'"), "2024-02-01")
    store.write("events", daily.where("day(period) % 3 = 0").withColumn("value", F.col("value") * 2), "2024-02-01")
    store.write("events", daily.where("day(period) = 5").withColumn("value", F.col("value") + 1), "2024-02-02")
    return store.read().select("source", "series_id", "period", "vintage_date", F.round("value", 6).alias("value"))


@query(f"""WITH {DAILY_SQL}, h AS (SELECT series_id, period, period + k AS vintage_date, value + k AS value FROM d, (VALUES (1), (7), (20)) t(k))
SELECT series_id, period, vintage_date, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY series_id, period ORDER BY vintage_date DESC) AS r FROM h WHERE vintage_date <= DATE '2024-01-20') WHERE r = 1""")
def vintage_store_asof(spark, sf_dir):
    """A history loaded in one job, put together by year, and read as of a day."""
    store = VintageStore(spark, fresh_folder(spark, "store"))
    delays = F.explode(F.array(*map(F.lit, (1, 7, 20))))
    late = _daily(spark, sf_dir).withColumn("k", delays).select("series_id", "period", "period_unit", F.lit("events").alias("source"), F.date_add("period", F.col("k")).alias("vintage_date"), (F.col("value") + F.col("k")).alias("value"))
    store.load_history(late.where("k < 20"))
    store.load_history(late.where("k = 20"))
    store.compact("events")
    return store.read_as_of("events", "2024-01-20").select("series_id", "period", "vintage_date", F.round("value", 6).alias("value"))


@query(f"WITH {VINTAGE_SQL} SELECT period_key, vintage_ts, value FROM vintages WHERE series_id = 'click'")
def vintage_history(spark, sf_dir):
    return vintages.history(events(spark, sf_dir).where("series_id = 'click'"), "vintage_ts", "period_key").select("period_key", "vintage_ts", "value")


@query(f"""WITH {VINTAGE_SQL} SELECT series_id, period_key, vintage_ts, value, row_number() OVER w AS vintage_no, round(value - lag(value) OVER w, 6) AS revision FROM vintages
WINDOW w AS (PARTITION BY series_id, period_key ORDER BY vintage_ts)""")
def vintage_revisions(spark, sf_dir):
    return vintages.revisions(events(spark, sf_dir), KEYS, "vintage_ts").withColumn("revision", F.round("revision", 6))


@query(f"""WITH {VINTAGE_SQL}, old AS (SELECT * FROM vintages WHERE vintage_ts < TIMESTAMP '2024-01-20'), new AS (SELECT series_id, period_key, vintage_ts, value * 2 AS value FROM vintages WHERE vintage_ts >= TIMESTAMP '2024-01-15')
SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.series_id = old.series_id AND new.period_key = old.period_key AND new.vintage_ts = old.vintage_ts) UNION ALL SELECT * FROM new""")
def vintage_upsert(spark, sf_dir):
    all_ = events(spark, sf_dir)
    new = all_.where("vintage_ts >= timestamp_ntz '2024-01-15'").withColumn("value", F.col("value") * 2)
    return vintages.replace_by_key(all_.where("vintage_ts < timestamp_ntz '2024-01-20'"), new, [*KEYS, "vintage_ts"])


@query("""WITH s AS (SELECT ts::DATE AS vintage_date, event_type AS category, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2),
new AS (SELECT vintage_date, category, value + 1 AS value FROM s WHERE vintage_date >= DATE '2024-01-25')
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.vintage_date = s.vintage_date AND new.category = s.category) UNION ALL SELECT * FROM new""")
def snapshot_anti_append(spark, sf_dir):
    s = read(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("vintage_date"), F.col("event_type").alias("category")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    new = s.where("vintage_date >= date '2024-01-25'").withColumn("value", F.col("value") + 1)
    return vintages.replace_by_key(s, new, ["vintage_date", "category"])


UNIT = "CASE category WHEN '1-URGENT' THEN 'year' WHEN '2-HIGH' THEN 'quarter' ELSE 'month' END"
OUT = """CASE period_unit WHEN 'year' THEN (period + INTERVAL 12 MONTH)::DATE + 45 WHEN 'quarter' THEN (date_trunc('quarter', period) + INTERVAL 3 MONTH)::DATE + 45
ELSE (period + INTERVAL 1 MONTH)::DATE + 45 END"""


@query(f"WITH {FLOW_SQL} SELECT period, category, direction, value FROM (SELECT *, {UNIT} AS period_unit FROM flow) WHERE {OUT} <= DATE '1999-11-15'")
def publication_lag_filter(spark, sf_dir):
    return panel.observable(flow(spark, sf_dir).withColumn("period_unit", F.expr(UNIT)), "1999-11-15", 45).drop("period_unit")


@query(f"WITH {FLOW_SQL} SELECT DISTINCT period, period_unit, {OUT} AS first_observable FROM (SELECT *, {UNIT} AS period_unit FROM flow)")
def first_observable(spark, sf_dir):
    rows = flow(spark, sf_dir).select("period", F.expr(UNIT).alias("period_unit")).distinct()
    return rows.withColumn("first_observable", cal.first_observable("period", F.col("period_unit"), 45))


@query("SELECT unnest(generate_series(date_trunc('quarter', min(o_orderdate))::DATE, date_trunc('quarter', max(o_orderdate))::DATE, INTERVAL 3 MONTH))::DATE AS quarter FROM orders")
def backtest_grid(spark, sf_dir):
    ends = read(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return ends.select(F.explode(cal.quarters("a", "b")).alias("quarter"))


@query("""WITH q AS (SELECT DISTINCT date_trunc('quarter', o_orderdate)::DATE AS period FROM orders), o(asof_date) AS (VALUES (DATE '1998-05-18'), (DATE '2000-01-01'))
SELECT asof_date, period, ((year(period) - year(r)) * 4 + (quarter(period) - quarter(r)))::INT AS horizon FROM (SELECT asof_date, period, date_trunc('quarter', asof_date - 1)::DATE AS r FROM q, o)
WHERE (year(period) - year(r)) * 4 + (quarter(period) - quarter(r)) BETWEEN -2 AND 1""")
def horizon_map(spark, sf_dir):
    """Periods at horizons -2 to 1 of the quarter that was just complete on each origin."""
    periods = read(spark, sf_dir, "orders").select(cal.quarter_start("o_orderdate").alias("period")).distinct()
    origins = spark.createDataFrame([("1998-05-18",), ("2000-01-01",)], "d string").select(F.col("d").cast("date").alias("asof_date"))
    both = periods.crossJoin(F.broadcast(origins)).withColumn("horizon", cal.horizon("period", cal.quarter_start(F.date_sub("asof_date", 1))))
    return both.where("horizon between -2 and 1").select("asof_date", "period", "horizon")


@query("""SELECT DISTINCT o_orderdate::DATE AS day, date_trunc('quarter', o_orderdate)::DATE AS quarter, (date_trunc('quarter', o_orderdate) - INTERVAL 3 MONTH)::DATE AS last_completed,
year(o_orderdate)::VARCHAR || ' Q' || quarter(o_orderdate)::VARCHAR AS label, make_date(year(o_orderdate - INTERVAL 6 MONTH)::INT, 7, 1) AS fy FROM orders""")
def quarter_label(spark, sf_dir):
    d = read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return d.select("day", cal.quarter_start("day").alias("quarter"), cal.last_completed_quarter("day").alias("last_completed"), cal.quarter_label("day").alias("label"), cal.fy_start("day").alias("fy"))


@query("""SELECT o_orderkey, CASE WHEN d / 90.0 < 3 THEN 'preliminary' WHEN d / 90.0 < 6 THEN 'revised' ELSE 'final' END AS status
FROM (SELECT o_orderkey, date_diff('day', date_trunc('quarter', o_orderdate)::DATE, DATE '2001-08-01') AS d FROM orders)""")
def status_by_age(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", cal.vintage_status(cal.quarter_start("o_orderdate"), F.lit("2001-08-01").cast("date")).alias("status"))


@query("""SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS period, CASE WHEN o_orderdate >= DATE '1999-07-01' THEN 'R4' WHEN o_orderdate >= DATE '1997-01-01' THEN 'R3' ELSE 'R2' END AS regime FROM orders""")
def regime_breaks(spark, sf_dir):
    m = read(spark, sf_dir, "orders").select(cal.month_start("o_orderdate").alias("period")).distinct()
    return m.select("period", labels.regime_by_breaks("period", ["1997-01-01", "1999-07-01"]).alias("regime"))


@query("""SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS period, CASE WHEN date_trunc('month', o_orderdate) BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' THEN 'early'
WHEN date_trunc('month', o_orderdate) BETWEEN DATE '1997-06-01' AND DATE '1999-12-31' THEN 'middle' END AS regime FROM orders""")
def regime_ranges(spark, sf_dir):
    m = read(spark, sf_dir, "orders").select(cal.month_start("o_orderdate").alias("period")).distinct()
    return m.select("period", labels.regime_by_ranges("period", [("early", "1995-01-01", "1997-12-31"), ("middle", "1997-06-01", "1999-12-31")]).alias("regime"))
