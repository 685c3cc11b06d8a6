"""Queries on the panel and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import fy_start
from ..functions.nulls import sum_strict
from ..operators import fits, panel, ratios, scoring
from ..operators.staging import staged
from .registry import registry, rounded
from .sources import ANNUAL_SQL, FLOW_SQL, PUBLISHED_SQL, annual, flow, published, read

QUERIES, ORACLES, query = registry()


@query(f"WITH {FLOW_SQL} SELECT period, category, coalesce(sum(value), 0) AS value FROM flow GROUP BY 1, 2")
def clean_flow(spark, sf_dir):
    return panel.cleaned(flow(spark, sf_dir), ["period", "category"])


@query(f"WITH {PUBLISHED_SQL} SELECT period, coalesce(sum(value), 0) AS value FROM published WHERE category <> '5-LOW' GROUP BY 1")
def clean_grants_exclude(spark, sf_dir):
    return panel.cleaned(published(spark, sf_dir), ["period"], exclude=["5-LOW"])


@query("""SELECT date_trunc('quarter', l_shipdate)::DATE AS period, l_returnflag AS category, CASE WHEN count(v) = count(*) THEN round(sum(v), 4) END AS strict, round(coalesce(sum(v), 0), 4) AS loose
FROM (SELECT *, CASE WHEN l_quantity = 50 AND day(l_shipdate) = 1 THEN NULL ELSE l_quantity END AS v FROM lineitem) GROUP BY 1, 2""")
def clean_target(spark, sf_dir):
    """Sums with and without nulls."""
    unknown = (F.col("l_quantity") == 50) & (F.dayofmonth("l_shipdate") == 1)
    rows = read(spark, sf_dir, "lineitem").withColumn("v", F.when(~unknown, F.col("l_quantity")))
    return rows.groupBy(F.trunc("l_shipdate", "quarter").alias("period"), F.col("l_returnflag").alias("category")).agg(F.round(sum_strict("v"), 4).alias("strict"), F.round(F.coalesce(F.sum("v"), F.lit(0.0)), 4).alias("loose"))


CELLS = f"""WITH {FLOW_SQL}, m AS (SELECT *, date_trunc('quarter', period)::DATE AS quarter, month(period) AS mon FROM flow),
q AS (SELECT quarter, category, direction, sum(value) AS value, count(DISTINCT period)::INT AS n_months FROM m GROUP BY 1, 2, 3)"""
SCALED = f"""{CELLS}, c AS (SELECT * FROM q WHERE n_months = 3 AND value > 0), sh AS (SELECT m.category, m.direction, mon, median(m.value / c.value) AS share FROM m JOIN c USING (quarter, category, direction)
WHERE quarter >= (SELECT max(quarter) - INTERVAL 5 YEAR FROM c) GROUP BY 1, 2, 3),
o AS (SELECT quarter, category, direction, CASE WHEN count(share) = count(*) THEN sum(share) END AS s, count(*) AS n FROM m JOIN q USING (quarter, category, direction) LEFT JOIN sh USING (category, direction, mon) WHERE n_months < 3 GROUP BY 1, 2, 3),
scaled AS (SELECT quarter, category, direction, CASE WHEN n_months < 3 THEN q.value / (CASE WHEN s > 0 THEN s ELSE n / 3.0::DOUBLE END) ELSE q.value END AS value, n_months FROM q LEFT JOIN o USING (quarter, category, direction))"""


@query(f"{CELLS} SELECT * FROM q")
def quarter_agg_raw(spark, sf_dir):
    return panel.monthly_to_quarterly(flow(spark, sf_dir), "raw")


@query(f"{CELLS} SELECT quarter, category, direction, CASE WHEN n_months = 3 THEN value END AS value, n_months FROM q")
def quarter_agg_drop(spark, sf_dir):
    return panel.monthly_to_quarterly(flow(spark, sf_dir), "drop")


@query(f"{SCALED} SELECT quarter, category, direction, round(value, 6) AS value, n_months FROM scaled")
def quarter_agg_scale(spark, sf_dir):
    return rounded(panel.monthly_to_quarterly(flow(spark, sf_dir), "scale"), "value")


QUARTERS = "SELECT category, period AS yr, value, unnest(generate_series(period, period + INTERVAL 9 MONTH, INTERVAL 3 MONTH))::DATE AS period FROM annual"


@query(f"WITH {ANNUAL_SQL} SELECT category, period, round(value / 4, 6) AS value FROM ({QUARTERS.replace('period AS yr, ', '')})")
def fy_spread_equal(spark, sf_dir):
    return rounded(panel.annual_to_quarterly(annual(spark, sf_dir), keys=["category"]), "value")


WEIGHTS = "w AS (SELECT l_returnflag AS category, date_trunc('quarter', l_shipdate)::DATE AS period, round(sum(l_extendedprice * (l_discount - 0.05::DOUBLE)), 2) AS weight FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {ANNUAL_SQL}, {WEIGHTS}, qq AS ({QUARTERS}), j AS (SELECT qq.*, sum(weight) OVER p AS raw, greatest(coalesce(weight, 0), 0) AS own, sum(greatest(coalesce(weight, 0), 0)) OVER p AS total
FROM qq LEFT JOIN w USING (category, period) WINDOW p AS (PARTITION BY category, yr))
SELECT category, period, round(value * CASE WHEN raw > 0 THEN own / total ELSE 0.25::DOUBLE END, 4) AS value FROM j""")
def fy_spread_proportional(spark, sf_dir):
    """Weights of either sign."""
    rows = read(spark, sf_dir, "lineitem")
    w = rows.groupBy(F.col("l_returnflag").alias("category"), F.trunc("l_shipdate", "quarter").alias("period")).agg(F.round(F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.05)), 2).alias("weight"))
    return rounded(panel.annual_to_quarterly(annual(spark, sf_dir), w, ["category"]), "value", places=4)


@query(f"""WITH {ANNUAL_SQL}, a AS (SELECT * FROM annual WHERE NOT (category = 'N' AND year(period) IN (1997, 1998)) AND NOT (category = 'A' AND year(period) = 2000)),
y AS (SELECT period, lag(period) OVER (ORDER BY period) AS before FROM (SELECT DISTINCT period FROM a))
SELECT a.period, category, round(value, 4) AS value FROM a JOIN y USING (period) WHERE NOT EXISTS (SELECT 1 FROM a p WHERE p.period = y.before AND p.category NOT IN (SELECT category FROM a n WHERE n.period = y.period))""")
def drop_incomplete_years(spark, sf_dir):
    a = annual(spark, sf_dir).where("not (category = 'N' and year(period) in (1997, 1998)) and not (category = 'A' and year(period) = 2000)")
    return rounded(panel.without_incomplete_years(a), "value", places=4)


WIDE = """wide AS (SELECT quarter AS period, category, max(CASE WHEN direction = 'arrival' THEN value END) AS oad_lt_arrivals, max(CASE WHEN direction = 'departure' THEN value END) AS oad_lt_departures,
max(CASE WHEN direction = 'arrival' THEN value END) - max(CASE WHEN direction = 'departure' THEN value END) AS oad_lt_net,
least(max(CASE WHEN direction = 'arrival' THEN n_months END), max(CASE WHEN direction = 'departure' THEN n_months END)) AS oad_months FROM scaled GROUP BY 1, 2)"""
WIDE_OUT = "round(oad_lt_arrivals, 6) AS oad_lt_arrivals, round(oad_lt_departures, 6) AS oad_lt_departures, round(oad_lt_net, 6) AS oad_lt_net, oad_months"
FLOWS = ("oad_lt_arrivals", "oad_lt_departures", "oad_lt_net")


@query(f"{SCALED}, {WIDE} SELECT period, category, {WIDE_OUT} FROM wide")
def pivot_direction(spark, sf_dir):
    return rounded(panel.by_direction(panel.monthly_to_quarterly(flow(spark, sf_dir))), *FLOWS)


STATUS = "CASE WHEN extract(doy FROM o_orderdate) % 3 = 0 THEN 'preliminary' WHEN extract(doy FROM o_orderdate) % 3 = 1 THEN 'revised' ELSE 'final' END"
STATUS_SQL = f"""st AS (SELECT date_trunc('quarter', o_orderdate)::DATE AS period, o_orderpriority AS category, {STATUS} AS vintage_status, o_totalprice AS value FROM orders WHERE o_orderstatus = 'P'),
known AS (SELECT period, category, avg(value) FILTER (vintage_status = 'preliminary') AS nom_preliminary, avg(value) FILTER (vintage_status = 'revised') AS nom_revised,
coalesce(avg(value) FILTER (vintage_status = 'final'), avg(value) FILTER (vintage_status = 'revised'), avg(value) FILTER (vintage_status = 'preliminary')) AS nom_final FROM st GROUP BY 1, 2)"""
KNOWN = ("nom_preliminary", "nom_revised", "nom_final")
KNOWN_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in KNOWN)


def _statuses(spark, sf_dir):
    day = F.dayofyear("o_orderdate") % 3
    kind = F.when(day == 0, "preliminary").when(day == 1, "revised").otherwise("final")
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderdate").cast("date").alias("period"), F.col("o_orderpriority").alias("category"), kind.alias("vintage_status"), F.col("o_totalprice").alias("value"))


@query(f"WITH {STATUS_SQL} SELECT period, category, {KNOWN_OUT} FROM known")
def pivot_status_mean(spark, sf_dir):
    return rounded(panel.by_status(_statuses(spark, sf_dir)), *KNOWN)


@query("""SELECT l_returnflag, l_linestatus, metric, round(value, 4) AS value FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, sum(l_tax) AS tax, avg(l_discount) AS discount FROM lineitem GROUP BY 1, 2)
UNPIVOT (value FOR metric IN (quantity, tax, discount))""")
def unpivot_metrics(spark, sf_dir):
    wide = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_tax").alias("tax"), F.avg("l_discount").alias("discount"))
    return rounded(wide.unpivot(["l_returnflag", "l_linestatus"], ["quantity", "tax", "discount"], "metric", "value"), "value", places=4)


LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
GRANTS_SQL = """g AS (SELECT make_date(year(o_orderdate - INTERVAL 6 MONTH)::INT, 7, 1) AS period, o_orderpriority AS category, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2),
gq AS (SELECT category, period AS yr, value, unnest(generate_series(period, period + INTERVAL 9 MONTH, INTERVAL 3 MONTH))::DATE AS period FROM g),
gj AS (SELECT gq.category, gq.period, gq.value, sum(oad_lt_arrivals) OVER p AS raw, greatest(coalesce(oad_lt_arrivals, 0), 0) AS own, sum(greatest(coalesce(oad_lt_arrivals, 0), 0)) OVER p AS total
FROM gq LEFT JOIN wide USING (category, period) WINDOW p AS (PARTITION BY gq.category, yr)),
granted AS (SELECT category, period, sum(value * CASE WHEN raw > 0 THEN own / total ELSE 0.25::DOUBLE END) AS visa_grants FROM gj GROUP BY 1, 2)"""
PANEL_SQL = f"""{SCALED}, {WIDE}, {STATUS_SQL}, {GRANTS_SQL}, periods AS (SELECT period FROM wide UNION SELECT period FROM known UNION SELECT period FROM granted),
levels(category) AS (VALUES {', '.join(f"('{c}')" for c in [*LEVELS, 'total'])}),
panel AS (SELECT period, category, oad_lt_arrivals, oad_lt_departures, oad_lt_net, oad_months, visa_grants, nom_preliminary, nom_revised, nom_final
FROM periods CROSS JOIN levels LEFT JOIN wide USING (period, category) LEFT JOIN known USING (period, category) LEFT JOIN granted USING (period, category))"""


def _panel(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    grants = o.groupBy(fy_start(F.col("o_orderdate").cast("date")).alias("period"), F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("period_unit", F.lit("year"))
    return staged(panel.build_panel(flow(spark, sf_dir), _statuses(spark, sf_dir), grants, LEVELS), "panel")


@query(f"{PANEL_SQL} SELECT period, category, {WIDE_OUT}, round(visa_grants, 4) AS visa_grants, {KNOWN_OUT} FROM panel")
def panel_build(spark, sf_dir):
    return rounded(rounded(_panel(spark, sf_dir), *FLOWS, *KNOWN), "visa_grants", places=4)


@query(f"{PANEL_SQL} SELECT period, round(coalesce(sum(nom_final), 0), 4) AS nom_final FROM panel WHERE category <> 'total' GROUP BY 1")
def total_prefer_or_sum(spark, sf_dir):
    return rounded(panel.total_series(_panel(spark, sf_dir)), "nom_final", places=4)


RATIO_SQL = f"""{PANEL_SQL}, ratio AS (SELECT period, category, oad_lt_arrivals AS n_arrivals, nom_final, least(greatest(nom_final / oad_lt_arrivals, 0), 12000) AS pi_hat
FROM panel WHERE period <= (SELECT max(period) - INTERVAL 18 MONTH FROM panel) AND category <> 'total' AND oad_lt_arrivals > 0 AND nom_final IS NOT NULL)"""


@query(f"{RATIO_SQL} SELECT period, category, round(n_arrivals, 6) AS n_arrivals, round(nom_final, 4) AS nom_final, round(pi_hat, 4) AS pi_hat FROM ratio")
def ratio_empirical(spark, sf_dir):
    return rounded(rounded(ratios.empirical_ratio(_panel(spark, sf_dir), ceiling=12000.0), "n_arrivals"), "nom_final", "pi_hat", places=4)


@query(f"""{PANEL_SQL}, t AS (SELECT period, sum(oad_lt_arrivals) AS a, sum(oad_lt_arrivals) * 0.8::DOUBLE AS n, sum(nom_final) AS f FROM panel WHERE category <> 'total' GROUP BY 1)
SELECT period, category, round(a, 4) AS n_arrivals, round(f, 4) AS nom_final, round(least(greatest(f / n, 0), 12000), 4) AS pi_hat FROM t CROSS JOIN levels
WHERE period <= (SELECT max(period) - INTERVAL 18 MONTH FROM panel) AND n > 0 AND f IS NOT NULL""")
def ratio_fallback_broadcast(spark, sf_dir):
    """Only the total has published figures: its ratio to net flow stands for every category, and for the total."""
    p = _panel(spark, sf_dir)
    arrivals = F.sum("oad_lt_arrivals")
    total = p.where("category <> 'total'").groupBy("period").agg(arrivals.alias("oad_lt_arrivals"), (arrivals * 0.8).alias("oad_lt_net"), F.sum("nom_final").alias("nom_final")).withColumn("category", F.lit("total"))
    bare = p.where("category <> 'total'").withColumn("nom_final", F.lit(None).cast("double"))
    return rounded(ratios.empirical_ratio(bare.unionByName(total, allowMissingColumns=True), ceiling=12000.0), "n_arrivals", "nom_final", "pi_hat", places=4)


@query(f"{RATIO_SQL} SELECT category, round(median(pi_hat), 4) AS pi_hat FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY period DESC) AS r FROM ratio) WHERE r <= 8 GROUP BY 1")
def ratio_project_median_n(spark, sf_dir):
    return rounded(ratios.last_value(ratios.empirical_ratio(_panel(spark, sf_dir), ceiling=12000.0), ["category"], "pi_hat"), "pi_hat", places=4)


LAGS = [f"round(lag({c}, {k}) OVER w, 6) AS {c}_l{k}" for c in ("oad_lt_arrivals", "oad_lt_departures") for k in range(5)]


@query(f"{SCALED}, {WIDE} SELECT period, category, {', '.join(LAGS)} FROM wide WINDOW w AS (PARTITION BY category ORDER BY period)")
def lag_features(spark, sf_dir):
    wide = panel.by_direction(panel.monthly_to_quarterly(flow(spark, sf_dir)))
    out = scoring.lags(wide, ["oad_lt_arrivals", "oad_lt_departures"], 4, ["category"])
    names = [c for c in out.columns if "_l0" in c or c[-3:-1] == "_l"]
    return rounded(out.select("period", "category", *names), *names)


@query(f"WITH {FLOW_SQL} SELECT period, category, direction, value, round((value - b) / nullif(b, 0), 8) AS growth FROM (SELECT *, lag(value) OVER (PARTITION BY category, direction ORDER BY period) AS b FROM flow)")
def growth_rate(spark, sf_dir):
    return rounded(scoring.growth(flow(spark, sf_dir), ["category", "direction"], "value"), "growth", places=8)


@query(f"WITH {FLOW_SQL} SELECT category, direction, period, lag(value) OVER (PARTITION BY category, direction ORDER BY period) AS nom_mean FROM flow")
def random_walk(spark, sf_dir):
    return scoring.random_walk(flow(spark, sf_dir), ["category", "direction"], "value")


@query(f"""WITH {FLOW_SQL}, g AS (SELECT *, (value - b) / nullif(b, 0) AS g FROM (SELECT *, lag(value) OVER (PARTITION BY category, direction ORDER BY period) AS b FROM flow)),
l AS (SELECT *, lag(g) OVER (PARTITION BY category, direction ORDER BY period) AS pg FROM g),
f AS (SELECT category, direction, regr_slope(g, pg) AS s, regr_intercept(g, pg) AS i, count(g) AS n FROM l GROUP BY 1, 2)
SELECT category, direction, period, round(b * (1 + i + s * pg), 4) AS nom_mean FROM l JOIN f USING (category, direction) WHERE n >= 6""")
def ar1_cls(spark, sf_dir):
    return rounded(scoring.autoregression_ls(flow(spark, sf_dir), ["category", "direction"], "value"), "nom_mean", places=4)


#: The exact likelihood: mean and coefficient in turn, the latter as the middle root of a cubic.
AR1_SQL = f"""WITH RECURSIVE {FLOW_SQL}, y AS (SELECT *, lag(value) OVER w AS b, count(*) OVER (PARTITION BY category, direction) AS ny FROM flow WINDOW w AS (PARTITION BY category, direction ORDER BY period)),
g AS (SELECT *, (value - b) / nullif(b, 0) AS g FROM y WHERE ny >= 6), k AS (SELECT *, lag(g) OVER (PARTITION BY category, direction ORDER BY period) AS pg FROM g WHERE g IS NOT NULL),
s AS (SELECT category, direction, count(*)::DOUBLE AS n, sum(g) AS s, sum(g * g) AS q, sum(g * pg) AS p, arg_min(g, period) AS x1, arg_max(g, period) AS xn FROM k GROUP BY 1, 2),
it AS (SELECT category, direction, 0 AS step, 0.0::DOUBLE AS phi, s / n AS m FROM s UNION ALL
SELECT category, direction, step + 1, f, ((1 + f) * x1 + (s - x1) - f * (s - xn)) / ((1 + f) + (n - 1) * (1 - f)) FROM (SELECT *, -2 * sqrt(big) * cos((acos(greatest(least((2 * a2 * a2 * a2 - 9 * a2 * a1 + 27 * a0) / (54 * big * sqrt(big)), 1), -1)) - 2 * pi()) / 3) - a2 / 3 AS f FROM (SELECT *, (a2 * a2 - 3 * a1) / 9 AS big FROM (
SELECT *, -(n - 2) * c / ((n - 1) * i) AS a2, -(n * i + a) / ((n - 1) * i) AS a1, n * c / ((n - 1) * i) AS a0 FROM (SELECT *, a - (x1 - m) ^ 2 - (xn - m) ^ 2 AS i FROM (
SELECT it.*, n, s, x1, xn, q - 2 * m * s + n * m * m AS a, p - m * (2 * s - x1 - xn) + (n - 1) * m * m AS c FROM it JOIN s USING (category, direction) WHERE step < 100))))))"""


@query(f"""{AR1_SQL} SELECT category, direction, s.n::BIGINT AS n, round(m, 6) AS mean, round(phi, 6) AS phi FROM it JOIN s USING (category, direction) WHERE step = 100""")
def ar1_likelihood(spark, sf_dir):
    """The stationary autoregression of each series' growth with the largest exact likelihood."""
    keys, w = ["category", "direction"], Window.partitionBy("category", "direction")
    long = flow(spark, sf_dir).withColumn("_n", F.count(F.lit(1)).over(w)).where("_n >= 6")
    return rounded(scoring.likelihood_ar1(scoring.growth(long, keys, "value"), keys, "growth"), "mean", "phi")


@query(f"""{AR1_SQL} SELECT category, direction, period, round(b * (1 + m + coalesce(phi * (pg - m), 0)), 4) AS nom_mean
FROM (SELECT g.*, lag(g) OVER (PARTITION BY category, direction ORDER BY period) AS pg FROM g) JOIN it USING (category, direction) WHERE step = 100 AND b IS NOT NULL""")
def ar1_ml(spark, sf_dir):
    return rounded(scoring.autoregression(flow(spark, sf_dir), ["category", "direction"], "value"), "nom_mean", places=4)


@query(f"""{SCALED}, {WIDE}, v AS (SELECT category, period, oad_lt_arrivals AS x1, oad_lt_departures AS x2, 3 * oad_lt_arrivals - 2 * oad_lt_departures + 10 * sin(month(period) + year(period)) AS y FROM wide),
k AS (SELECT * FROM v WHERE x1 IS NOT NULL AND x2 IS NOT NULL), n AS (SELECT category FROM v GROUP BY 1 HAVING count(y) >= 4),
s AS (SELECT category, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS m, regr_sxx(y, x1) AS s11, regr_sxx(y, x2) AS s22, regr_sxy(x1, x2) AS s12, regr_sxy(y, x1) AS r1, regr_sxy(y, x2) AS r2 FROM k GROUP BY 1)
SELECT category, period, round(m + (s22 * r1 - s12 * r2) / (s11 * s22 - s12 * s12) * (x1 - m1) + (s11 * r2 - s12 * r1) / (s11 * s22 - s12 * s12) * (x2 - m2), 4) AS nom_mean FROM v JOIN n USING (category) JOIN s USING (category)""")
def bridge_gram(spark, sf_dir):
    """Two regressors, by category: sums of products, merged and solved in columns."""
    wide = panel.by_direction(panel.monthly_to_quarterly(flow(spark, sf_dir)))
    a, d = F.col("oad_lt_arrivals"), F.col("oad_lt_departures")
    y = 3 * a - 2 * d + 10 * F.sin(F.month("period") + F.year("period"))
    fitted = fits.bridge_forecasts(wide.select("category", "period", "oad_lt_arrivals", d.alias("visa_grants"), y.alias("nom_final")), last=0)
    return rounded(fitted.drop("status"), "nom_mean", places=4)


@query(f"""{SCALED}, {WIDE} SELECT category, round(regr_slope(oad_lt_departures, oad_lt_arrivals), 6) AS slope, round(regr_intercept(oad_lt_departures, oad_lt_arrivals), 6) AS intercept, round(regr_r2(oad_lt_departures, oad_lt_arrivals), 6) AS r2 FROM wide GROUP BY 1""")
def bridge_ols(spark, sf_dir):
    """One regressor, by category."""
    wide = panel.by_direction(panel.monthly_to_quarterly(flow(spark, sf_dir)))
    y, x = F.col("oad_lt_departures"), F.col("oad_lt_arrivals")
    return wide.groupBy("category").agg(*(F.round(f(y, x), 6).alias(n) for n, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept), ("r2", F.regr_r2))))
