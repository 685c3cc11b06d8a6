"""Queries on labels, grids, links and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar as cal
from ..functions import labels
from ..sources import grids, tables, web
from .registry import registry
from .sources import read

QUERIES, ORACLES, query = registry()


def case(column: str, rules: list[tuple[str, str]]) -> str:
    """The rules as SQL."""
    quote = lambda s: s.replace("'", "''")
    hit = lambda p: f"regexp_matches({column}, '{quote(p.replace('(?i)', ''))}', 'i')" if "(?i)" in p else f"regexp_matches({column}, '{quote(p)}')"
    return "CASE " + " ".join(f"WHEN {hit(p)} THEN '{v}'" for p, v in rules) + " END"


@query(f"SELECT doc_id, {case('text', labels.VISA_GROUP_RULES[1:])} AS category FROM documents")
def classify_ordered_regex(spark, sf_dir):
    """Movement-table rules on whole texts."""
    return read(spark, sf_dir, "documents").select("doc_id", labels.by_rules("text", labels.VISA_GROUP_RULES[1:]).alias("category"))


TITLES = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Student visas granted' WHEN '2-HIGH' THEN 'Temporary Work (Skilled)' WHEN '3-MEDIUM' THEN 'Visitor visa' WHEN '4-NOT SPECIFIED' THEN 'Partner and family' ELSE 'Something else' END"


@query(f"SELECT o_orderkey, {case('title', labels.DATASET_RULES)} AS category FROM (SELECT o_orderkey, {TITLES} AS title FROM orders)")
def classify_title(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", labels.dataset(F.expr(TITLES)).alias("category"))


@query("""SELECT p_partkey, CASE WHEN c IN ('500', '570') THEN 'student' WHEN c IN ('190', '482') THEN 'skilled' WHEN c IN ('100', '300', '310') THEN 'family' WHEN c IN ('010', '020', '030', '040', '050', '060', '070') THEN 'bridging' WHEN c IN ('400') THEN 'other_temp' ELSE 'other' END AS category
FROM (SELECT p_partkey, lpad((p_size * 10)::VARCHAR, 3, '0') AS c FROM part)""")
def classify_subclass(spark, sf_dir):
    """Part sizes as subclass numbers."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.lpad((F.col("p_size") * 10).cast("string"), 3, "0").alias("c"))
    return p.select("p_partkey", labels.subclass("c").alias("category"))


@query(f"""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN make_date(y::INT, 7, 1) WHEN 2 THEN make_date(y::INT, 1, 1) WHEN 3 THEN (make_date(y::INT, 7, 1) + to_months((3 * (q::INT - 1))::INT))::DATE END AS period, CASE WHEN l_linenumber = 3 THEN 'quarter' ELSE 'year' END AS unit
FROM (SELECT l_orderkey, l_linenumber, year(l_shipdate)::VARCHAR AS y, quarter(l_shipdate)::VARCHAR AS q FROM lineitem)""")
def period_label_parse(spark, sf_dir):
    y, q = F.year("l_shipdate"), F.quarter("l_shipdate").cast("string")
    fy = F.concat(y.cast("string"), F.lit("-"), F.right((y + 1).cast("string"), F.lit(2)))
    text = F.when(F.col("l_linenumber") == 1, fy).when(F.col("l_linenumber") == 2, y.cast("string")).when(F.col("l_linenumber") == 3, F.concat(fy, F.lit(" Q"), q)).otherwise(F.concat(F.lit("n/a "), y.cast("string")))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("label"))
    return rows.select("l_orderkey", "l_linenumber", cal.period_label("label").alias("period"), cal.label_unit("label").alias("unit"))


@query("""SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month FROM orders""")
def month_label_parse(spark, sf_dir):
    """Five spellings of a month."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format(d, "MMM-yyyy")).when(k == 1, F.date_format(d, "MMM yyyy")).when(k == 2, F.date_format(d, "yyyy-MM")).when(k == 3, F.date_format(d, "yyyy-MM-dd")).otherwise(F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", cal.month_label(text).alias("month"))


@query("SELECT p_partkey, (DATE '1899-12-30' + (40000 + p_partkey)::INT)::DATE AS day FROM part")
def excel_serial(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", cal.excel_date(F.col("p_partkey") + 40000).alias("day"))


@query("""SELECT o_orderkey, split_part(s, ':', 1) AS source, nullif(split_part(s, ':', 2), '') AS category, nullif(split_part(s, ':', 3), '') AS direction
FROM (SELECT o_orderkey, 'oad:' || o_orderpriority || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ':' || o_orderstatus END AS s FROM orders)""")
def series_id_split(spark, sf_dir):
    s = F.concat(F.lit("oad:"), "o_orderpriority", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit(":"), "o_orderstatus")))
    parts = F.split(s, ":")
    return read(spark, sf_dir, "orders").select("o_orderkey", parts[0].alias("source"), F.get(parts, F.lit(1)).alias("category"), F.get(parts, F.lit(2)).alias("direction"))


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k, props ->> '$.absent' AS absent FROM events")
def json_metadata(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))


SHEETS = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS r, event_type, ts FROM events)"


def _sheet(spark, sf_dir, text):
    """Each user's events as the first column of a sheet."""
    row = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return read(spark, sf_dir, "events").select("user_id", row.alias("row"), F.lit(1).alias("col"), "event_type", "ts").select("user_id", "row", "col", text.alias("text"))


@query(f"""WITH {SHEETS} SELECT user_id, r, last_value(CASE WHEN r % 3 = 1 THEN event_type || r END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY r) AS filled FROM s""")
def fill_down_header(spark, sf_dir):
    """A label on every third row, blanks between."""
    cells = _sheet(spark, sf_dir, F.when(F.col("row") % 3 == 1, F.concat("event_type", F.col("row").cast("string"))).otherwise(F.lit("")))
    return grids.filled_down(cells, ["user_id"], [1]).select("user_id", F.col("row").alias("r"), F.col("c1").alias("filled"))


@query(f"""WITH {SHEETS}, d AS (SELECT user_id, r, event_type NOT IN ('click', 'error') AS ok FROM s), w AS (SELECT *, lead(ok, 1, false) OVER k AS b, lead(ok, 2, false) OVER k AS c FROM d WINDOW k AS (PARTITION BY user_id ORDER BY r))
SELECT user_id, greatest(min(r) - 1, 1)::INT AS header FROM w WHERE ok AND b AND c GROUP BY 1""")
def header_detect(spark, sf_dir):
    """The row before the first three months in a row; some events have a word instead."""
    text = F.when(F.col("event_type").isin("click", "error"), "Series").otherwise(F.date_format("ts", "MMM-yyyy"))
    return grids.header_row(_sheet(spark, sf_dir, text), ["user_id"])


@query("""WITH v AS (SELECT make_date(year(l_shipdate), 1, 1) AS period, sum(l_quantity) AS value FROM lineitem GROUP BY 1), t AS (SELECT period, value * CASE WHEN year(period) % 2 = 0 THEN 1.02::DOUBLE ELSE 1.005::DOUBLE END AS total FROM v)
SELECT period, round(total, 4) AS total, round(value, 4) AS parts FROM t JOIN v USING (period) WHERE abs(value - total) > 0.01 * abs(total)""")
def pivot_reconcile(spark, sf_dir):
    v = read(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "year").alias("period"), "l_returnflag").agg(F.sum("l_quantity").alias("value"))
    t = v.groupBy("period").agg(F.sum("value").alias("value")).select("period", (F.col("value") * F.when(F.year("period") % 2 == 0, 1.02).otherwise(1.005)).alias("total"))
    return grids.reconciled(v, t).select("period", F.round("total", 4).alias("total"), F.round("parts", 4).alias("parts"))


@query("""WITH f AS (SELECT l_returnflag AS c1, make_date(year(l_shipdate - INTERVAL 6 MONTH)::INT, 7, 1) AS period, sum(l_linenumber)::DOUBLE AS value FROM lineitem GROUP BY 1, 2)
SELECT * FROM f WHERE (period + INTERVAL 12 MONTH)::DATE - 1 <= DATE '2000-12-31'""")
def ytd_partial_drop(spark, sf_dir):
    """A melted pivot with subtotal rows, locked at the end of 2000."""
    start = cal.fy_start(F.col("l_shipdate").cast("date"))
    fy = F.concat(F.year(start).cast("string"), F.lit("-"), F.right((F.year(start) + 1).cast("string"), F.lit(2)))
    base = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("c1"), fy.alias("head"), F.col("l_linenumber").cast("string").alias("text"))
    rows = base.unionByName(base.withColumn("c1", F.concat("c1", F.lit(" Total"))))
    return grids.pivot_values(rows, ["c1"], "2000-12-31").drop("period_unit")


@query("""WITH r AS (SELECT o_custkey AS dataset, o_orderkey AS url, CASE WHEN o_orderstatus <> 'P' AND o_custkey % 7 <> 0 THEN o_orderdate::DATE END AS lock FROM orders)
SELECT dataset, url, lock FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY lock DESC NULLS LAST, url DESC) AS n, count(lock) OVER (PARTITION BY dataset) AS k FROM r) WHERE k = 0 OR n = 1""")
def latest_per_dataset(spark, sf_dir):
    dated = (F.col("o_orderstatus") != "P") & (F.col("o_custkey") % 7 != 0)
    name = F.concat(F.lit("granted-"), F.when(dated, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("none"), F.lit(".xlsx"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("url"), web.lock_date(name).alias("lock"))
    return web.latest_resources(rows, ["dataset"])


@query("""WITH f AS (SELECT url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1)) AS link FROM pages)
SELECT DISTINCT url, CASE WHEN starts_with(link, '/') THEN host || link ELSE link END AS link FROM f""")
def html_links(spark, sf_dir):
    return web.links(read(spark, sf_dir, "pages"))


@query("""SELECT event_type AS dataset_title, 'u' || event_id::VARCHAR AS url, 'XLSX' AS format, (props ->> '$.k') AS name FROM events""")
def catalogue_resources(spark, sf_dir):
    """Events dressed as catalogue answers, a package for each."""
    resource = F.struct(F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), F.lit("XLSX").alias("format"), F.get_json_object("props", "$.k").alias("name"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("event_type").alias("title"), F.array(resource).alias("resources"))).alias("results")).alias("result")))
    return web.catalogue(read(spark, sf_dir, "events").select(body.alias("body")))


@query("SELECT page_id, 'raw/web/2026-01-01/' || left(sha1(url), 10) || '.html' AS path FROM pages")
def cache_paths(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", web.cache_path("web", "2026-01-01", "url", ".html").alias("path"))


@query("""SELECT event_type AS label, date_trunc('month', o)::DATE AS period, count(*)::DOUBLE AS value FROM (SELECT event_type, DATE '2023-01-15' + to_months((user_id % 6)::INT) AS o FROM events) GROUP BY 1, 2""")
def wide_table(spark, sf_dir):
    """A column for each month, read back as rows."""
    month = F.date_format(F.add_months(F.lit("2023-01-15").cast("date"), (F.col("user_id") % 6).cast("int")), "MMM yyyy")
    rows = read(spark, sf_dir, "events").select("event_type", month.alias("m"))
    wide = rows.groupBy("event_type").pivot("m", [f"{m} 2023" for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun")]).count()
    return tables.wide_to_long(wide, "event_type").select("label", "period", "value")


@query("""SELECT period, direction, sum(value) AS value FROM (SELECT date_trunc('month', o_orderdate)::DATE AS period, 'arrival' AS direction, o_custkey::DOUBLE AS value FROM orders
UNION ALL SELECT date_trunc('month', o_orderdate)::DATE, 'departure', o_orderkey::DOUBLE FROM orders) GROUP BY 1, 2""")
def directed_flows(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderdate", F.col("o_custkey").alias("inbound"), F.col("o_orderkey").alias("outbound"))
    return tables.directed_flows(o).groupBy("period", "direction").agg(F.sum("value").alias("value"))
