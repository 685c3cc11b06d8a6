"""Queries that read workbooks' cells by whole parsers. The cells are laid out from the tables; the SQL takes the tables themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import fy_start, month_start
from ..operators import scoring, vintages
from ..operators.staging import fresh_folder, staged
from ..sources import parsers, web, workbooks
from .registry import registry
from .sources import read

QUERIES, ORACLES, query = registry()
GROUPS = {"1-URGENT": "Student visas", "2-HIGH": "Temporary skill", "3-MEDIUM": "Total", "4-NOT SPECIFIED": "New  Zealand citizen", "5-LOW": "Working holiday"}
LINES = {1: "Student", 2: "Skilled", 3: "Working holiday", 4: "Family", 5: "Total", 6: "Bridging", 7: "Permanent"}
SIDES = {"A": "Arrivals", "N": "Departures", "R": "Net"}


def _cells(*frames: DataFrame) -> DataFrame:
    """All cells, written once: parsers read them in several branches."""
    return staged(reduce(DataFrame.unionByName, frames).where("text is not null"), "cells")


def _place(df: DataFrame, row, col, text, sheet="S", path="/in/m.xlsx") -> DataFrame:
    c = lambda x: x if not isinstance(x, (str, int)) else F.lit(x)
    return df.select(F.lit(path).alias("path"), c(sheet).alias("sheet"), c(row).cast("int").alias("row"), c(col).cast("int").alias("col"), c(text).cast("string").alias("text"))


def _mapped(column: str, names: dict):
    out = None
    for k, v in names.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out


def _numbered(df: DataFrame, *by: str) -> DataFrame:
    """The distinct values of some columns, numbered in order: the rows or columns of a sheet."""
    return df.select(*by).distinct().withColumn("n", F.row_number().over(Window.orderBy(*by)))


def _one(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "path string, sheet string, row int, col int, text string")


def _monthly(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.groupBy(month_start("o_orderdate").alias("m"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).alias("v"))


@query("""SELECT 'oad:' || category || ':arrival' AS series_id, date_trunc('month', o_orderdate)::DATE AS period, 'month' AS period_unit, count(*)::DOUBLE AS value, category, 'arrival' AS direction, 'persons' AS unit,
  '{"file":"m.xlsx","sheet":"Table ' || o_orderstatus || '","visa_group":"' || label || '"}' AS metadata
FROM orders JOIN (VALUES ('1-URGENT', 'Student visas', 'student'), ('2-HIGH', 'Temporary skill', 'skilled'), ('4-NOT SPECIFIED', 'New  Zealand citizen', 'nz_citizen'), ('5-LOW', 'Working holiday', 'working_holiday')) AS g(p, label, category) ON p = o_orderpriority
GROUP BY period, category, label, o_orderstatus""")
def movement_cube(spark, sf_dir):
    """A sheet of months by visa group for each order status."""
    v = _monthly(spark, sf_dir)
    sheet, m = F.concat(F.lit("Table "), F.col("s")), _numbered(v, "m")
    p = _numbered(v, "p").withColumn("head", _mapped("p", GROUPS))
    s = v.select("s").distinct()
    cells = _cells(
        _place(s, 1, 1, "Movements by visa", sheet), _place(s, 2, 2, "Mar-2020", sheet),
        _place(s.crossJoin(p), 9, F.col("n") + 1, F.col("head"), sheet),
        _place(s.crossJoin(m), F.col("n") + 9, 1, F.date_format("m", "MMM-yyyy"), sheet),
        _place(v.join(m, "m").join(p.select("p", F.col("n").alias("c")), "p"), F.col("n") + 9, F.col("c") + 1, F.col("v"), sheet),
    )
    return parsers.movement_cubes(cells, "arrival")


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, o_orderpriority AS p, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2)
SELECT 'oad_lt:' || direction || ':total' AS series_id, period, 'month' AS period_unit, value, 'total' AS category, direction, 'persons' AS unit, '{"file":"m.xlsx","sheet":"Data1","abs_series_id":"' || id || '","series":"' || p || '"}' AS metadata
FROM m JOIN (VALUES ('2-HIGH', 'arrival', 'A2'), ('3-MEDIUM', 'departure', 'A3')) AS g(p, direction, id) USING (p)""")
def aggregate_table(spark, sf_dir):
    """One column by its id, one by its label since its id is not there, one not at all."""
    v = _monthly(spark, sf_dir).groupBy("m", "p").agg(F.sum("v").alias("v"))
    m, p = _numbered(v, "m"), _numbered(v, "p")
    serial = F.datediff("m", F.lit("1899-12-30").cast("date"))
    cells = _cells(
        _place(p, 1, F.col("n") + 1, F.col("p"), "Data1"), _place(p, 10, F.col("n") + 1, F.concat(F.lit("A"), F.col("n")), "Data1"), _place(p, 10, F.col("n") + 1, "A9", "Data2"),
        _place(m, F.col("n") + 10, 1, serial, "Data1"), _place(v.join(m, "m").join(p.select("p", F.col("n").alias("c")), "p"), F.col("n") + 10, F.col("c") + 1, F.col("v"), "Data1"),
    )
    return parsers.aggregate_tables(cells, [("arrival", "A2", "(?i)low"), ("departure", "A99", "(?i)medium"), ("net", "A98", "nothing")])


@query("""WITH f AS (SELECT make_date(year(l_shipdate - INTERVAL 6 MONTH)::INT, 7, 1) AS period, l_returnflag AS r, l_linenumber AS m, sum(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT period, value, direction, category FROM f JOIN (VALUES ('A', 'arrival'), ('N', 'departure'), ('R', 'net')) AS d(r, direction) USING (r)
JOIN (VALUES (1, 'student'), (2, 'skilled'), (3, 'working_holiday'), (4, 'family'), (6, 'bridging'), (7, 'permanent')) AS g(m, category) USING (m))
SELECT 'nom_annual:' || category || ':' || direction AS series_id, period, 'year' AS period_unit, round(value, 4) AS value, category, direction,
CASE WHEN (DATE '1998-06-30' - period) / 90.0 < 3 THEN 'preliminary' WHEN (DATE '1998-06-30' - period) / 90.0 < 6 THEN 'revised' ELSE 'final' END AS vintage_status, 'persons' AS unit, '{"file":"m.xlsx"}' AS metadata FROM k""")
def annual_cube(spark, sf_dir):
    """The national sheet beside one of a state; directions stand on the first row of their block only."""
    l = read(spark, sf_dir, "lineitem").groupBy(fy_start(F.col("l_shipdate").cast("date")).alias("y"), F.col("l_returnflag").alias("r"), F.col("l_linenumber").alias("m")).agg(F.sum("l_quantity").alias("v"))  # noqa: E741
    rows = _numbered(l, "r", "m").withColumn("first", F.row_number().over(Window.partitionBy("r").orderBy("m")) == 1)
    years = _numbered(l, "y").withColumnRenamed("n", "c")
    label = F.format_string("%d-%02d", F.year("y"), F.pmod(F.year("y") + 1, F.lit(100)))
    values = l.join(rows, ["r", "m"]).join(years, "y")
    national = "Table 4.9"
    cells = _cells(
        _one(spark, [("/in/m.xlsx", s, 5, c, t) for s in (national, "Table 4.1") for c, t in ((1, "Direction"), (2, "Visa Group"))] + [("/in/m.xlsx", national, 2, 1, "Year ended")]),
        _place(years, 5, F.col("c") + 3, label, national), _place(rows.where("first"), F.col("n") + 5, 1, _mapped("r", SIDES), national),
        _place(rows, F.col("n") + 5, 2, _mapped("m", LINES), national), _place(values, F.col("n") + 5, F.col("c") + 3, F.col("v").cast("double"), national),
        _place(years, 5, F.col("c") + 3, label, "Table 4.1"), _place(values, F.col("n") + 5, F.col("c") + 3, F.lit(1), "Table 4.1"),
    )
    return parsers.annual_cubes(cells, "1998-06-30").withColumn("value", F.round("value", 4))


@query("""WITH f AS (SELECT make_date(year(o_orderdate - INTERVAL 6 MONTH)::INT, 7, 1) AS period, o_orderstatus AS s, o_orderpriority AS sector, count(*)::DOUBLE AS value FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2, 3)
SELECT 'dha_grants:student:' || applicant AS series_id, period, 'year' AS period_unit, value, 'student' AS category, 'persons' AS unit,
'{"dataset":"Student visa program","file":"a.xlsx","applicant":"' || applicant || '","sector":"' || sector || '"}' AS metadata
FROM f JOIN (VALUES ('F', 'Primary'), ('O', 'Secondary')) AS a(s, applicant) USING (s) WHERE period + INTERVAL 1 YEAR - INTERVAL 1 DAY <= DATE '1998-03-31'""")
def pivot_table(spark, sf_dir):
    """Filters above the header, merged labels, subtotals and a year that was not over; a second workbook has no header."""
    o = read(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')")
    v = o.groupBy(fy_start(F.col("o_orderdate").cast("date")).alias("y"), _mapped("o_orderstatus", {"F": "Primary", "O": "Secondary"}).alias("a"), F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("v"))
    rows = _numbered(v, "a", "p").withColumn("first", F.row_number().over(Window.partitionBy("a").orderBy("p")) == 1).withColumn("row", F.col("n") + F.when(F.col("a") == "Primary", 6).otherwise(7))
    years = _numbered(v, "y").withColumnRenamed("n", "c")
    values = v.join(rows, ["a", "p"]).join(years, "y")
    path, sheet = "/in/a.xlsx", "Granted by type"
    put = lambda df, row, col, text: _place(df, row, col, text, sheet, path)
    totals = rows.groupBy("a").agg(F.max("row").alias("last"))
    cells = _cells(
        _one(spark, [(path, "Notes", 1, 1, "Applicant Type"), (path, "Lodged", 6, 1, "Applicant Type"), (path, sheet, 2, 1, "Applicant Type"), (path, sheet, 2, 2, "(All)"), (path, sheet, 6, 1, "Applicant Type"), (path, sheet, 6, 2, "Sector"), (path, sheet, 90, 1, "Grand Total"), (path, sheet, 90, 3, "1"), ("/in/b.xlsx", "Granted", 3, 1, "nothing")]),
        put(years, 6, F.col("c") + 2, F.format_string("%d-%02d", F.year("y"), F.pmod(F.year("y") + 1, F.lit(100)))), put(rows.where("first"), F.col("row"), 1, F.col("a")), put(rows, F.col("row"), 2, F.col("p")),
        put(values, F.col("row"), F.col("c") + 2, F.col("v")), put(totals.where("a = 'Primary'"), F.col("last") + 1, 1, F.concat("a", F.lit(" Total"))), put(totals.where("a = 'Primary'"), F.col("last") + 1, 3, 7),
    )
    files = spark.createDataFrame([(path, "Student visa program", "1998-03-31"), ("/in/b.xlsx", "Visitor visa program", None)], "path string, title string, lock string").withColumn("lock", F.col("lock").cast("date"))
    return parsers.pivot_tables(cells, files)


@query("""SELECT 'twh:' || sub AS series_id, date_trunc('month', o_orderdate)::DATE AS period, CASE WHEN month(o_orderdate) IN (1, 4, 7, 10) THEN 'quarter' ELSE 'month' END AS period_unit, count(*)::DOUBLE AS value, category, 'persons' AS unit,
'{"file":"stock.csv","subclass":"' || sub || '"}' AS metadata FROM orders JOIN (VALUES ('1-URGENT', '500 Student', 'student'), ('2-HIGH', '482', 'skilled'), ('3-MEDIUM', '417 WHM', 'working_holiday'), ('4-NOT SPECIFIED', '444', 'nz_citizen'), ('5-LOW', 'unknown', 'other')) AS g(p, sub, category) ON p = o_orderpriority
GROUP BY series_id, period, period_unit, category, sub""")
def stock_table(spark, sf_dir):
    v = _monthly(spark, sf_dir).groupBy("m", "p").agg(F.sum("v").alias("v"))
    names = {"1-URGENT": "500 Student", "2-HIGH": "482", "3-MEDIUM": "417 WHM", "4-NOT SPECIFIED": "444", "5-LOW": "unknown"}
    table = v.select(F.date_format("m", "yyyy-MM").alias("Report Month"), F.col("v").cast("string").alias("Number of holders"), _mapped("p", names).alias("Visa Subclass"), F.lit("x").alias("Note"))
    return parsers.stock_table(table, "stock.csv")


def _stored(spark, sf_dir):
    """Events as rows of the store: some with a series in their metadata, some with broken or no metadata."""
    e = read(spark, sf_dir, "events")
    about = F.when(F.pmod("user_id", F.lit(3)) == 0, '{"series":"Student visa arrivals"}').when(F.pmod("user_id", F.lit(3)) == 1, "no json")
    return e.select(F.concat(F.lit("oad:"), F.col("event_type"), F.when(F.pmod("user_id", F.lit(5)) > 0, ":departure").otherwise(":")).alias("series_id"), F.col("user_id").alias("period"), F.col("ts").alias("vintage_date"), "value", about.alias("metadata"))


@query("""SELECT event_type, CASE WHEN user_id % 3 = 0 THEN 'student' ELSE event_type END AS category, CASE WHEN user_id % 3 = 0 THEN 'arrival' WHEN user_id % 5 > 0 THEN 'departure' END AS direction, count(*)::BIGINT AS n FROM events GROUP BY 1, 2, 3""")
def reenriched_flows(spark, sf_dir):
    rows = vintages.reenriched_flows(_stored(spark, sf_dir))
    return rows.groupBy(F.get(F.split("series_id", ":"), 1).alias("event_type"), "category", "direction").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT 'oad:' || event_type || CASE WHEN user_id % 5 > 0 THEN ':departure' ELSE ':' END AS series_id, user_id AS period, value, CASE WHEN user_id % 3 = 0 THEN 'student' ELSE 'total' END AS category, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC) AS r FROM events)
SELECT period, category, round(sum(value), 6) AS nom_truth FROM s WHERE r = 1 GROUP BY 1, 2""")
def latest_figures(spark, sf_dir):
    return scoring.latest_figures(_stored(spark, sf_dir)).withColumn("nom_truth", F.round("nom_truth", 6))


@query("""WITH l AS (SELECT DISTINCT url, unnest(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1)) AS link FROM pages),
a AS (SELECT CASE WHEN link LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || link ELSE link END AS link FROM l) SELECT DISTINCT link FROM a WHERE regexp_matches(link, '(?i)(the|to)(/|$)')""")
def sub_pages(spark, sf_dir):
    return web.sub_pages(web.links(read(spark, sf_dir, "pages")), ["the", "to"])


@query("""SELECT o_orderstatus AS status, o_orderpriority AS sheet, ((year(o_orderdate) - 1990) * 12 + month(o_orderdate))::INT AS row, 2 AS col, count(*)::VARCHAR AS text
FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL""")
def workbook_source(spark, sf_dir):
    """A workbook of months for each order status, a sheet for each priority; of all sheets two are read, and no other is unpacked."""
    o = read(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority", ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")).cast("int").alias("row")).agg(F.count(F.lit(1)).alias("n"))
    folder = fresh_folder(spark, "workbooks")
    workbooks.write(o.select(F.concat(F.lit("status-"), "o_orderstatus", F.lit(".xlsx")).alias("path"), F.col("o_orderpriority").alias("sheet"), "row", F.lit(2).alias("col"), F.col("n").cast("string").alias("text")), folder)
    cells = workbooks.read(spark, folder).where("sheet in ('1-URGENT', '5-LOW')")
    return cells.select(F.regexp_extract("path", r"status-(.)\.xlsx$", 1).alias("status"), "sheet", "row", "col", "text")


FIGURE_LABELS = {"1-URGENT": ("Net Overseas Migration ; A ;", "000", "A1"), "2-HIGH": ("Births ; A ;", "000", "A2"), "3-MEDIUM": ("net overseas  migration ; B", "Persons", None)}


@query("""WITH q AS (SELECT date_trunc('quarter', o_orderdate)::DATE AS period, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY 1, 2)
SELECT CASE p WHEN '1-URGENT' THEN 'A1' ELSE 'nom_col4' END AS series_id, period, 'quarter' AS period_unit, CASE p WHEN '1-URGENT' THEN n * 100.0 ELSE n END::DOUBLE AS value, 'total' AS category,
CASE WHEN (DATE '1998-06-30' - (period + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE) / 90.0 < 3 THEN 'preliminary' WHEN (DATE '1998-06-30' - (period + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE) / 90.0 < 6 THEN 'revised' ELSE 'final' END AS vintage_status, 'persons' AS unit,
CASE p WHEN '1-URGENT' THEN '{"file":"q.xlsx","sheet":"Data1","series":"Net Overseas Migration ; A ;","raw_unit":"000"}' ELSE '{"file":"q.xlsx","sheet":"Data1","series":"net overseas  migration ; B","raw_unit":"Persons"}' END AS metadata FROM q""")
def quarterly_figures(spark, sf_dir):
    """A time-series workbook beside one without the figure, through the dispatcher: yearly cubes can't be read, and nothing comes from the cache."""
    q = read(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin(list(FIGURE_LABELS))).groupBy(F.trunc("o_orderdate", "quarter").alias("q"), F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rows = _numbered(q, "q")
    columns = {p: k for k, p in enumerate(FIGURE_LABELS, 2)}
    heads = [("/in/q.xlsx", "Data1", row, columns[p], text) for p, (label, unit, name) in FIGURE_LABELS.items() for row, text in ((1, label), (2, unit), (10, name)) if text]
    end = F.datediff(F.date_sub(F.add_months("q", 3), 1), F.lit("1899-12-30").cast("date"))
    number = F.when(F.col("p") == "1-URGENT", F.round(F.col("n") / 10, 1)).otherwise(F.col("n").cast("double"))
    cells = _cells(
        _one(spark, heads + [("/in/q.xlsx", "Contents", 1, 2, "net overseas migration"), ("/in/x.xlsx", "Data1", 1, 2, "Deaths"), ("/in/q.xlsx", "Data1", 1, 1, "net overseas migration")]),
        _place(rows, F.col("n") + 10, 1, end, "Data1", "/in/q.xlsx"), _place(q.join(rows.withColumnRenamed("n", "r"), "q"), F.col("r") + 10, _mapped("p", columns), number, "Data1", "/in/q.xlsx"),
    )
    missing = lambda: spark.read.parquet(f"{sf_dir}/no-such-table.parquet")
    return parsers.figures(lambda: cells, "1998-06-30", annual=missing, cached=missing)
