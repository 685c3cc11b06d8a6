import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from tideline.operators import vintages
from tideline.operators.store import VintageStore
from tideline.sources import grids, parsers, web
from tideline.streaming import capture

D = dt.date.fromisoformat
#: Filter rows on top, a header, labels that stand for the rows below them, subtotals and a grand total.
GRID = [
    ["Filter", "All"], [], ["Applicant Type", "Sector", "2022-23", "2023-24", "2024-25"],
    ["Primary", "HE", "100", "110", "50"], [None, "VET", "80", "90", "40"], ["Primary Total", None, "180", "200", "90"],
    ["Secondary", "HE", "150", "152", "31"], ["Secondary Total", None, "150", "152", "31"], ["Grand Total", None, "330", "352", "121"],
]


def cells(spark):
    rows = [("s", r + 1, c + 1, t) for r, row in enumerate(GRID) for c, t in enumerate(row) if t is not None]
    return spark.createDataFrame(rows, "sheet string, row int, col int, text string")


def test_pivot(spark):
    rows = grids.melted(cells(spark), ["sheet"], 3, [1, 2])
    for lock, years in (("2025-09-30", {"2022-07-01": 330, "2023-07-01": 352, "2024-07-01": 121}), ("2024-12-31", {"2022-07-01": 330, "2023-07-01": 352})):
        got = grids.pivot_values(rows, ["c1", "c2"], lock).groupBy("period").agg(F.sum("value").alias("v")).collect()
        assert {str(r.period): r.v for r in got} == years
    values = grids.pivot_values(rows, ["c1", "c2"], "2025-09-30")
    assert {r.c1 for r in values.collect()} == {"Primary", "Secondary"}
    totals = spark.createDataFrame([(D("2022-07-01"), 330.0), (D("2023-07-01"), 400.0)], "period date, total double")
    assert [r.period for r in grids.reconciled(values, totals).collect()] == [D("2023-07-01")]


def test_header_row(spark):
    rows = [("s", k + 1, 1, t) for k, t in enumerate(["Title", "Jan-2020", "note", "Series ID", "Jan-2020", "Feb-2020", "Mar-2020"])]
    assert grids.header_row(spark.createDataFrame(rows, "sheet string, row int, col int, text string"), ["sheet"]).first().header == 4


def test_labelled_series(spark):
    rows = [("s", 1, 2, "Net overseas migration ;"), ("s", 1, 3, "Births"), ("s", 2, 2, "'000"), ("s", 11, 1, "Mar-2020"), ("s", 11, 2, "12.3455"), ("s", 11, 3, "9"), ("s", 12, 1, "Jun-2020"), ("s", 12, 2, "n/a"), ("s", 4, 2, "55")]
    got = grids.labelled_series(spark.createDataFrame(rows, "sheet string, row int, col int, text string"), ["sheet"], "(?i)net overseas").collect()
    assert [(str(r.period), r.value) for r in got] == [("2020-03-01", 12346.0)]


def test_workbook(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Head</t></si><si><r><t>two </t></r><r><t>parts</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>45292</v></c><c r="C3"/><c r="D3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    got = sorted(tuple(r)[1:] for r in grids.read_workbooks(spark, str(tmp_path / "*.xlsx")).collect())
    assert got == [("Data", 1, 1, "Head"), ("Data", 1, 28, "two parts"), ("Data", 3, 2, "45292"), ("Data", 3, 4, "in")]


def test_latest_resources(spark):
    names = [("Student", "u1", "student-granted-2024-08-31.xlsx"), ("Student", "u2", "student-granted-2025-08-31.xlsx"), ("Visitor", "u3", "visitor-granted.xlsx")]
    rows = spark.createDataFrame(names, "dataset_title string, url string, name string").withColumn("lock", web.lock_date("name"))
    assert {r.url for r in web.latest_resources(rows, ["dataset_title"]).collect()} == {"u2", "u3"}


def test_links_and_catalogue(spark):
    pages = spark.createDataFrame([("https://a.org/x?y", '<a class="k" href="/f.xlsx">f</a><a href="http://b.org/g.pdf">g</a><a href="/f.xlsx">f</a>')], "url string, html string")
    assert {r.link for r in web.links(pages).collect()} == {"https://a.org/f.xlsx", "http://b.org/g.pdf"}
    assert [r.link for r in web.links(pages, endings=[".xlsx"]).collect()] == ["https://a.org/f.xlsx"]
    body = '{"result":{"results":[{"title":"T","resources":[{"url":"u","format":"XLSX","name":"n"},{"url":"v"}]}]}}'
    got = web.catalogue(spark.createDataFrame([(body,), ("no json",)], "body string")).collect()
    assert [(r.dataset_title, r.url, r.format) for r in got] == [("T", "u", "XLSX"), ("T", "v", None)]


def test_cached_days(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-02-01", 2)], "asof string, v int")
    df.write.partitionBy("asof").parquet(str(tmp_path / "c"))
    assert [r.v for r in web.cached_days(spark, str(tmp_path / "c")).collect()] == [2]


def test_stream_capture_is_idempotent(spark, tmp_path):
    schema = "source string, series_id string, period date, vintage_date date, value double"
    land = str(tmp_path / "in")
    obs = lambda v, day: spark.createDataFrame([("s", "x", D("2024-01-01"), D(day), v)], schema)
    obs(1.0, "2024-02-01").write.mode("append").json(land)
    run = lambda: capture.capture(spark.readStream.schema(schema).json(land), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    run()
    obs(2.0, "2024-03-01").write.mode("append").json(land)
    obs(1.5, "2024-02-01").write.mode("append").json(land)
    run()
    got = {str(r.vintage_date): r.value for r in capture.latest(spark, str(tmp_path / "out")).collect()}
    assert got == {"2024-02-01": 1.5, "2024-03-01": 2.0}


def test_windows_of_a_stream(spark, tmp_path):
    land = str(tmp_path / "ev")
    spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 2.0), ("2024-01-09 00:00:00", "a", 9.0)], "ts string, event_type string, value double").write.json(land)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").json(land)
    q = capture.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.sql("select n from windows").collect()) == [1, 2]


def test_first_filled_and_together(spark, tmp_path):
    full, none = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([], "a int")
    broken = lambda: spark.read.parquet(str(tmp_path / "missing"))
    assert parsers.first_filled(broken, lambda: none, lambda: full).count() == 1
    with pytest.raises(ValueError, match="no source has rows"):
        parsers.first_filled(broken, lambda: none)
    assert parsers.together(lambda: full, broken, lambda: full.withColumnRenamed("a", "b")).columns == ["a", "b"]
    assert parsers.together(broken, lambda: none, otherwise=lambda: full).count() == 1
    with pytest.raises(ValueError):
        parsers.together(broken, otherwise=lambda: none)


def test_granted_resources_and_sub_pages(spark):
    rows = spark.createDataFrame([("XLSX", "Granted report", "u1"), ("xlsx", None, "http://a/granted-1.xlsx"), ("csv", "granted", "u3"), ("xlsx", "lodged", "u4"), (None, "granted", "u5")], "format string, name string, url string")
    assert {r.url for r in web.granted(rows).collect()} == {"u1", "http://a/granted-1.xlsx"}
    found = spark.createDataFrame([("u", "http://a/study/"), ("u", "http://a/study"), ("u", "http://a/studying"), ("u", "http://a/work/x")], "url string, link string")
    assert {r.link for r in web.sub_pages(found, ["study", "work"]).collect()} == {"http://a/study/", "http://a/study", "http://a/work/x"}
    assert web.sub_pages(found, []).count() == 0


def test_parsers_of_odd_sheets(spark):
    cells = lambda rows: spark.createDataFrame([("/x/f.xlsx", *r) for r in rows], "path string, sheet string, row int, col int, text string")
    empty = cells([])
    files = spark.createDataFrame([("/x/f.xlsx", "Student", None)], "path string, title string, lock date")
    for out in (parsers.movement_cubes(empty, "arrival"), parsers.annual_cubes(empty, "2024-01-01"), parsers.pivot_tables(empty, files), parsers.aggregate_tables(empty, [("arrival", "A", "x")])):
        assert out.count() == 0
    # one label column, quarters as heads, a secondary header, no lock day
    pivot = cells([("Lodged", 3, 1, "Citizenship"), ("Lodged", 3, 2, "2023-24 Q2"), ("Lodged", 3, 3, "note"), ("Lodged", 4, 1, "A"), ("Lodged", 4, 2, "5"), ("Lodged", 5, 1, "Sub Total"), ("Lodged", 5, 2, "5"), ("Lodged", 6, 1, "B"), ("Lodged", 6, 2, "x")])
    got = parsers.pivot_tables(pivot, files).collect()
    assert [(r.series_id, str(r.period), r.period_unit, r.value) for r in got] == [("dha_grants:student:A", "2023-10-01", "quarter", 5.0)]
    assert {r.sheet for r in parsers.pivot_sheets(cells([("Overview", 1, 1, "a"), ("Data", 1, 1, "b")])).collect()} == {"Data"}
    assert parsers.stock_table(spark.createDataFrame([(1,)], "nothing int")).count() == 0
    stock = parsers.stock_table(spark.createDataFrame([("2024-05", "7"), ("2024-07-15", "x"), ("bad", "1"), ("2024-10", "2")], "period string, count string"), "f.csv").collect()
    assert sorted((str(r.period), r.period_unit, r.value, r.series_id) for r in stock) == [("2024-05-01", "month", 7.0, "twh:total"), ("2024-10-01", "quarter", 2.0, "twh:total")]


def test_history_from_csv_in_one_write(spark, tmp_path):
    (tmp_path / "h.csv").write_text("source,series_id,period,period_unit,vintage_date,value\nnom,nom:total,2024-01-01,quarter,2024-05-01,5\nnom,nom:total,2024-01-01,quarter,2024-06-01,6\noad,oad:student:arrival,2024-01-01,month,2024-06-01,7\nnom,nom:total,2023-01-01,quarter,2019-06-01,1\n")
    store = VintageStore(spark, str(tmp_path / "store"))
    assert store.load_history(vintages.read_history(spark, str(tmp_path / "h.csv"), "2020-01-01")) == 3
    assert [(r.value, r.metadata) for r in store.read_as_of("nom", "2024-05-15").collect()] == [(5.0, None)] and [r.value for r in store.read_as_of("nom").collect()] == [6.0]
    assert store.write("nom", spark.createDataFrame([("nom:total", "2024-01-01", "quarter", 9.0)], "series_id string, period string, period_unit string, value double"), "2024-06-01") == 1
    assert [r.value for r in store.read_as_of("nom").collect()] == [9.0] and [r.value for r in store.read_as_of("oad").collect()] == [7.0]
    with pytest.raises(ValueError):
        store.load_history(spark.createDataFrame([(1,)], "value int"))
    flows = vintages.reenriched_flows(store.read_as_of("oad")).collect()
    assert [(r.category, r.direction) for r in flows] == [("student", "arrival")]
    assert [r.category for r in vintages.reenriched_figures(store.read_as_of("nom")).collect()] == ["total"]
    grants = spark.createDataFrame([("dha:500 x", None, 1.0), ("dha:", None, 2.0)], "series_id string, metadata string, value double")
    assert [r.category for r in vintages.reenriched_grants(grants).orderBy("value").collect()] == ["student", None]


def test_flow_and_figure_dispatchers(spark):
    """Unreadable sources add nothing, what was cached stands in for all of them, and without any rows the job stops."""
    none = spark.createDataFrame([], grids.CELLS)
    missing = lambda: spark.read.parquet("/tmp/no-such-folder-of-cells")
    cached = spark.createDataFrame([("oad:student:arrival", 1.0)], "series_id string, value double")
    assert [r.value for r in parsers.flows({"arrival": missing, "departure": lambda: none}, missing, cached=lambda: cached).collect()] == [1.0]
    with pytest.raises(ValueError):
        parsers.flows({"arrival": lambda: none, "departure": missing})
    with pytest.raises(ValueError):
        parsers.figures(missing, "2024-01-01")
    assert [r.value for r in parsers.figures(lambda: none, "2024-01-01", cached=lambda: cached).collect()] == [1.0]
    rows = [("/a/q.xlsx", "data 2", 1, 2, "Net overseas migration"), ("/a/q.xlsx", "Data 1", 1, 3, "Net overseas migration ; x"), ("/a/q.xlsx", "Data 1", 11, 1, "45382"), ("/a/q.xlsx", "Data 1", 11, 3, "7.5"), ("/a/q.xlsx", "Data 1", 12, 3, "8")]
    got = parsers.figures(lambda: spark.createDataFrame(rows, grids.CELLS), "2024-05-01").collect()
    assert [(r.series_id, str(r.period), r.value, r.vintage_status) for r in got] == [("nom_col3", "2024-01-01", 8.0, "preliminary")]
