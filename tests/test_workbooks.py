import os
import time

from pyspark.sql import functions as F

from tideline.sources import grids, workbooks

BOOK = [("Data1", 1, 1, "head & <tail>"), ("Data1", 2, 28, " spaced "), ("Data1", 2, 1, "7"), ("Other", 1, 1, "x"), ("Z \"q\"", 3, 2, "ü")]


def test_round_trip_of_a_workbook():
    body = workbooks.workbook(BOOK)
    assert sorted(grids.workbook_cells(body)) == sorted(BOOK)
    assert list(grids.workbook_cells(body, "Other")) == [("Other", 1, 1, "x")] and list(grids.workbook_cells(body, "none")) == []
    assert [workbooks._letters(c) for c in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_a_partition_for_each_sheet_and_filters_reach_it(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.xlsx").write_bytes(workbooks.workbook(BOOK))
    (tmp_path / "in" / "deep" / "b.XLSX").write_bytes(workbooks.workbook([("Data1", 1, 1, "b")]))
    (tmp_path / "in" / "~a.xlsx").write_bytes(b"no workbook")
    (tmp_path / "in" / "c.txt").write_text("no workbook")
    cells = workbooks.read(spark, str(tmp_path / "in"))
    assert sorted((os.path.basename(r.path), r.sheet, r.row, r.col, r.text) for r in cells.collect()) == sorted([("a.xlsx", *c) for c in BOOK] + [("b.XLSX", "Data1", 1, 1, "b")])
    assert cells.rdd.getNumPartitions() == 4
    one = cells.where("sheet = 'Data1' and row = 1")
    assert sorted(r.text for r in one.collect()) == ["b", "head & <tail>"] and one.rdd.getNumPartitions() == 2
    assert cells.where(F.col("sheet").isin("Other", "Data1")).rdd.getNumPartitions() == 3 and cells.where("sheet = 'none'").count() == 0
    (tmp_path / "empty").mkdir()
    assert workbooks.read(spark, str(tmp_path / "empty")).count() == 0


def test_written_workbooks(spark, tmp_path):
    cells = spark.createDataFrame([("a.xlsx", *BOOK[0]), ("b.xlsx", *BOOK[3]), ("b.xlsx", "S", 1, 1, None)], "path string, sheet string, row int, col int, text string")
    target = f"file://{tmp_path}/out"
    assert workbooks.write(cells, target) == [f"{target}/a.xlsx", f"{target}/b.xlsx"]
    assert {(r.path, r.text) for r in workbooks.read(spark, target).collect()} == {(f"{target}/a.xlsx", "head & <tail>"), (f"{target}/b.xlsx", "x")}


def test_a_stream_takes_each_file_once(spark, tmp_path):
    workbooks.register(spark)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def put(name, text):
        (tmp_path / name).write_bytes(workbooks.workbook([("S", 1, 1, text)]))
        os.rename(tmp_path / name, source / name)

    def run():
        query = spark.readStream.format("workbook").load(str(source)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start(out)
        query.awaitTermination(60)
        return sorted(r.text for r in spark.read.schema(grids.CELLS).parquet(out).collect())

    put("b.xlsx", "one")
    assert run() == ["one"]
    time.sleep(0.05)
    put("a.xlsx", "two")
    put("c.xlsx", "three")
    assert run() == ["one", "three", "two"] == run()
