"""Spreadsheet grids as rows of cells (sheet, row, col, text), and what is read from them: header rows, filled-down columns, pivots.

.xlsx workbooks are read by Spark as binary files and unpacked in the tasks; a workbook is a zip of XML parts, so the standard library is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import label_unit, month_label, period_label
from ..operators.staging import staged

CELLS = "path string, sheet string, row int, col int, text string"


MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def workbook_sheets(book) -> dict[str, str]:
    """The part of each sheet of an open zip file, by the sheet's name, in order."""
    from xml.etree import ElementTree

    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    parts = {sheet.get("name"): targets[sheet.get(link)] for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")}
    return {name: part if part.startswith("xl/") else f"xl/{part}" for name, part in parts.items()}


def workbook_cells(content, only: str | None = None) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of each filled cell of an .xlsx workbook (bytes, or a file to seek in), or of one sheet, whose part alone is read; rows and columns count from 1."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as book:
        words = []
        if "xl/sharedStrings.xml" in set(book.namelist()):
            words = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        for sheet, part in workbook_sheets(book).items():
            if only is not None and sheet != only:
                continue
            for cell in ElementTree.fromstring(book.read(part)).iter(f"{MAIN}c"):
                value, kind = cell.find(f"{MAIN}v"), cell.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                elif value is None or value.text is None:
                    continue
                else:
                    text = words[int(value.text)] if kind == "s" else value.text
                letters, number = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                col = 0
                for c in letters:
                    col = col * 26 + ord(c) - 64
                yield sheet, int(number), col, text


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all workbooks under a path, a task for each few files. They are written once, since parsers read them in several branches and unpacking is the dear part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [(name, *cell) for cell in workbook_cells(content)]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["path", "sheet", "row", "col", "text"])

    return staged(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CELLS), "cells")


def header_row(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, header: the row before the first run of three dates in column 1 (the first row at least)."""
    w = Window.partitionBy(*keys).orderBy("row")
    first = cells.where("col = 1").withColumn("is_date", month_label("text").isNotNull())
    run = first.withColumn("_run", F.col("is_date") & F.lead("is_date", 1, False).over(w) & F.lead("is_date", 2, False).over(w)).where("_run")
    return run.groupBy(*keys).agg(F.greatest(F.min("row") - 1, F.lit(1)).alias("header"))


def filled_down(cells: DataFrame, keys: list[str], columns: list[int]) -> DataFrame:
    """keys, row, c1, c2, ..: these columns by row, each blank taking the last text above it. The rows of a sheet stay together."""
    wide = cells.groupBy(*keys, "row").pivot("col", columns).agg(F.first("text"))
    w = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return wide.select(*keys, "row", *(F.last(F.when(F.trim(F.col(str(c))) != "", F.col(str(c))), True).over(w).alias(f"c{c}") for c in columns))


def melted(cells: DataFrame, keys: list[str], header: int, label_columns: list[int]) -> DataFrame:
    """keys, row, labels c1.., head, text: every filled cell right of the label columns and below the header row, with its column's head."""
    heads = cells.where((F.col("row") == header) & ~F.col("col").isin(label_columns)).select(*keys, "col", F.trim("text").alias("head"))
    body = cells.where((F.col("row") > header) & ~F.col("col").isin(label_columns)).select(*keys, "row", "col", "text")
    names = filled_down(cells.where(F.col("row") > header), keys, label_columns)
    return body.join(heads, [*keys, "col"]).join(names, [*keys, "row"]).drop("col")


def pivot_values(rows: DataFrame, label_columns: list[str], lock=None) -> DataFrame:
    """labels, period, period_unit, value of a melted pivot table: totals and subtotals left out, and financial years not over on the lock day."""
    total = None
    for c in label_columns:
        hit = F.coalesce(F.col(c).rlike(r"(?i)\btotal\b"), F.lit(False))
        total = hit if total is None else total | hit
    out = rows.where(~total).withColumns({"period": period_label(F.col("head")), "period_unit": label_unit(F.col("head")), "value": F.regexp_replace("text", ",", "").try_cast("double")})
    out = out.where("period is not null and value is not null")
    if lock is not None:
        ends = F.date_sub(F.add_months("period", 12), 1)
        out = out.where(~((F.col("period_unit") == "year") & (ends > F.lit(lock).cast("date"))))
    return out.groupBy(*label_columns, "period", "period_unit").agg(F.sum("value").alias("value"))


def reconciled(values: DataFrame, totals: DataFrame, limit: float = 0.01) -> DataFrame:
    """period, total, parts: periods whose parts differ from the published total by more than limit of it."""
    parts = values.groupBy("period").agg(F.sum("value").alias("parts"))
    return totals.join(parts, "period").where(F.abs(F.col("parts") - F.col("total")) > limit * F.abs("total")).select("period", "total", "parts")


def labelled_series(cells: DataFrame, keys: list[str], pattern: str, label_row: int = 1, unit_row: int = 2, first_row: int = 11) -> DataFrame:
    """keys, label, period, value: the columns whose label matches, by the months in column 1. Columns in thousands ('000) are scaled and rounded half to even."""
    heads = cells.where((F.col("row") == label_row) & F.col("text").rlike(pattern)).select(*keys, "col", F.col("text").alias("label"))
    units = cells.where((F.col("row") == unit_row) & F.trim("text").contains("000")).select(*keys, "col", F.lit(1000.0).alias("_scale"))
    columns = heads.join(units, [*keys, "col"], "left")
    dates = cells.where((F.col("col") == 1) & (F.col("row") >= first_row)).select(*keys, "row", month_label("text").alias("period"))
    body = cells.where(F.col("row") >= first_row).select(*keys, "row", "col", F.col("text").try_cast("double").alias("value"))
    value = F.when(F.col("_scale").isNotNull(), F.bround(F.col("value") * F.col("_scale"))).otherwise(F.col("value"))
    return body.join(columns, [*keys, "col"]).join(dates, [*keys, "row"]).where("period is not null and value is not null").select(*keys, "label", "period", value.alias("value"))
