"""Workbooks (.xlsx) as a data source of Spark: a partition for each file and sheet, filters on sheets pushed down, and a stream of new files.

spark.read.format("workbook").load(folder) and spark.readStream.format("workbook").load(folder), after register(spark). Columns: path, sheet, row, col, text.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from .grids import CELLS, workbook_cells, workbook_sheets

ARROW = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string())])
#: Cells that are handed to Spark at once.
BATCH = 50_000


def _files(folder: str) -> list[tuple[int, str]]:
    """(time of the last change, path) of the workbooks under a folder, or of the one file, in order."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    head = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
    there = store.get_file_info(base)
    found = [there] if there.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((i.mtime_ns or 0, head + i.path) for i in found if i.type == fs.FileType.File and i.path.lower().endswith(".xlsx") and not i.base_name.startswith(("_", ".", "~")))


def _opened(path: str):
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


class Sheet(InputPartition):
    """One sheet of one file; without a name all of them."""

    def __init__(self, path: str, sheet: str | None):
        self.path, self.sheet = path, sheet


def _cells(part: Sheet | None) -> Iterator[pa.RecordBatch]:
    """The cells of a partition; Spark asks for None where there are none."""
    held: list[tuple] = []
    if part is None:
        return
    with _opened(part.path) as f:
        for cell in workbook_cells(f, part.sheet):
            held.append((part.path, *cell))
            if len(held) == BATCH:
                yield _batch(held)
                held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class WorkbookReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.wanted = folder, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equalities and lists on the sheet's name choose partitions; other filters stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("sheet",):
                names = {f.value}
            elif isinstance(f, In) and f.attribute == ("sheet",):
                names = set(f.value)
            else:
                yield f
                continue
            self.wanted = names if self.wanted is None else self.wanted & names

    def partitions(self) -> list[Sheet]:
        """Of each file only the list of its sheets is read here."""
        out = []
        for _, path in _files(self.folder):
            with _opened(path) as f, zipfile.ZipFile(f) as book:
                out += [Sheet(path, s) for s in workbook_sheets(book) if self.wanted is None or s in self.wanted]
        return out

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        return _cells(partition)


class WorkbookStream(DataSourceStreamReader):
    """New files in the order of their times and paths. A file must be moved into the folder whole, with a later time than those before it; one that is changed later comes again."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        files = _files(self.folder)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Sheet]:
        after, last = (start["time"], start["path"]), (end["time"], end["path"])
        return [Sheet(path, None) for time, path in _files(self.folder) if after < (time, path) <= last]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        return _cells(partition)

    def commit(self, end: dict) -> None:
        pass


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"])

    def streamReader(self, schema) -> WorkbookStream:
        return WorkbookStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Workbooks)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of all workbooks under a folder (or of one file) of shared storage that pyarrow reaches."""
    register(spark)
    return spark.read.format("workbook").load(folder)


def _letters(col: int) -> str:
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def workbook(cells: list[tuple[str, int, int, str]]) -> bytes:
    """An .xlsx file of cells (sheet, row, column, text) as inline strings; sheets in the order of their names."""
    sheets: dict[str, dict[int, list]] = {}
    for sheet, row, col, text in sorted(cells):
        sheets.setdefault(sheet, {}).setdefault(row, []).append((col, text))
    out, ns = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{office}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="r{i}"/>' for i, s in enumerate(sheets, 1)) + "</sheets></workbook>")
        links = "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            lines = "".join(f'<row r="{r}">' + "".join(f'<c r="{_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(t)}</t></is></c>' for c, t in found) + "</row>" for r, found in sorted(rows.items()))
            book.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{lines}</sheetData></worksheet>")
    return out.getvalue()


def write(cells: DataFrame, folder: str) -> list[str]:
    """Writes a workbook for each path (a file's name) of cells: path, sheet, row, col, text. A task holds the cells of one file. Returns the paths."""

    def run(group: pa.Table) -> pa.Table:
        from pyarrow import fs

        name = group.column("path")[0].as_py()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        body = workbook(list(zip(*(group.column(c).to_pylist() for c in ("sheet", "row", "col", "text")), strict=True)))
        # whole under another name first: a repeated task puts the same file in its place
        draft = f"{base}/_{name}-{id(group)}"
        with store.open_output_stream(draft) as f:
            f.write(body)
        store.move(draft, f"{base}/{name}")
        return pa.table({"path": [f"{folder}/{name}"]})

    rows = cells.where(F.col("text").isNotNull()).select("path", "sheet", F.col("row").cast("int"), F.col("col").cast("int"), "text")
    return sorted(r[0] for r in rows.groupBy("path").applyInArrow(run, "path string").collect())
