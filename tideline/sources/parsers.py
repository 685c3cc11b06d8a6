"""Whole parsers: cells of workbooks (path, sheet, row, col, text) to observations.

A parser is one plan over all workbooks together; every step is keyed by sheet, so that sheets of different shapes are read side by side.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels
from ..functions.calendar import excel_date, label_unit, month_label, month_start, period_label, quarter_start, vintage_status
from .grids import header_row
from .tables import stock_unit

SHEET = ["path", "sheet"]
OBSERVATION = ["series_id", "period", "period_unit", "value", "category", "direction", "unit", "metadata"]
# Layouts of the published files.
AGGREGATE_SHEET, LABEL_ROW, ID_ROW, FIRST_ROW = "Data1", 1, 10, 11
ANNUAL_SHEET, ANNUAL_HEADER_ROWS = r"4\.9$|(?i:australia)", 30
PIVOT_SHEETS = [r"(?i)^granted", r"(?i)granted", r"(?i)grants?", r"(?i)lodged"]
PIVOT_OTHER = r"(?i)overview|note|explanat|gloss|filter|cover|terminol|item"
PIVOT_HEADER_ROWS, PIVOT_DIMENSIONS = 40, 3
PIVOT_PERIOD = r"^\d{4}(-\d{2})?(\s*Q[1-4])?$"
STOCK_DATE, STOCK_VALUE, STOCK_LABEL = r"(?i)date|period|month|quarter|as.at", r"(?i)count|number|persons|total", r"(?i)subclass|visa|category"


def _file(path: str = "path") -> Column:
    return F.regexp_extract(F.col(path), r"([^/]*)$", 1)


def _number(text: str = "text") -> Column:
    return F.trim(text).try_cast("double")


def _first_row(hits: DataFrame) -> DataFrame:
    """path, sheet, header: the first row of each sheet that is a hit."""
    return hits.groupBy(*SHEET).agg(F.min("row").alias("header"))


def aggregate_tables(cells: DataFrame, specs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Totals by month: for each spec (direction, series id, pattern of the label) the column with that id, else the first one whose label matches.

    A workbook without the column adds no rows; months are serial numbers from row 11 on.
    """
    data = cells.where(F.col("sheet") == AGGREGATE_SHEET)
    heads = data.where(F.col("row").isin(LABEL_ROW, ID_ROW)).groupBy(*SHEET, "col").agg(
        F.first(F.when(F.col("row") == LABEL_ROW, F.col("text")), True).alias("label"), F.first(F.when(F.col("row") == ID_ROW, F.col("text")), True).alias("id"))
    wanted = F.array(*(F.struct(F.lit(d).alias("direction"), F.lit(i).alias("want"), F.lit(p).alias("pattern")) for d, i, p in specs))
    by_id, by_label = F.col("id") == F.col("want"), F.regexp_like("label", F.col("pattern"))
    found = heads.select("*", F.inline(wanted)).withColumn("rank", F.when(by_id, 0).when(by_label, 1)).where("rank is not null")
    columns = found.groupBy(*SHEET, "direction").agg(F.min_by(F.struct("col", "id", "label"), F.struct("rank", "col")).alias("c")).select(*SHEET, "direction", "c.*")
    months = data.where((F.col("col") == 1) & (F.col("row") >= FIRST_ROW)).select(*SHEET, "row", month_start(excel_date(_number())).alias("period"))
    values = data.where(F.col("row") >= FIRST_ROW).select(*SHEET, "row", "col", _number().alias("value"))
    out = values.join(columns, [*SHEET, "col"]).join(months, [*SHEET, "row"]).where("period is not null and value is not null")
    about = F.to_json(F.struct(_file().alias("file"), "sheet", F.col("id").alias("abs_series_id"), F.col("label").alias("series")))
    return out.select(F.concat(F.lit("oad_lt:"), "direction", F.lit(":total")).alias("series_id"), "period", F.lit("month").alias("period_unit"), "value", F.lit("total").alias("category"), "direction", F.lit("persons").alias("unit"), about.alias("metadata"))


def movement_cubes(cells: DataFrame, direction: str) -> DataFrame:
    """Flows by visa group and month: the header stands before the first run of months in column 1; columns without a name or a category, and totals, are left out."""
    known = cells.join(header_row(cells, SHEET), SHEET)
    heads = known.where((F.col("row") == F.col("header")) & (F.col("col") > 1)).select(*SHEET, "col", F.trim("text").alias("label"))
    heads = heads.where((F.col("label") != "") & ~F.col("label").rlike("^[Tt]otal")).withColumn("category", labels.visa_group("label")).where("category is not null")
    body = known.where(F.col("row") > F.col("header"))
    months = body.where("col = 1").select(*SHEET, "row", month_label("text").alias("period"))
    values = body.where("col > 1").select(*SHEET, "row", "col", _number().alias("value"))
    out = values.join(heads, [*SHEET, "col"]).join(months, [*SHEET, "row"]).where("period is not null and value is not null")
    about = F.to_json(F.struct(_file().alias("file"), "sheet", F.col("label").alias("visa_group")))
    return out.select(F.concat(F.lit("oad:"), "category", F.lit(f":{direction}")).alias("series_id"), "period", F.lit("month").alias("period_unit"), "value", "category", F.lit(direction).alias("direction"), F.lit("persons").alias("unit"), about.alias("metadata"))


def _filled(body: DataFrame, columns: dict[str, Column], keys: list[str]) -> DataFrame:
    """keys, row and the named columns by row, each blank taking the last text above it in its sheet."""
    wide = body.groupBy(*keys, "row").agg(*(F.first(F.when(hit & (F.trim("text") != ""), F.col("text")), True).alias(name) for name, hit in columns.items()))
    w = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return wide.select(*keys, "row", *(F.last(c, True).over(w).alias(c) for c in columns))


# Where quarterly figures stand.
FIGURE_SHEET, FIGURE_LABEL, UNIT_ROW = "(?i)^data", r"(?i)net\s*overseas\s*migration", 2


def quarterly_figures(cells: DataFrame, asof) -> DataFrame:
    """Quarterly figures of time-series workbooks: series_id, period, period_unit, value, category (total), vintage_status, unit, metadata.

    The first sheet by name that begins with Data, else the first of all; the columns (but the first) whose label in row 1 names the figure, with the id in row 10 (nom_col and the column's number where there is none) and
    the unit in row 2: thousands are scaled and rounded half to even. Periods are serial numbers in column 1 from row 11 on; the status goes by their age on the day asof. Workbooks without such columns add no rows.
    """
    order = F.struct(F.when(F.col("sheet").rlike(FIGURE_SHEET), 0).otherwise(1), F.col("sheet"))
    data = cells.join(cells.groupBy("path").agg(F.min_by("sheet", order).alias("sheet")), SHEET, "left_semi")
    text = lambda row: F.first(F.when(F.col("row") == row, F.col("text")), True)
    heads = data.where(F.col("row").isin(LABEL_ROW, UNIT_ROW, ID_ROW) & (F.col("col") > 1)).groupBy(*SHEET, "col").agg(text(LABEL_ROW).alias("label"), text(UNIT_ROW).alias("raw_unit"), text(ID_ROW).alias("id"))
    columns = heads.where(F.col("label").rlike(FIGURE_LABEL))
    days = data.where((F.col("col") == 1) & (F.col("row") >= FIRST_ROW)).select(*SHEET, "row", excel_date(_number()).alias("day"))
    values = data.where(F.col("row") >= FIRST_ROW).select(*SHEET, "row", "col", _number().alias("v"))
    out = values.join(columns, [*SHEET, "col"]).join(days, [*SHEET, "row"]).where("day is not null and v is not null")
    value = F.bround(F.col("v") * F.when(F.contains("raw_unit", F.lit("000")), 1000.0).otherwise(1.0))
    about = F.to_json(F.struct(_file().alias("file"), "sheet", F.col("label").alias("series"), "raw_unit"))
    return out.select(F.coalesce("id", F.concat(F.lit("nom_col"), "col")).alias("series_id"), quarter_start("day").alias("period"), F.lit("quarter").alias("period_unit"), value.alias("value"), F.lit("total").alias("category"), vintage_status("day", F.lit(asof).cast("date")).alias("vintage_status"), F.lit("persons").alias("unit"), about.alias("metadata"))


def figures(quarterly: Callable[[], DataFrame], asof, annual: Callable[[], DataFrame] | None = None, cached: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Published figures: of the quarterly workbooks' cells and, if asked for, those of the yearly cubes; where neither has rows, what was cached. A source that can't be read adds nothing."""
    readers = [lambda: quarterly_figures(quarterly(), asof)]
    if annual is not None:
        readers.append(lambda: annual_cubes(annual(), asof))
    return together(*readers, otherwise=cached)


def flows(cubes: dict[str, Callable[[], DataFrame]], totals: Callable[[], DataFrame] | None = None, specs: Sequence[tuple[str, str, str]] = (), cached: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Movements: the cubes of each direction and the table of totals, together; where none has rows, what was cached, and else ValueError, so that no job goes on with nothing."""
    readers = [lambda d=direction, cells=cells: movement_cubes(cells(), d) for direction, cells in cubes.items()]
    if totals is not None:
        readers.append(lambda: aggregate_tables(totals(), specs))
    found = together(*readers, otherwise=cached)
    return first_filled(lambda: found)


def annual_cubes(cells: DataFrame, asof) -> DataFrame:
    """Yearly figures by visa group: series_id, period, period_unit, value, category, direction, vintage_status, unit, metadata.

    The national sheet, by its name; a header (Direction in column 1 or Visa Group in column 2) within 30 rows; directions filled down, visa groups as they stand.
    A sheet without a header, and rows without a direction or a category, are left out.
    """
    national = cells.where(F.col("sheet").rlike(ANNUAL_SHEET)).groupBy("path").agg(F.min("sheet").alias("sheet"))
    data = cells.join(national, SHEET, "left_semi")
    hit = ((F.col("col") == 1) & F.col("text").rlike("(?i)^direction")) | ((F.col("col") == 2) & F.col("text").rlike("(?i)visa.*group"))
    known = data.join(_first_row(data.where(hit & (F.col("row") <= ANNUAL_HEADER_ROWS))), SHEET)
    years = known.where((F.col("row") == F.col("header")) & F.trim("text").rlike(r"^\d{4}-\d{2}$")).select(*SHEET, "col", period_label(F.trim("text")).alias("period"))
    body = known.where(F.col("row") > F.col("header"))
    named = body.where((F.col("col") <= 2) & (F.trim("text") != ""))
    sides = _filled(named, {"side": F.col("col") == 1}, SHEET)
    groups = named.where("col = 2").select(*SHEET, "row", F.col("text").alias("visa_group"))
    side = F.when(F.col("side").rlike("(?i)arriv"), "arrival").when(F.col("side").rlike("(?i)depart"), "departure").when(F.col("side").rlike("(?i)net"), "net")
    values = body.select(*SHEET, "row", "col", _number().alias("value")).where("value is not null")
    rows = values.join(years, [*SHEET, "col"]).join(sides, [*SHEET, "row"]).join(groups, [*SHEET, "row"]).withColumns({"direction": side, "category": labels.visa_group("visa_group")})
    out = rows.where("direction is not null and category is not null and period is not null").withColumn("vintage_status", vintage_status("period", F.lit(asof).cast("date")))
    by = out.groupBy("path", "period", "category", "direction", "vintage_status").agg(F.sum("value").alias("value"))
    return by.select(F.concat(F.lit("nom_annual:"), "category", F.lit(":"), "direction").alias("series_id"), "period", F.lit("year").alias("period_unit"), "value", "category", "direction", "vintage_status", F.lit("persons").alias("unit"), F.to_json(F.struct(_file().alias("file"))).alias("metadata"))


def pivot_sheets(cells: DataFrame) -> DataFrame:
    """The cells of each workbook's data sheet: granted before lodged before any that is not about the data."""
    rank = F.lit(len(PIVOT_SHEETS) + 1)
    rank = F.when(~F.col("sheet").rlike(PIVOT_OTHER), len(PIVOT_SHEETS)).otherwise(rank)
    for k, pattern in reversed(list(enumerate(PIVOT_SHEETS))):
        rank = F.when(F.col("sheet").rlike(pattern), k).otherwise(rank)
    best = cells.select(*SHEET).distinct().groupBy("path").agg(F.min(F.struct(rank.alias("rank"), "sheet")).alias("b")).select("path", F.col("b.sheet").alias("sheet"))
    return cells.join(best, SHEET, "left_semi")


def pivot_headers(cells: DataFrame) -> DataFrame:
    """path, sheet, header: of the first 40 rows the first with Applicant Type in column 1, else one with a visa type or citizenship; rows that show a filter, "(All)", are none."""
    first = cells.where((F.col("row") <= PIVOT_HEADER_ROWS) & (F.col("col") <= 2)).groupBy(*SHEET, "row").agg(*(F.first(F.when(F.col("col") == k, F.col("text")), True).alias(f"t{k}") for k in (1, 2)))
    filtered = F.coalesce(F.col("t2").rlike(r"^\s*\(All\)\s*$"), F.lit(False))
    rank = F.when(F.col("t1").rlike(r"(?i)^\s*Applicant\s*Type\s*$") & ~filtered, 0).when(F.col("t1").rlike("(?i)Visa Subclass|Visa Type|Citizenship") & F.col("t2").isNotNull() & ~filtered, 1)
    best = first.withColumn("rank", rank).where("rank is not null").groupBy(*SHEET).agg(F.min(F.struct("rank", "row")).alias("b"))
    return best.select(*SHEET, F.col("b.row").alias("header"))


def pivot_tables(cells: DataFrame, files: DataFrame) -> DataFrame:
    """Grants from pivot tables: series_id, period, period_unit, value, category, unit, metadata. files: path, title of the data set, lock (the day of its cut-off, or null).

    Up to three label columns are filled down before totals go; years that were not over on the lock day go too. Workbooks without a header or a category add no rows.
    """
    data = pivot_sheets(cells)
    known = data.join(pivot_headers(data), SHEET)
    heads = known.where((F.col("row") == F.col("header")) & (F.trim("text") != "")).select(*SHEET, "col", F.trim("text").alias("head"))
    dims = heads.where(~F.col("head").rlike(r"^\d{4}")).withColumn("dim", F.row_number().over(Window.partitionBy(*SHEET).orderBy("col"))).where(F.col("dim") <= PIVOT_DIMENSIONS).select(*SHEET, "col", "dim")
    periods = heads.where(F.col("head").rlike(PIVOT_PERIOD)).select(*SHEET, "col", "head", period_label("head").alias("period"), label_unit("head").alias("period_unit"))
    body = known.where(F.col("row") > F.col("header")).join(dims, [*SHEET, "col"], "left")
    names = ["applicant", "sector", "stream"]
    rows = _filled(body, {n: F.coalesce(F.col("dim") == k + 1, F.lit(False)) for k, n in enumerate(names)}, SHEET)
    total = F.lit(False)
    for n in names:
        total = total | F.coalesce(F.col(n).rlike("(?i)total"), F.lit(False))
    leaves = rows.where(~total & F.col("applicant").isNotNull())
    values = body.where("dim is null").select(*SHEET, "row", "col", _number().alias("value")).where("value is not null")
    out = values.join(periods, [*SHEET, "col"]).join(leaves, [*SHEET, "row"]).join(files, "path").withColumn("category", labels.dataset("title"))
    partial = (F.col("period_unit") == "year") & (F.date_sub(F.add_months("period", 12), 1) > F.col("lock"))
    out = out.where("period is not null and category is not null").where(~F.coalesce(partial, F.lit(False)))
    about = F.to_json(F.struct(F.col("title").alias("dataset"), _file().alias("file"), *names))
    by = out.withColumn("metadata", about).groupBy("category", "applicant", "period", "period_unit", "metadata").agg(F.sum("value").alias("value"))
    return by.select(F.concat(F.lit("dha_grants:"), "category", F.lit(":"), "applicant").alias("series_id"), "period", "period_unit", "value", "category", F.lit("persons").alias("unit"), "metadata")


def stock_table(df: DataFrame, file: str = "") -> DataFrame:
    """Numbers of holders from a table whose columns are known by their names: a date, a count, and a visa where there is one (else total). Without a date or a count: no rows."""
    pick = lambda pattern: next((F.col(f"`{c}`") for c in df.columns if re.search(pattern, c)), None)
    date, count, label = pick(STOCK_DATE), pick(STOCK_VALUE), pick(STOCK_LABEL)
    if date is None or count is None:
        date = count = F.lit(None).cast("string")
    text = date.cast("string")
    subclass = F.lit("total") if label is None else label.cast("string")
    rows = df.select(F.coalesce(month_label(text), period_label(text)).alias("period"), count.cast("string").try_cast("double").alias("value"), subclass.alias("subclass")).where("period is not null and value is not null")
    about = F.to_json(F.struct(F.lit(file).alias("file"), "subclass"))
    return rows.select(F.concat(F.lit("twh:"), "subclass").alias("series_id"), "period", stock_unit("period").alias("period_unit"), "value", labels.subclass("subclass").alias("category"), F.lit("persons").alias("unit"), about.alias("metadata"))


def first_filled(*readers: Callable[[], DataFrame]) -> DataFrame:
    """What the first reader that has rows gives; one that fails to read counts as empty. None has rows: ValueError, so that no job goes on with nothing."""
    from pyspark.errors import PySparkException

    failed = []
    for read in readers:
        try:
            found = read()
            if not found.isEmpty():
                return found
            failed.append("no rows")
        except (PySparkException, OSError) as e:
            failed.append(str(e)[:100])
    raise ValueError(f"no source has rows: {'; '.join(failed)}")


def together(*readers: Callable[[], DataFrame], otherwise: Callable[[], DataFrame] | None = None) -> DataFrame:
    """All that readers give, one after the other; a reader that fails adds nothing. If nothing has rows, what `otherwise` (a cached day) gives."""
    from pyspark.errors import PySparkException

    found = None
    for read in readers:
        try:
            rows = read()
            rows.isEmpty()
        except (PySparkException, OSError):
            continue
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    if otherwise is not None and (found is None or found.isEmpty()):
        return first_filled(otherwise)
    if found is None:
        raise ValueError("no source could be read")
    return found
