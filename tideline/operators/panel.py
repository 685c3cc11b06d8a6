"""Panel algebra: monthly, quarterly and annual series on a dense grid of quarters and categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import first_observable, quarter_start
from ..functions.nulls import sum_or_zero
from .staging import staged

CELL = ["quarter", "category", "direction"]


def observable(df: DataFrame, day, lag_days: int, unit: str = "period_unit") -> DataFrame:
    """Rows whose figures are out by day, each by its own unit of time."""
    unit_col = F.col(unit) if unit in df.columns else F.lit("month")
    return df.where(first_observable("period", unit_col, lag_days) <= F.lit(day).cast("date"))


def cleaned(df: DataFrame, keys: list[str], value: str = "value", exclude: list[str] | None = None) -> DataFrame:
    """Values summed by keys; rows with a null category, or one in exclude, are left out."""
    rows = df.where(F.col("category").isNotNull())
    if exclude:
        rows = rows.where(~F.col("category").isin(exclude))
    return rows.groupBy(*keys).agg(sum_or_zero(value).alias(value))


def monthly_to_quarterly(monthly: DataFrame, partial: str = "scale", share_years: int = 5, keys: list[str] | None = None) -> DataFrame:
    """quarter, category, direction, value, n_months. Quarters with fewer than three months are kept (raw), null (drop) or grossed up (scale).

    Grossing up divides by the share that the months there have in complete quarters: the median of each month's share in its category and
    direction, over quarters not more than share_years before the latest complete one of all. Where a month has no
    share, the number of months over three stands for it. keys: columns by which all of this is done separately (backtest origins), in front of the others.
    """
    keys = keys or []
    cell = [*keys, *CELL]
    if partial not in ("raw", "drop", "scale"):
        raise ValueError(partial)
    rows = monthly.where(F.col("period").isNotNull()).withColumn("quarter", quarter_start("period"))
    if partial == "scale":  # read by four branches
        rows = staged(rows.select(*keys, "period", "category", "direction", "value", "quarter"), "monthly")
    cells = rows.groupBy(*cell).agg(sum_or_zero("value").alias("value"), F.count_distinct("period").cast("int").alias("n_months"))
    if partial == "raw":
        return cells
    short = F.col("n_months") < 3
    if partial == "drop":
        return cells.withColumn("value", F.when(~short, F.col("value")))
    # totals stand beside the months they are made of, so that shares need no join
    w = Window.partitionBy(*cell)
    seen = rows.withColumns({"total": F.coalesce(F.sum("value").over(w), F.lit(0.0)), "n_months": F.size(F.collect_set("period").over(w)), "n_rows": F.count(F.lit(1)).over(w), "month": F.month("period")})
    complete = seen.where((F.col("n_months") == 3) & (F.col("total") > 0))
    latest = complete.groupBy(*keys).agg(F.max("quarter").alias("latest"))
    with_latest = complete.join(latest, keys) if keys else complete.crossJoin(F.broadcast(latest))  # one row
    shares = with_latest.where(F.col("quarter") >= F.add_months("latest", -12 * share_years)).groupBy(*keys, "category", "direction", "month").agg(F.median(F.col("value") / F.col("total")).alias("share"))
    open_ = seen.where(short).join(shares, [*keys, "category", "direction", "month"], "left")
    known = open_.groupBy(*cell).agg(F.when(F.count("share") == F.count(F.lit(1)), F.sum("share")).alias("share"), F.count(F.lit(1)).alias("n"))
    part = known.select(*cell, F.when(F.col("share") > 0, F.col("share")).otherwise(F.col("n") / 3).alias("part"))
    return cells.join(part, cell, "left").select(*cell, F.when(short & F.col("part").isNotNull(), F.col("value") / F.col("part")).otherwise(F.col("value")).alias("value"), "n_months")


def annual_to_quarterly(annual: DataFrame, weights: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, period, value: each year's value over its four quarters, in proportion to weights (keys, period, weight), else in equal parts.

    Weights count if any is known and they sum to more than zero; unknown and negative ones are then zero. Totals are preserved.
    """
    keys = keys or []
    quarters = annual.select(*keys, F.col("period").alias("year"), F.col("value").alias("annual"), F.explode(F.sequence("period", F.add_months("period", 9), F.expr("interval 3 months"))).alias("period"))
    if weights is None:
        return quarters.select(*keys, "period", (F.col("annual") / 4).alias("value"))
    w = Window.partitionBy(*keys, "year")
    rows = quarters.join(weights.select(*keys, "period", "weight"), [*keys, "period"], "left")
    rows = rows.withColumns({"raw": F.sum("weight").over(w), "own": F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))})
    part = F.when(F.col("raw") > 0, F.col("own") / F.sum("own").over(w)).otherwise(F.lit(0.25))
    return rows.select(*keys, "period", (F.col("annual") * part).alias("value"))


def without_incomplete_years(annual: DataFrame) -> DataFrame:
    """annual without the years that lack a category of the year before (the one that is there, even if it goes itself)."""
    years = annual.groupBy("period").agg(F.collect_set("category").alias("now"))
    before = F.lag("now").over(Window.orderBy("period"))  # a row for each year
    whole = years.withColumn("before", before).where(F.col("before").isNull() | (F.size(F.array_except("before", "now")) == 0))
    return annual.join(F.broadcast(whole.select("period")), "period", "left_semi")


PANEL = ["period", "category", "oad_lt_arrivals", "oad_lt_departures", "oad_lt_net", "oad_months", "visa_grants", "nom_preliminary", "nom_revised", "nom_final"]


def by_direction(quarterly: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """period, category, arrivals, departures, net, months: net is null if either side is, months is the lesser of the known ones."""
    keys = keys or []
    wide = quarterly.groupBy(*keys, F.col("quarter").alias("period"), "category").pivot("direction", ["arrival", "departure"]).agg(F.first("value").alias("value"), F.first("n_months").alias("n"))
    return wide.select(*keys, "period", "category", F.col("arrival_value").alias("oad_lt_arrivals"), F.col("departure_value").alias("oad_lt_departures"), (F.col("arrival_value") - F.col("departure_value")).alias("oad_lt_net"), F.least("arrival_n", "departure_n").alias("oad_months"))


def by_status(published: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """period, category, nom_preliminary, nom_revised, nom_final: means by status; the final one falls back to revised, then preliminary."""
    keys = keys or []
    wide = published.groupBy(*keys, quarter_start("period").alias("period"), "category").pivot("vintage_status", ["preliminary", "revised", "final"]).agg(F.avg("value"))
    return wide.select(*keys, "period", "category", F.col("preliminary").alias("nom_preliminary"), F.col("revised").alias("nom_revised"), F.coalesce("final", "revised", "preliminary").alias("nom_final"))


def grants_by_quarter(grants: DataFrame, flows: DataFrame | None = None, proportional: bool = True) -> DataFrame:
    """period, category, visa_grants: annual rows spread (in proportion to flows: period, category, weight), others summed by quarter."""
    annual = without_incomplete_years(grants.where("period_unit = 'year'").select("period", "category", "value"))
    spread = annual_to_quarterly(annual, flows if proportional else None, ["category"])
    finer = grants.where("coalesce(period_unit, 'month') <> 'year'").select("category", quarter_start("period").alias("period"), "value")
    return spread.unionByName(finer).groupBy("period", "category").agg(sum_or_zero("value").alias("visa_grants"))


def dense_grid(frames: list[DataFrame], categories: list[str]) -> DataFrame:
    """Every period of any frame with every category."""
    periods = reduce(lambda a, b: a.union(b), (f.select("period") for f in frames)).where("period is not null").distinct()
    levels = periods.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(categories)], "category string")
    return periods.crossJoin(F.broadcast(levels))


def build_panel(flows: DataFrame, published: DataFrame, grants: DataFrame, categories: list[str], partial: str = "scale", share_years: int = 5, proportional: bool = True) -> DataFrame:
    """The dense panel of quarters and categories (and total); what is missing stays null."""
    moved = staged(by_direction(monthly_to_quarterly(flows, partial, share_years)), "moved")
    known = staged(by_status(published), "known")
    granted = staged(grants_by_quarter(grants, moved.select("period", "category", F.col("oad_lt_arrivals").alias("weight")), proportional), "granted")
    grid = dense_grid([moved, known, granted], [*categories, "total"])
    keys = ["period", "category"]
    return grid.join(moved, keys, "left").join(known, keys, "left").join(granted, keys, "left").select(*PANEL)


def total_series(panel: DataFrame, value: str = "nom_final") -> DataFrame:
    """period and value of the total: the category total if it has any value at all, else the sum of the others (nothing sums to 0)."""
    flag = panel.agg(F.coalesce(F.bool_or((F.col("category") == "total") & F.col(value).isNotNull()), F.lit(False)).alias("_given"))
    both = panel.crossJoin(F.broadcast(flag))
    mine = (F.col("category") == "total") == F.col("_given")
    return both.where(mine).groupBy("period").agg(F.when(F.max(F.col("_given").cast("int")) == 1, F.sum(value)).otherwise(sum_or_zero(value)).alias(value))
