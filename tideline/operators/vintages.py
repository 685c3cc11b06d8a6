"""Observations by source, series and period, each as known at a vintage date: reads as of days, revisions, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import labels
from ..functions.search import instant, rank_below

#: What a store holds of an observation.
STORE = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("series_id", T.StringType(), False),
        T.StructField("period", T.DateType(), False),
        T.StructField("period_unit", T.StringType(), False),
        T.StructField("vintage_date", T.DateType(), False),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)


def as_of(observations: DataFrame, day, keys: list[str], vintage: str = "vintage_date") -> DataFrame:
    """The latest vintage not after day of each key; a null value stays if it is the latest. One aggregation; the day reaches the scan.

    Each column is aggregated by itself, so that numbers and dates stay in a hash aggregate. Of equal vintages of a key one row stays, whole.
    """
    known = observations.where(F.col(vintage) <= F.lit(day).cast(observations.schema[vintage].dataType))
    return _latest(known, keys, vintage).select(*observations.columns)


def _latest(rows: DataFrame, keys: list[str], vintage: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c != vintage]
    return rows.groupBy(*keys).agg(F.max(vintage).alias(vintage), *(F.max_by(c, vintage).alias(c) for c in rest))


#: Days up to which each span is held against all of them; beyond that they are met by buckets: of so many days, about, and so many buckets at most.
FEW_DAYS, BUCKET_DAYS, DAY_BUCKETS = 64, 16, 4096


def as_of_many(observations: DataFrame, days: DataFrame, keys: list[str], vintage: str = "vintage_date", day: str = "asof_date", few: int = FEW_DAYS) -> DataFrame:
    """as_of for each row of days, in one job: with the column `day` in front. Days have the type of the vintages.

    A vintage is known from its day to the day before the next one of its key: one window over the observations, dealt by key. Of equal vintages of a key the row that is largest by its other
    columns in order counts. A few days are held against all spans. More are cut into buckets of neighbours: a span goes to the buckets that it touches, meets their days by an
    equality, and then its ends decide. So what meets is in proportion to what comes out, however many days and spans there are.
    """
    rest = [c for c in observations.columns if c not in keys and c != vintage]
    following = F.lead(vintage).over(Window.partitionBy(*keys).orderBy(vintage, *rest))
    spans = observations.where(F.col(vintage).isNotNull()).withColumn("_until", following)
    dates = days.select(day).where(F.col(day).isNotNull()).distinct()
    at, fits = F.col(day), (F.col(vintage) <= F.col(day)) & (F.col("_until").isNull() | (F.col("_until") > F.col(day)))
    if (n := dates.limit(few + 1).count()) <= few:
        return spans.join(F.broadcast(dates.limit(few)), fits).select(day, *observations.columns)
    n, kind = dates.count(), observations.schema[vintage].dataType
    parts = min(DAY_BUCKETS, -(-n // BUCKET_DAYS))
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(dates.agg(F.percentile_approx(instant(at, kind), shares, 10_000)).first()[0])) if shares else []
    first, last = rank_below(instant(F.col(vintage), kind), bounds), rank_below(instant(F.col("_until"), kind), bounds)
    cut = spans.withColumn("_bucket", F.explode(F.sequence(first, F.coalesce(last, F.lit(len(bounds))))))
    met = cut.join(dates.withColumn("_bucket", rank_below(instant(at, kind), bounds)), "_bucket")
    return met.where(fits).select(day, *observations.columns)


def history(observations: DataFrame, vintage: str = "vintage_date", period: str = "period") -> DataFrame:
    return observations.orderBy(period, vintage)


def revisions(observations: DataFrame, keys: list[str], vintage: str = "vintage_date", value: str = "value") -> DataFrame:
    """observations with the number of each vintage of a key and its change against the one before."""
    w = Window.partitionBy(*keys).orderBy(vintage)
    return observations.withColumn("vintage_no", F.row_number().over(w)).withColumn("revision", F.col(value) - F.lag(value).over(w))


def replace_by_key(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and what existing has besides; of equal keys in new the last value by order of the other columns stays."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else new.distinct()
    return existing.join(once, keys, "left_anti").unionByName(once, allowMissingColumns=True)


def read_history(spark: SparkSession, path: str, first: str | None = None) -> DataFrame:
    """A history from .csv files with a header: source, series_id, period, period_unit, vintage_date, value, unit, metadata, those that are there; rows of vintages before `first` are left out."""
    text = spark.read.option("header", True).csv(path)
    known = [f for f in STORE if f.name in text.columns]
    rows = text.select(*(F.col(f.name).try_cast(f.dataType) for f in known))
    return rows.where(F.col("vintage_date") >= F.lit(first).cast("date")) if first else rows


def reenriched(rows: DataFrame, parts: list[str], rules: dict, metadata: str = "metadata", series_id: str = "series_id") -> DataFrame:
    """rows with the columns that the store does not keep: what rules say of the series named in the metadata, else a part of the series id.

    parts: what the id holds, split by colons, its first part being the source; an empty name skips one. rules: by name a function of the series' description.
    Columns that are there already stay. Metadata that is no JSON counts as none.
    """
    series, at = F.get_json_object(metadata, "$.series"), F.split(series_id, ":")
    new = {}
    for k, name in enumerate(parts):
        if name and name not in rows.columns:
            own = F.nullif(F.get(at, k), F.lit(""))
            new[name] = F.coalesce(rules[name](series), own) if name in rules else own
    return rows.withColumns(new) if new else rows


def reenriched_flows(rows: DataFrame) -> DataFrame:
    """category and direction of movements: ids are source:category:direction."""
    return reenriched(rows, ["", "category", "direction"], {"category": labels.visa_group, "direction": labels.direction})


def reenriched_figures(rows: DataFrame) -> DataFrame:
    """category of published figures, total where nothing says which."""
    out = reenriched(rows, ["", "category"], {"category": labels.visa_group})
    return out if "category" in rows.columns else out.withColumn("category", F.coalesce("category", F.lit("total")))


def reenriched_grants(rows: DataFrame) -> DataFrame:
    """category of grants from the visa in the id."""
    if "category" in rows.columns:
        return rows
    return reenriched(rows, ["", "category"], {}).withColumn("category", labels.subclass("category"))
