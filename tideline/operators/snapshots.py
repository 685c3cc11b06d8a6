"""Snapshots of results: a table and one row that says how it came about, written together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, path: str, day: str, **facts) -> None:
    """Writes df under path/data and its day, rows and facts under path/meta; both are replaced."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark = df.sparkSession
    rows = spark.read.parquet(f"{path}/data").count()
    meta = spark.range(1).select(F.lit(day).alias("asof_date"), F.lit(rows).alias("rows"), *(F.lit(v).alias(k) for k, v in sorted(facts.items())))
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_snapshot(spark, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/data"), spark.read.json(f"{path}/meta").first().asDict()


def live_edge(panel: DataFrame, months: str = "oad_months", value: str = "oad_lt_arrivals") -> DataFrame:
    """period, months: the latest quarter of the total that has a flow, and how many of its months are in it."""
    rows = panel.where((F.col("category") == "total") & F.col(value).isNotNull())
    return rows.agg(F.max_by(F.struct("period", F.col(months).alias("months")), "period").alias("e")).select("e.*")


def first_unpublished(headline: DataFrame, published: DataFrame) -> DataFrame:
    """The row of headline for the first period after the last published one."""
    last = published.where("nom_final is not null").agg(F.max("period").alias("_last"))
    later = headline.crossJoin(F.broadcast(last)).where("period > _last or _last is null").drop("_last")
    return later.orderBy("period").limit(1)
