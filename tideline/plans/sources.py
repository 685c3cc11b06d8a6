"""The example domain: the star-schema tables seen as flows, published figures, grants and vintages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import fy_start, month_start, quarter_start

#: SQL for the same views, to put in front of an oracle.
FLOW_SQL = """flow AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, o_orderpriority AS category,
  CASE o_orderstatus WHEN 'F' THEN 'arrival' ELSE 'departure' END AS direction, count(*)::DOUBLE AS value
  FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2, 3)"""
PUBLISHED_SQL = """published AS (SELECT date_trunc('quarter', o_orderdate)::DATE AS period, o_orderpriority AS category,
  count(*) * 0.25::DOUBLE AS value FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2)"""
ANNUAL_SQL = """annual AS (SELECT make_date((year(l_shipdate - INTERVAL 6 MONTH))::INT, 7, 1) AS period, l_returnflag AS category,
  sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"""
VINTAGE_SQL = """vintages AS (SELECT event_type AS series_id, user_id AS period_key, ts AS vintage_ts, value FROM events)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly flows: period, category, direction, value."""
    o = read(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    kind = F.when(F.col("o_orderstatus") == "F", "arrival").otherwise("departure")
    return o.groupBy(month_start("o_orderdate").alias("period"), F.col("o_orderpriority").alias("category"), kind.alias("direction")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly figures: period, category, value."""
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return o.groupBy(quarter_start("o_orderdate").alias("period"), F.col("o_orderpriority").alias("category")).agg((F.count(F.lit(1)) * F.lit(0.25)).alias("value"))


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures by financial year: period, category, value."""
    return read(spark, sf_dir, "lineitem").groupBy(fy_start(F.col("l_shipdate").cast("date")).alias("period"), F.col("l_returnflag").alias("category")).agg(F.sum("l_quantity").alias("value"))


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as vintages: series_id, period_key, vintage_ts, value."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.col("user_id").alias("period_key"), F.col("ts").alias("vintage_ts"), "value")
