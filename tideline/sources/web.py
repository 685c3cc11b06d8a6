"""Pages of links and catalogue answers as tables; files that were fetched before, by day."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGES = "struct<result:struct<results:array<struct<title:string,resources:array<struct<url:string,format:string,name:string>>>>>>"


def links(pages: DataFrame, url: str = "url", html: str = "html", endings: list[str] | None = None) -> DataFrame:
    """url, link: the distinct targets of a page's links, absolute where they begin with a slash; only those with one of the endings, if given."""
    host = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    found = pages.select(F.col(url).alias("url"), host.alias("_host"), F.explode(F.regexp_extract_all(html, F.lit(r'<a\b[^>]*\bhref="([^"]*)"'), F.lit(1))).alias("link"))
    out = found.select("url", F.when(F.col("link").startswith("/"), F.concat("_host", "link")).otherwise(F.col("link")).alias("link"))
    if endings:
        out = out.where(F.lower(F.regexp_replace("link", r"[?#].*$", "")).rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$"))
    return out.distinct()


def catalogue(answers: DataFrame, body: str = "body") -> DataFrame:
    """dataset_title, url, format, name of each resource of each package in catalogue answers; a body that is no JSON has none."""
    packages = answers.select(F.explode(F.from_json(body, PACKAGES)["result"]["results"]).alias("p"))
    return packages.select(F.col("p.title").alias("dataset_title"), F.explode("p.resources").alias("r")).select("dataset_title", "r.*")


def granted(resources: DataFrame, format: str = "format", name: str = "name", url: str = "url") -> DataFrame:
    """The .xlsx resources whose name or address says that they are about grants."""
    says = lambda c: F.coalesce(F.col(c).rlike("(?i)granted"), F.lit(False))
    return resources.where((F.lower(format) == "xlsx") & (says(name) | says(url)))


def sub_pages(found: DataFrame, keywords: list[str], link: str = "link") -> DataFrame:
    """The distinct links, as link, that have one of the keywords as a part of their path: the pages to look at next."""
    words = "|".join(re.escape(k) for k in keywords)
    return found.where(F.col(link).rlike(f"(?i)({words})(/|$)") if keywords else F.lit(False)).select(link).distinct()


def lock_date(text) -> Column:
    """The first ISO day within a text, null if there is none."""
    t = text if isinstance(text, Column) else F.col(text)
    return F.try_to_timestamp(F.nullif(F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def latest_resources(resources: DataFrame, keys: list[str], date: str = "lock") -> DataFrame:
    """The resource with the latest date of each data set (by url among equals); all of a data set without dates."""
    dated = resources.where(F.col(date).isNotNull())
    rest = [c for c in resources.columns if c not in keys]
    last = dated.groupBy(*keys).agg(F.max(F.struct(date, *[c for c in rest if c != date])).alias("_r")).select(*keys, "_r.*").select(*resources.columns)
    bare = resources.join(dated.select(*keys).distinct(), keys, "left_anti")
    return last.unionByName(bare)


def cached_days(spark: SparkSession, path: str, column: str = "asof") -> DataFrame:
    """What was fetched on the latest day of a folder partitioned by day: only that partition is read."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max(column)).first()[0]
    return rows.where(F.col(column) == F.lit(last))


def cache_path(source: str, day: str, url: str, ending: str) -> Column:
    """Where a fetched file is kept: raw/source/day/ and ten digits of its address's hash."""
    return F.concat(F.lit(f"raw/{source}/{day}/"), F.substring(F.sha1(F.col(url).cast("binary")), 1, 10), F.lit(ending))
