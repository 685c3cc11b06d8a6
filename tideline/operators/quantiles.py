"""Exact quantiles of groups of any size: counts by bucket narrow down where an order statistic lies, and only that bucket's rows are sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import staged

#: Buckets that a range is cut into in each pass, and rows of a bucket that are sorted.
BUCKETS, SORTED_ROWS = 1024, 100_000


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], buckets: int = BUCKETS, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """keys, share, n, quantile: the type-7 quantile (linear between neighbours in order) of each group for each share, equal to `percentile`.

    Where that function holds a whole group in one task, this one counts: each pass cuts the range in which an order statistic lies into equal buckets, counts them before the shuffle, and goes on with
    the one that holds it, from its smallest to its largest value, until it has no more than sorted_rows rows or a single value. So a task sees at most a bucket's rows at a time, whatever the group's size.
    Nulls and NaN are left out; a group without other values has no rows. Infinite values raise ValueError. rows is read in each pass: hand it over written.
    """
    spark = rows.sparkSession
    named = [f"k{i}" for i in range(len(keys))]
    held = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    ends = held.groupBy(*named).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), ((F.col("n") - 1) * F.lit(float(s))).alias("h")) for s in dict.fromkeys(shares))))
    wanted = staged(ends.select("*", place.alias("w")).select(*named, "n", "low", "high", "w.share", F.floor("w.h").alias("at"), (F.col("w.h") - F.floor("w.h")).alias("part")), "quantiles")
    if wanted.where("low = double('-infinity') or high = double('infinity')").limit(1).count():
        raise ValueError("infinite values have no quantiles")
    # order statistics, each once: rank within the group, and rank among the rows of its range
    rank = F.explode(F.array(F.col("at"), F.least(F.col("at") + 1, F.col("n") - 1)))
    targets = wanted.select(*named, "low", "high", rank.alias("rank"), F.col("n").alias("left")).distinct().withColumn("within", F.col("rank"))
    done = None
    while True:
        ready = (F.col("left") <= sorted_rows) | (F.col("low") == F.col("high"))
        targets = staged(targets, "quantile-ranges")
        new = targets.where(ready)
        done = new if done is None else done.unionByName(new)
        open_ = targets.where(~ready)
        if not open_.limit(1).count():
            break
        targets = _narrowed(held, open_, named, buckets)
    # single values are known; the rows of the other ranges are sorted, a range at a time
    known = done.where("low = high").select(*named, "rank", F.col("low").alias("v"))
    ranges = done.where("low < high").select(*named, "low", "high").distinct()
    inside = _inside(held, ranges, named).select(*named, "low", "high", "v")
    nth = inside.withColumn("within", F.row_number().over(Window.partitionBy(*named, "low", "high").orderBy("v")) - 1)
    ranks = done.where("low < high").select(*(F.col(k).alias(f"_{k}") for k in named), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("within").alias("_within"), "rank")
    on = (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high")) & (F.col("within") == F.col("_within"))
    for k in named:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    found = nth.join(ranks, on).select(*named, "rank", "v")
    values = staged(known.unionByName(found), "quantile-values")
    # by names of their own, nulls being alike
    side = lambda name: values.select(*(F.col(k).alias(f"{name}_{k}") for k in named), F.col("rank").alias(f"{name}_at"), F.col("v").alias(name))
    both = wanted.withColumn("next", F.least(F.col("at") + 1, F.col("n") - 1))
    for name, at in (("a", "at"), ("b", "next")):
        on = F.col(at) == F.col(f"{name}_at")
        for k in named:
            on = on & F.col(k).eqNullSafe(F.col(f"{name}_{k}"))
        both = both.join(side(name), on)
    mixed = F.when(F.col("part") == 0, F.col("a")).otherwise(F.col("a") + F.col("part") * (F.col("b") - F.col("a")))
    return both.select(*(F.col(n).alias(k) for k, n in zip(keys, named, strict=True)), "share", "n", mixed.alias("quantile"))


def _inside(held: DataFrame, ranges: DataFrame, named: list[str]) -> DataFrame:
    """The rows in each of their group's ranges, of which there are few: two for each share, and all groups' together are far fewer than rows."""
    r = ranges.select(*(F.col(n).alias(f"_{n}") for n in named), *(c for c in ranges.columns if c not in named))
    on = F.lit(True)
    for n in named:
        on = on & F.col(n).eqNullSafe(F.col(f"_{n}"))
    return held.join(r, on & F.col("v").between(F.col("low"), F.col("high"))).drop(*(f"_{n}" for n in named))


def _narrowed(held: DataFrame, targets: DataFrame, named: list[str], buckets: int) -> DataFrame:
    """targets with the range, rank and count of the bucket that holds each."""
    ranges = targets.select(*named, "low", "high").distinct()
    # halves keep the span finite; each bound is a value, so the lowest and the highest part in every pass
    at = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * buckets), F.lit(buckets - 1)).cast("int")
    counts = _inside(held, ranges, named).groupBy(*named, "low", "high", at.alias("bucket")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
    # at most `buckets` rows for each range
    before = F.sum("c").over(Window.partitionBy(*named, "low", "high").orderBy("bucket")) - F.col("c")
    placed = counts.withColumn("before", before)
    p = placed.select(*(F.col(n).alias(f"_{n}") for n in named), F.col("low").alias("_low"), F.col("high").alias("_high"), "c", "least", "most", "before")
    on = (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high"))
    for n in named:
        on = on & F.col(n).eqNullSafe(F.col(f"_{n}"))
    met = targets.join(p, on).where((F.col("within") >= F.col("before")) & (F.col("within") < F.col("before") + F.col("c")))
    return met.select(*named, F.col("least").alias("low"), F.col("most").alias("high"), "rank", F.col("c").alias("left"), (F.col("within") - F.col("before")).alias("within"))


def medians(rows: DataFrame, keys: list[str], value: str, **how) -> DataFrame:
    """keys, n, median: exact, of groups of any size."""
    return quantiles(rows, keys, value, [0.5], **how).select(*keys, "n", F.col("quantile").alias("median"))
