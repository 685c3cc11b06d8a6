"""Least squares by group from sums of products: added up before the shuffle, merged after it, and solved in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A regressor of which the others explain all but this part of its variance is left out.
COLLINEAR = 1e-10


def solved(gram: Column, size: int) -> Column:
    """The solution of a symmetric positive system, an array of `size` rows with the right-hand side as last entry, by sweeping out one unknown after the other.

    An unknown whose pivot is not above COLLINEAR is 0.
    """

    def sweep(m, k):
        pivot = F.get(F.get(m, k), k)
        # bound once for all rows
        bound = F.array(F.struct(pivot.alias("p"), F.get(m, k).alias("row")))
        each = lambda at: F.transform(m, lambda row, i: F.when(i == k, F.transform(row, lambda x: x / at["p"])).otherwise(F.zip_with(row, at["row"], lambda x, y: x - F.get(row, k) / at["p"] * y)))
        out = F.transform(m, lambda row, i: F.when(i == k, F.transform(row, lambda x: F.lit(0.0))).otherwise(row))
        return F.when(pivot > COLLINEAR, F.get(F.transform(bound, each), F.lit(0))).otherwise(out)

    swept = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), gram, sweep)
    return F.transform(swept, lambda row: F.element_at(row, -1))


def regressions(rows: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """keys, n, y_mean, x_mean, x_scale, b (arrays over xs): least squares of y on xs and a constant over the rows where all are known.

    y is y_mean plus the sum of b times (x - x_mean) / x_scale. Means come first, then sums of products of what deviates from them, so that large means cost no digits. Both are sums by key: a hot key is
    added up in all tasks. Of regressors that depend on each other later ones are left out (b is 0).
    """
    known = F.lit(True)
    for c in (y, *xs):
        known = known & F.col(c).isNotNull() & ~F.isnan(c)
    rows = rows.where(known).select(*keys, y, *xs)
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("y_mean"), F.array(*(F.avg(x) for x in xs)).alias("x_mean"), F.array(*(F.stddev_pop(x) for x in xs)).alias("_sd"))
    stats = stats.withColumn("x_scale", F.transform("_sd", lambda s: F.when(s > 0, s).otherwise(F.lit(1.0)))).drop("_sd")
    both = rows.join(stats, keys) if keys else rows.crossJoin(F.broadcast(stats))
    z = [(F.col(x) - F.get("x_mean", F.lit(i))) / F.get("x_scale", F.lit(i)) for i, x in enumerate(xs)]
    centred = both.select(*keys, (F.col(y) - F.col("y_mean")).alias("_y"), *(v.alias(f"_z{i}") for i, v in enumerate(z)))
    p = len(xs)
    # means of products: the diagonal is 1
    sums = [F.avg(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"_s{i}_{j}") for i in range(p) for j in range(i, p)] + [F.avg(F.col(f"_z{i}") * F.col("_y")).alias(f"_r{i}") for i in range(p)]
    products = centred.groupBy(*keys).agg(*sums)
    gram = F.array(*(F.array(*(F.col(f"_s{min(i, j)}_{max(i, j)}") for j in range(p)), F.col(f"_r{i}")) for i in range(p)))
    fit = products.select(*keys, solved(gram, p).alias("b"))
    return stats.join(fit, keys) if keys else stats.crossJoin(F.broadcast(fit))


def predicted(xs: list[str]) -> Column:
    """What a row of regressions() says of xs; null where one of them isn't known."""
    total = F.col("y_mean")
    for i, x in enumerate(xs):
        total = total + F.get("b", F.lit(i)) * (F.nanvl(F.col(x), F.lit(None)) - F.get("x_mean", F.lit(i))) / F.get("x_scale", F.lit(i))
    return total
