"""Kalman filtering of series that are too long for one task: steps are elements of an associative product, so blocks of time are multiplied out by themselves.

An element says what the steps of a block make of any state before it. The product of two elements is that of both blocks, so each block is reduced in its own task, the few
elements of a series are multiplied from left to right, and then each block is filtered from the state before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.search import instant, rank_below
from .staging import staged

#: Steps of a block, about, and blocks at most; beyond that they grow.
BLOCK_STEPS, BLOCKS = 50_000, 8192


def local_level_elements(y: np.ndarray, q: float, r: float) -> np.ndarray:
    """(A, b, C, eta, J) of each step of a local level with state variance q and observation variance r; a NaN is no observation."""
    seen, s = np.isfinite(y), q + r
    v = np.where(seen, y, 0.0)
    k = np.where(seen, q / s, 0.0)
    return np.stack([1 - k, k * v, (1 - k) * q, np.where(seen, v / s, 0.0), np.where(seen, 1 / s, 0.0)], 1)


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The elements of two neighbouring runs as one; rows of both are pairs."""
    a1, b1, c1, e1, j1 = first.T
    a2, b2, c2, e2, j2 = second.T
    d = 1 / (1 + c1 * j2)
    return np.stack([a2 * d * a1, a2 * d * (b1 + c1 * e2) + b2, a2 * d * c1 * a2 + c2, a1 * d * (e2 - j2 * b1) + e1, a1 * d * j2 * a1 + j1], 1)


def reduced(elements: np.ndarray) -> np.ndarray:
    """The product of all elements in order, by halves."""
    while len(elements) > 1:
        even = len(elements) // 2 * 2
        elements = np.concatenate([joined(elements[0:even:2], elements[1:even:2]), elements[even:]])
    return elements[0]


def prefixes(elements: np.ndarray) -> np.ndarray:
    """The products of the first 1, 2, .. elements, in as many rounds as the logarithm of their number."""
    out, step = elements.copy(), 1
    while step < len(out):
        out[step:] = joined(out[:-step], out[step:])
        step *= 2
    return out


def filtered_levels(series: DataFrame, keys: list[str], value: str, q: float, r: float, period: str = "period", start: tuple[float, float] | None = None, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """keys, period, value, level, variance: the filtered state of a local level (state variance q, observation variance r) after each step, of series of any length.

    Steps go by the order of period, equal ones by value; a null value is a step without an observation. start: mean and variance before the first step; by default the first observation is the level, with
    variance r, and steps before it have no rows. Blocks are cut at existing periods, so that no task holds more than its blocks: two grouped maps over them, and one over a series' elements.
    """
    kind = series.schema[period].dataType
    rows = series.select(*keys, F.col(period).alias("_t"), F.col(value).cast("double").alias("_v"), instant(F.col(period), kind).alias("_at"))
    n = rows.count()
    parts = min(BLOCKS, max(1, n // block_steps))
    bounds = sorted(set(rows.agg(F.percentile_approx("_at", [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0] or [])) if parts > 1 else []
    if start is None:
        first = rows.where("_v is not null and not isnan(_v)").groupBy(*keys).agg(F.min(F.struct("_t", "_v")).alias("_first"))
        rows = rows.join(first, keys) if keys else rows.crossJoin(F.broadcast(first))
        rows = rows.where((F.col("_t") > F.col("_first._t")) | ((F.col("_t") == F.col("_first._t")) & (F.coalesce(F.col("_v"), F.col("_first._v")) >= F.col("_first._v"))))
        mean, spread = F.col("_first._v"), F.lit(float(r))
    else:
        mean, spread = F.lit(float(start[0])), F.lit(float(start[1]))
    blocks = staged(rows.select(*keys, rank_below(F.col("_at"), bounds).alias("_block"), "_t", "_v", mean.alias("_mean"), spread.alias("_spread")), "blocks")
    by = [*keys, "_block"]
    given = start is not None

    def steps(group: pd.DataFrame, first: bool) -> np.ndarray:
        """The block's elements; without a start the first observation of a series is its state, and no step."""
        y = group["_v"].to_numpy(float)
        elements = local_level_elements(y, q, r)
        if first and not given:
            elements[0] = [0.0, y[0], r, 0.0, 0.0]
        return elements

    least = blocks.groupBy(*keys).agg(F.min("_block").alias("_least"))
    blocks = (blocks.join(least, keys) if keys else blocks.crossJoin(F.broadcast(least))).withColumn("_one", F.lit(1))
    named = lambda fields, rest: T.StructType([blocks.schema[k] for k in fields] + T._parse_datatype_string(rest).fields)
    order = ["_t", "_v"]

    def reduce_block(key, group):
        group = group.sort_values(order, ignore_index=True, na_position="last")
        element = reduced(steps(group, group["_block"].iloc[0] == group["_least"].iloc[0]))
        return pd.DataFrame([[*key, *element.tolist(), group["_mean"].iloc[0], group["_spread"].iloc[0]]], columns=[*by, "a", "b", "c", "e", "j", "_mean", "_spread"])

    elements = blocks.groupBy(*by).applyInPandas(reduce_block, named(by, "a double, b double, c double, e double, j double, _mean double, _spread double"))

    def before(key, group):
        """The state before each block: a row for each of a series' blocks, of which there are BLOCKS at most."""
        group = group.sort_values("_block", ignore_index=True)
        head = np.array([[0.0, group["_mean"].iloc[0], group["_spread"].iloc[0], 0.0, 0.0]])
        state = prefixes(np.concatenate([head, group[["a", "b", "c", "e", "j"]].to_numpy()]))[:-1]
        out = pd.DataFrame({"_block": group["_block"], "m": state[:, 1], "p": state[:, 2]})
        for k, v in zip(keys, key, strict=False):
            out[k] = v
        return out[[*keys, "_block", "m", "p"]]

    series_of = keys or ["_one"]
    elements = elements if keys else elements.withColumn("_one", F.lit(1))
    states = elements.groupBy(*series_of).applyInPandas(before, named(by, "m double, p double"))

    def filter_block(key, group):
        group = group.sort_values(order, ignore_index=True, na_position="last")
        head = np.array([[0.0, group["m"].iloc[0], group["p"].iloc[0], 0.0, 0.0]])
        state = prefixes(np.concatenate([head, steps(group, group["_block"].iloc[0] == group["_least"].iloc[0])]))[1:]
        out = pd.DataFrame({"_t": group["_t"], "_v": group["_v"], "level": state[:, 1], "variance": state[:, 2]})
        for k, v in zip(keys, key, strict=False):
            out[k] = v
        return out[[*keys, "_t", "_v", "level", "variance"]]

    out = blocks.join(states, by).groupBy(*by).applyInPandas(filter_block, named([*keys, "_t", "_v"], "level double, variance double"))
    return out.withColumnsRenamed({"_t": period, "_v": value})
