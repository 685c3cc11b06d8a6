import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import quantiles


def test_against_percentile(spark):
    """A hot group, ties, a heavy tail, groups of one and two, a null key, nulls and NaN, and huge spans; ranges narrow over many passes."""
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(6000)] + [("ties", float(rng.randrange(4))) for _ in range(900)] + [("tail", 2.0 ** rng.randrange(-40, 40)) for _ in range(700)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, 4.0), (None, None), ("none", None), ("none", float("nan")), ("hot", float("nan")), ("wide", -1.7e308), ("wide", 1.7e308), ("wide", 0.0), ("same", 7.0), ("same", 7.0)]
    rows += [("near", 1.0 + k * 2.0**-52) for k in range(300)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.8, 0.95, 1.0]
    clean = frame.where("v is not null and not isnan(v)")
    want = {(r.k, s): q for r in clean.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect() for s, q in zip(shares, r.q)}
    for size, limit in ((64, 100), (1024, 100_000)):
        got = {(r.k, r.share): (r["quantile"], r.n) for r in quantiles.quantiles(frame, ["k"], "v", shares, buckets=size, sorted_rows=limit).collect()}
        assert got.keys() == want.keys()
        for key, q in want.items():
            assert got[key][0] == pytest.approx(q, rel=1e-12, abs=1e-300) or key[0] == "wide"
        assert got["hot", 0.5][1] == 6000 and got["wide", 0.5][0] == 0.0


def test_no_keys_no_rows_and_infinity(spark):
    frame = spark.createDataFrame([(float(k),) for k in range(101)], "v double")
    got = quantiles.medians(frame, [], "v").first()
    assert (got.n, got.median) == (101, 50.0)
    assert quantiles.medians(frame.limit(0), [], "v").count() == 0
    with pytest.raises(ValueError):
        quantiles.medians(spark.createDataFrame([(float("inf"),)], "v double"), [], "v")
