import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import longseries
from tideline.operators import statespace as ss


def plain(y, q, r, m, p):
    out = []
    for v in y:
        p += q
        if np.isfinite(v):
            k = p / (p + r)
            m, p = m + k * (v - m), p * (1 - k)
        out.append((m, p))
    return np.array(out)


def test_elements_give_the_filter():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 100, 1001):
        y = rng.normal(size=n).cumsum()
        y[rng.random(n) < 0.2] = np.nan
        elements = longseries.local_level_elements(y, 0.5, 2.0)
        head = np.array([[0.0, 1.0, 3.0, 0.0, 0.0]])
        states = longseries.prefixes(np.concatenate([head, elements]))[1:]
        want = plain(y, 0.5, 2.0, 1.0, 3.0)
        assert np.allclose(states[:, 1:3], want, rtol=1e-9)
        whole = longseries.joined(head, longseries.reduced(elements)[None])[0]
        assert np.allclose(whole[1:3], want[-1], rtol=1e-9)


def test_a_million_steps_over_many_tasks(spark):
    """Equal to a filter step by step, whatever the blocks; a second short series and one with gaps beside it."""
    n = 1_000_000
    rows = spark.range(n).selectExpr("'long' AS k", "id AS period", "sin(id / 1000) * 10 + (xxhash64(id) % 1000) / 500 AS v")
    rows = rows.unionByName(spark.createDataFrame([("short", 5, 1.0), ("short", 9, None), ("short", 12, 4.0), ("none", 1, None)], "k string, period long, v double")).repartition(8)
    out = longseries.filtered_levels(rows, ["k"], "v", 0.5, 2.0)
    assert out.rdd.getNumPartitions() >= 1
    got = out.where("period % 9973 = 0 or period = 999999 or k <> 'long'").select("k", "period", "level", "variance").collect()
    y = np.array(rows.where("k = 'long'").orderBy("period").select("v").toArrow().column("v").to_numpy())
    want = np.concatenate([[(y[0], 2.0)], plain(y[1:], 0.5, 2.0, y[0], 2.0)])
    long = [r for r in got if r.k == "long"]
    assert len(long) == 102 and all(r.level == pytest.approx(want[r.period][0], rel=1e-9) and r.variance == pytest.approx(want[r.period][1], rel=1e-9) for r in long)
    short = sorted((r.period, round(r.level, 9), round(r.variance, 9)) for r in got if r.k == "short")
    assert short == [(5, 1.0, 2.0), *((t, round(m, 9), round(p, 9)) for t, (m, p) in zip((9, 12), plain([np.nan, 4.0], 0.5, 2.0, 1.0, 2.0)))]
    assert not [r for r in got if r.k == "none"]
    few = longseries.filtered_levels(rows.where("k = 'long' and period < 3000"), [], "v", 0.5, 2.0, start=(0.0, 5.0), block_steps=100).where("period = 2999").first()
    assert (few.level, few.variance) == pytest.approx(tuple(plain(y[:3000], 0.5, 2.0, 0.0, 5.0)[-1]), rel=1e-9)
    assert longseries.filtered_levels(rows.limit(0), ["k"], "v", 0.5, 2.0).count() == 0


def test_five_bands_against_a_dense_system():
    rng = np.random.default_rng(1)
    for n in (4, 5, 6, 40, 300):
        y = rng.normal(size=n)
        D = np.diff(np.eye(n), 2, axis=0)
        assert np.allclose(ss.hodrick_prescott(y, 1600.0), np.linalg.solve(np.eye(n) + 1600.0 * D.T @ D, y))
    assert len(ss.hodrick_prescott(rng.normal(size=200_000))) == 200_000
