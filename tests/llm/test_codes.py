import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import codes, queries

SF = "/root/testdata/sf0.001"


def brute(rows, parts=4, entries=256, rounds=4):
    """vec_id -> [(code, error, label_error)], and the codebooks' digest, in plain integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], g) for i, v, g in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    width = len(kept[0][1]) // parts
    cut = np.array([r[1] for r in kept], np.int64).reshape(len(kept), parts, width)
    books = cut[:entries].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        index, error = [], 0
        for p in range(parts):
            d = ((cut[:, p, None, :] - books[p][None]) ** 2).sum(2)
            index.append(d.argmin(1))
            error = error + d.min(1)
        if step < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    if (own := cut[index[p] == e, p]).size:
                        books[p, e] = own.sum(0) // len(own)
    by_label = {}
    for (_, _, g), e in zip(kept, error.tolist()):
        by_label[g] = by_label.get(g, 0) + e
    out = sorted((repr(i), "".join(f"{x[n]:02x}" for x in index), int(error[n]), by_label[g]) for n, (i, _, g) in enumerate(kept))
    return out, hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def found(frame):
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error) for r in frame.collect())


@given(st.integers(0, 2**32 - 1), st.sampled_from([3, 40, 2**12, 2**24]), st.integers(1, 70), st.integers(1, 20))
@settings(max_examples=150, deadline=None)
def test_nearest_is_exact(seed, size, entries, width):
    """Against plain integers; far from the origin float32 can't tell neighbours apart."""
    rng = np.random.default_rng(seed)
    near = rng.integers(-3, 4, (40, width)) if seed % 2 else rng.integers(-size // 2, size // 2 + 1, (40, width))
    values = np.clip(rng.integers(-size, size + 1, (1, width)) + near, -(2**24), 2**24)
    book = values[rng.integers(0, 40, entries)] + rng.integers(-1, 2, (entries, width)) * (size < 2**24)
    index, distance = codes.nearest(values, book)
    want = ((values[:, None] - book[None]) ** 2).sum(2)
    assert index.tolist() == want.argmin(1).tolist() and distance.tolist() == want.min(1).tolist()


def test_op13_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, sha = brute(rows)
    got = queries.op13_vector_codes(spark, SF)
    assert got.columns[:5] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert found(got) == want and {r[0] for r in got.select("codebooks_sha256").distinct().collect()} == {sha}


ODD = [
    (5, [0.5, -0.25, 0.001, -0.001], 1), (3, None, 1), (None, [1.0, 2.0, 3.0, 4.0], None), (4, [0.5, None, 0.0, 0.0], 2), (6, [float("nan"), 0.0, 0.0, 0.0], 2), (7, [float("inf"), 0.0, 0.0, 0.0], 2),
    (8, [], 3), (9, [-0.0004, 0.0, 100.0, -100.0], None), (9, [-0.0004, 0.0, 100.0, -100.0], None), (9, [0.7, 0.0, 1.0, -1.0], 4), (10, [0.5, -0.25, 0.001, -0.001], 1),
]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_rows(spark, kind):
    rows = ODD + [(20 + i, [0.25, 0.5, float(i % 7), 1.0], 1) for i in range(900)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, error int, q int").repartition(5)
    as_read = rows if kind == "double" else [(i, v and [None if x is None else float(np.float32(x)) for x in v], g) for i, v, g in rows]
    for entries in (3, 256):
        got, books = codes.compress(frame, entries=entries)
        assert (found(got), books.sha256) == brute(as_read, entries=entries)
    none, books = codes.compress(frame.limit(0))
    assert none.collect() == [] and books.entries.size == 0
    few, books = codes.compress(frame.where("vec_id = 5"))
    assert found(few) == [("5", "00000000", 0, 0)] and books.entries.shape == (4, 1, 1)
    back = codes.decoded(few, books).first().vector
    assert all(abs(a - b) <= 0.5 / 1024 + 1e-9 for a, b in zip(back, ODD[0][1]))


def test_refused(spark):
    with pytest.raises(ValueError):
        codes.learn(codes.prepared(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], "vec_id long, embedding array<float>, label int")))
    with pytest.raises(Exception, match="beyond"):
        codes.prepared(spark.createDataFrame([(1, [1e30] * 4, 1)], "vec_id long, embedding array<float>, label int"))


def test_many_labels(spark):
    """One label holds most rows, others a row each: some are looked up, the others joined."""
    rows = spark.range(3000).selectExpr("id AS key", "CASE WHEN id % 3 > 0 THEN null ELSE id END AS label", "id AS error")
    got = {r.key: r.label_error for r in codes.with_label_error(rows).collect()}
    hot = sum(i for i in range(3000) if i % 3)
    assert got == {i: hot if i % 3 else i for i in range(3000)}
