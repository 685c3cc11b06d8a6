import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tideline.llm import queries, sketch

SF = "/root/testdata/sf0.001"
MASK = 2**64 - 1


def plain(text, size=5, scaled=8):
    """The sketch of a text as a set, straight from its definition."""
    words = [hashlib.md5(w).digest()[:8] for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    runs = [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = {sum(int.from_bytes(w, "big") * pow(sketch.FACTOR, j, 2**64) for j, w in enumerate(run)) & MASK for run in runs}
    return {h for h in hashes if h < 2**64 // scaled} or ({min(hashes)} if hashes else set())


def string(hashes):
    return "".join(f"{h:016x}" for h in sorted(hashes))


def near(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def held(a, b):
    return len(a & b) / len(a) if a else float(not b)


def brute(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: r[1].encode())
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(t) // 3
        new = t[: len(t) - n] + after[:n]
        a, b, c = plain(t), plain(new), plain(after)
        out.append((k, len(t), hashlib.sha256(new.encode()).hexdigest(), string(a), string(b), near(a, b), near(a, c), held(a, b), held(a, c)))
    return sorted(map(repr, out))


def found(frame, key="doc_id"):
    return sorted(repr(tuple(r)) for r in frame.select(key, *sketch.NAMES).collect())


def test_op12_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op12_scaled_sketch(spark, SF)) == brute(rows)


def odd():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)] + ["Ärger", "日本", "😀x", " "]
    rows = [(rng.randrange(-300, 300), " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 4, 5, 6, 40])))) for _ in range(700)]
    rows += [(None, None), (None, ""), (None, "a b c d e f"), (7, None), (7, ""), (8, "x" * 200_000), (2**62, " \t\n "), (-(2**62), "A B C D E"), (9, "a b c d e"), (9, "a b c d e")]
    return rows + [(5, "the same row again and again")] * 40


def test_odd_rows(spark, monkeypatch):
    """Ties, repeated rows, nulls, keys at both ends, one bucket and many; clashing columns."""
    rows = odd()
    frame = spark.createDataFrame([(*r, 1, "b", "g") for r in rows], "doc_id long, text string, k int, bucket string, guest string").repartition(5)
    want = brute(rows)
    assert found(sketch.edited_fingerprints(frame)) == want
    for size in (7, 3):
        monkeypatch.setattr(sketch, "BUCKET_ROWS", size)
        assert found(sketch.edited_fingerprints(frame)) == want
    assert sketch.edited_fingerprints(frame.limit(0)).count() == 0
    assert found(sketch.edited_fingerprints(frame.where("doc_id = 8").withColumnRenamed("doc_id", "k2"), key="k2"), "k2") == brute([(8, "x" * 200_000)])
    for one in ([(None, None)], [(1, "a b"), (1, "a b")], [(None, "x"), (3, "y")]):
        assert found(sketch.edited_fingerprints(spark.createDataFrame(one, "doc_id int, text string"))) == brute(one)


def test_small_batches_cross_borders(spark):
    rows = odd()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert found(sketch.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sketches_merge():
    rng = random.Random(5)
    memo = sketch.WordHashes()
    texts = [" ".join(rng.choices("abcdefgh", k=rng.choice([0, 2, 5, 9, 300]))) for _ in range(60)]
    one = lambda t: sketch.Sketches.of(pa.array([t]), memo).strings()[0].as_py()
    for a, b in zip(texts, texts[1:]):
        hashes = sorted({h for t in (a, b) for h in plain_all(t)})
        want = [h for h in hashes if h < 2**61] or hashes[:1]
        assert sketch.merged(one(a), one(b)) == string(want) == sketch.merged(one(b), one(a), one(b))
    assert sketch.merged() == ""


def plain_all(text):
    words = [int.from_bytes(hashlib.md5(w).digest()[:8], "big") for w in text.encode().split()]
    runs = [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []
    return {sum(w * pow(sketch.FACTOR, j, 2**64) for j, w in enumerate(run)) & MASK for run in runs}


def test_estimates_of_unequal_texts(spark):
    """A text of 600 words inside one of 20,000, and half inside: containment is found though the likeness is near zero."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(5000)]
    small = rng.choices(words, k=600)
    large = rng.choices(words, k=20_000)
    whole, half = large + small, large + small[:300]
    memo = sketch.WordHashes()
    prints = sketch.Sketches.of(pa.array([" ".join(x) for x in (small, whole, half, large)]), memo).strings().to_pylist()
    frame = spark.createDataFrame([(prints[0], p) for p in prints[1:]], "a string, b string")
    got = [r[0] for r in frame.select(sketch.containment(F.col("a"), F.col("b"))).collect()]
    assert np.allclose(got, [1, 0.5, 0], atol=0.15) and got[0] == 1 and got[2] == 0
    pair = sketch.Sketches.of(pa.array([" ".join(small)]), memo).compared(sketch.Sketches.of(pa.array([" ".join(whole)]), memo))
    assert pair[1][0] == 1 and pair[0][0] < 0.1
    assert spark.createDataFrame([("", prints[0])], "a string, b string").select(sketch.containment(F.col("a"), F.col("b"))).first()[0] is None
