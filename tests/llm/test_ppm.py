import functools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import ppm, queries


def brute_bits(text: bytes, train: list[bytes], order: int, nodes: list[set], symbols: set) -> float:
    """Method C with exclusion and the shared nodes, byte by byte."""
    counts: list[dict] = [{} for _ in range(order + 1)]
    for t in train:
        t = bytes(order) + t
        for i in range(order, len(t)):
            for o in range(order + 1):
                counts[o].setdefault(t[i - o : i], Counter())[t[i]] += 1

    @functools.cache
    def code(context):
        """The probabilities of all bytes after a context."""
        below = code(context[1:]) if context else [1 / 256] * 256
        seen = counts[len(context)].get(context)
        if not seen:
            return below
        rest = sum(x for b, x in enumerate(below) if b not in seen)
        total = sum(seen.values()) + (len(seen) if rest else 0)
        out = [seen[b] / total if b in seen else len(seen) / total * below[b] / rest for b in range(256)]
        assert abs(sum(out) - 1) < 1e-9
        return out

    def p(o, context, byte):
        return code(context[len(context) - o :])[byte]

    bits, t = 0.0, bytes(order) + text
    for i in range(order, len(t)):
        o = max(o for o in range(order + 1) if o == 0 or t[i - o : i] in nodes[o])
        bits -= math.log2(p(o, t[i - o : i], t[i]))
    return bits


def test_code_lengths_against_brute_force():
    train = {"aa": [b"abracadabra", b"banana band"], "bb": [b"kokoro kook", b"abba"]}
    order, least, counts = 2, 2, {}
    for name, texts in train.items():
        c = Counter()
        for t in texts:
            t = bytes(order) + t
            for i in range(order, len(t)):
                c[int.from_bytes(t[i - order : i + 1], "big")] += 1
        counts[name] = (np.array(sorted(c)), np.array([c[k] for k in sorted(c)]))
    trees = ppm.Trees(sorted(train), counts, order, least)
    nodes = [set() for _ in range(order + 1)]
    for texts in train.values():
        c = Counter()
        for t in texts:
            t = bytes(order) + t
            for i in range(order, len(t)):
                for o in range(1, order + 1):
                    c[t[i - o : i]] += 1
        for context, n in c.items():
            if n >= least:
                nodes[len(context)].add(context)
    texts = [b"abra", b"", b"kokoabba zq", b"banana\x00b"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    got = trees.lengths(raw, np.cumsum([0, *map(len, texts)]))
    for row, text in zip(got, texts):
        for k, name in enumerate(sorted(train)):
            assert row[k] == pytest.approx(brute_bits(text, train[name], order, nodes, set()), rel=1e-5)


def test_op1_equals_brute_force(spark):
    """Every row of the query from plain dictionaries of counts: nodes, code lengths, prediction, score and und."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows}
    train: dict[str, list[bytes]] = {}
    for r in rows:
        if r.text and r.lang and not held[r.doc_id]:
            train.setdefault(r.lang, []).append(bytes(ppm.ORDER) + lower(r.text))
    counts = {name: {} for name in train}
    nodes = {b""}
    for name, texts in train.items():
        own = counts[name]
        for t in texts:
            for i in range(ppm.ORDER, len(t)):
                for o in range(ppm.ORDER + 1):
                    own.setdefault(t[i - o : i], Counter())[t[i]] += 1
        nodes |= {c for c, n in own.items() if sum(n.values()) >= ppm.LEAST}

    @functools.cache
    def code(name, context):
        below = code(name, context[1:]) if context else [1 / 256] * 256
        seen = counts[name].get(context)
        if not seen:
            return below
        rest = sum(x for b, x in enumerate(below) if b not in seen)
        total = sum(seen.values()) + (len(seen) if rest else 0)
        return [seen[b] / total if b in seen else len(seen) / total * below[b] / rest for b in range(256)]

    want = {}
    for r in rows:
        t = bytes(ppm.ORDER) + lower(r.text)
        bits = dict.fromkeys(sorted(train), 0.0)
        for i in range(ppm.ORDER, len(t)):
            context = next(t[i - o : i] for o in range(ppm.ORDER, -1, -1) if t[i - o : i] in nodes)
            for name in bits:
                bits[name] -= math.log2(code(name, context)[t[i]])
        if any(c.isalpha() for c in r.text or ""):
            best = min(bits, key=bits.get)
            want[r.doc_id] = best, 1 / sum(2.0 ** -min(b - bits[best], 1000) for b in bits.values())
        else:
            want[r.doc_id] = "und", 0.0
    got = queries.op1_language_ppm(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.lang_pred) == (held[r.doc_id], want[r.doc_id][0]) and r.score == pytest.approx(want[r.doc_id][1], rel=1e-3, abs=1e-9)


def test_codes_are_complete(spark):
    """The probabilities of all 256 bytes sum up to one at every node and for every language."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trees = ppm.fit(docs)
    mass = (np.exp2(-trees.bits.astype(np.float64)).reshape(-1, trees.width, len(trees.labels)) * trees.bytes_of[:, None]).sum(1)
    assert np.abs(mass[1:] - 1).max() < 1e-4


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_language_ppm(spark, sf).collect()
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.98 * len(out)


def test_odd_texts(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog " * 30, "en", 1), (2, "le chat et le chien " * 30, "fr", 2), (3, None, "en", 3), (4, "", None, 4), (5, "123 !!", "fr", 5), (6, "é" * 20_000, None, 6), (1, "the cat and the dog " * 30, "en", 1)],
        "doc_id long, text string, lang string, lang_pred int",
    ).withColumn("has letters ?", F.lit("x")).withColumn("letters", F.lit("y"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in ppm.identify(docs, ppm.fit(docs)).collect()}
    assert got[1][0] == "en" and got[2][0] == "fr" and got[6][0] in ("en", "fr")
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert {(r["has letters ?"], r["letters"]) for r in ppm.identify(docs, ppm.fit(docs)).collect()} == {("x", "y")}
    assert ppm.fit(docs.limit(0)) is None and ppm.fit(docs.where("lang is null")) is None
    assert ppm.identify(docs.limit(0), None).count() == 0
    assert {r.lang_pred for r in ppm.identify(docs, None).collect()} == {"und"}
