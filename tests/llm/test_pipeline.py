import random

import numpy as np

import corpus_pipeline
from tideline.llm import simhash, suffix

SF = "/root/testdata/sf0.01"


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_duplicates_against_jaccard(spark):
    """All pairs from 0.85 hang together, none that hang together directly are below 0.5."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    sets = {k: shingles(t) for k, t in rows}
    got = {r.doc_id: r.root for r in simhash.near_duplicate_groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert set(got) == set(sets)
    index = {}
    for k, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(k)
    pairs = {(a, b) for ks in index.values() for a in ks[:60] for b in ks[:60] if a < b}
    best = {}
    for a, b in pairs:
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        best[a], best[b] = max(best.get(a, 0), j), max(best.get(b, 0), j)
        if j >= 0.85:
            assert got[a] == got[b], (a, b, j)
    groups = {}
    for k, r in got.items():
        groups.setdefault(r, []).append(k)
    assert all(best[k] >= 0.5 for ks in groups.values() if len(ks) > 1 for k in ks)


def test_hot_meeting_keys_are_split_without_loss(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefghijkl") * rng.randrange(1, 5) for _ in range(300)]
    rows = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(300)] = f"edit{i}"
        rows.append((i, " ".join(w), "s"))
    rows += [(1000 + i, " ".join(rng.choice("mnopqrstuv") * rng.randrange(1, 5) for _ in range(200)), "s") for i in range(20)]
    rows += [(None, rows[95][1], "s"), (1001, rows[91][1], "s"), (2000, None, "s"), (2001, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    for meeting in (20_000, 10):
        kept = simhash.drop_near_duplicates(docs, meeting=meeting).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept) == sorted([(True, 0), *((True, 1000 + i) for i in range(20) if i != 5), (False, 0), (True, 2000)])
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_drop_repeats_keeps_text_valid(spark):
    passage = "é" * 150
    docs = spark.createDataFrame([(1, "a" + passage + "b", 3), (2, "xy" + passage, 4), (3, None, 5), (4, "alone", 6)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r.text for r in suffix.drop_repeats(docs).collect()}
    assert got == {1: "ab", 2: "xy", 3: None, 4: "alone"}


def test_drop_repeats_leaves_marks_that_stood_in_the_text(spark):
    """U+FFFD stays, cut or not; halves of two characters do not make a third."""
    passage = "\u00fc".encode()[1:] + b"p" * 250 + "\u00e9".encode()[:1]
    cut = [(b"\xef\xbf\xbda\xc3" + passage + b"\xa9b\xef\xbf\xbd").decode(), (b"1\xc4" + passage + b"\xa82").decode()]
    docs = spark.createDataFrame([(1, cut[0]), (2, cut[1]), (3, "clean \ufffd text"), (4, "\ufffd")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffix.drop_repeats(docs).collect()} == {1: "\ufffdab\ufffd", 2: "12", 3: "clean \ufffd text", 4: "\ufffd"}


def test_stages_in_turn(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialise(stage(spark, docs, SF), f"t{k}")
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) <= kept
        if k < 4:
            assert out.columns == columns
        if k == 0:
            assert 0.7 * len(kept) < len(ids) < len(kept)
        if k == 1:
            sets = {r.doc_id: shingles(r.text) for r in rows}
            assert len({frozenset(s) for s in sets.values()}) == len(sets)
        if k == 2:
            assert set(ids) == kept and all(len(r.text) == r.n_chars for r in rows)
        if k == 4:
            assert set(ids) == kept and all(r.n_tokens == len(np.frombuffer(bytes(r.ids), "<u4")) for r in rows)
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.n_bytes == len(texts[r.doc_id].encode()) for r in rows)
        docs, kept = out, set(ids)
    assert labels and len(kept) > 500


def test_run_has_all_that_the_stages_leave(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids", "n_bytes"] and got.count() > 50
