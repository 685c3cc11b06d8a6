import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tideline.llm import lm, queries
from tideline.llm.eliasfano import EliasFano, Level, Trie


def test_elias_fano_against_a_sorted_array(tmp_path):
    rng = np.random.default_rng(3)
    for values in ([], [0], [5, 5, 5], [2**64 - 1], [0, 2**63, 2**64 - 1], np.sort(rng.integers(0, 2**63, 3000, dtype=np.uint64)), np.sort(rng.integers(0, 300, 1000)), np.arange(100) * 7):
        v = np.array(values, np.uint64)
        e = EliasFano.of(v)
        assert (e.get(np.arange(len(v))) == v).all()
        ask = np.unique(np.concatenate([v, v + np.uint64(1), rng.integers(0, 2**64, 50, dtype=np.uint64), np.array([0], np.uint64)]))
        assert (e.successor(ask) == np.searchsorted(v, ask)).all()
        assert ((e.find(ask) >= 0) == np.isin(ask, v)).all()


def test_successors_between_bounds():
    rng = np.random.default_rng(8)
    v = np.sort(rng.integers(0, 500, 300)).astype(np.uint64)
    e, ask = EliasFano.of(v), np.arange(520, dtype=np.uint64)
    for a, b in ((0, 300), (0, 0), (40, 41), (100, 250), (299, 300), (300, 300)):
        want = a + np.searchsorted(v[a:b], ask)
        assert (e.successor(ask, np.full(520, a), np.full(520, b)) == want).all()


def test_trie_over_a_memory_map(tmp_path):
    words, counts = np.array([3, 90, 2**60], np.uint64), np.array([5, 1, 2**40])
    owner, contexts, tops, downs = np.array([0, 0, 2]), np.array([7, 2**32 - 1, 0], np.uint32), np.array([-1.0, -2.0, -3.5]), np.array([0.0, 0.5, 9.0])
    under, second, thirds = np.array([0, 2, 2]), np.array([2**32 - 1, 0, 1], np.uint32), np.array([-0.25, -0.5, -8.0])
    with open(tmp_path / "t", "wb") as f:
        layout = Trie.build(words, counts, (owner, contexts), tops, downs, (under, second), thirds).write(f)
    t = Trie.open(np.memmap(tmp_path / "t", np.uint8, "r"), layout)
    at, n = t.lookup(np.array([3, 4, 2**60, 2**63], np.uint64))
    assert at.tolist() == [0, -1, 2, -1] and n.tolist() == [5, 0, 2**40, 0]
    pair = t.pairs.find(np.array([0, 0, 0, 2, 1, -1, 2]), np.array([7, 8, 2**32 - 1, 0, 7, 7, 7], np.uint32))
    assert pair.tolist() == [0, -1, 1, 2, -1, -1, -1]
    assert t.tops.get(pair, np.full(7, -9.0)) == pytest.approx([-1, -9, -2, -3.5, -9, -9, -9], abs=1e-4)
    assert t.downs.get(pair, np.full(7, -9.0)) == pytest.approx([0, -9, 0.5, 9, -9, -9, -9], abs=1e-4)
    triple = t.triples.find(np.array([0, 0, 1, 2, 2, 2, -1]), np.array([2**32 - 1, 0, 0, 0, 1, 2, 0], np.uint32))
    assert triple.tolist() == [0, -1, -1, 1, 2, -1, -1]
    assert t.thirds.get(triple, np.zeros(7)) == pytest.approx([-0.25, 0, 0, -0.5, -8, 0, 0], abs=1e-4)


def test_a_level_against_a_set():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 50, 2000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 90, 2000).astype(np.uint64))
    level = Level.of(60, (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    above, context = (x.ravel() for x in np.meshgrid(np.arange(-1, 60), np.arange(100)))
    where = {int(k): i for i, k in enumerate(keys)}
    assert level.find(above, context.astype(np.uint32)).tolist() == [where.get((a << 32) | c, -1) if a >= 0 else -1 for a, c in zip(above.tolist(), context.tolist())]


def test_tokens_that_share_their_upper_half_keep_their_order():
    token, context = np.array([5, 4, 5, 4, 2**40], np.uint64), np.array([1, 2, 0, 3, 9], np.uint32)
    order = lm._in_order(token, context)
    assert list(zip(token[order].tolist(), context[order].tolist())) == sorted(zip(token.tolist(), context.tolist()))


def brute(rows, prior, weight=lm.PAIR_WEIGHT):
    """rows: (text, train). By row: (tokens, known, N, base, score)."""
    split = [("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() + [None]) for t, _ in rows]
    one, two, three = Counter(), Counter(), Counter()
    for w, (_, train) in zip(split, rows):
        if train:
            one.update(w)
            two.update(zip(["<s>", *w], w))
            three.update(zip(["<s>", "<s>", *w], ["<s>", *w], w))
    total, kinds, texts = sum(one.values()), len(one), sum(bool(t) for _, t in rows)
    first = {**one, "<s>": texts}
    second = {**two, ("<s>", "<s>"): texts}
    out = []
    for w in split:
        base = sum(math.log10((one[x] + 1) / (total + kinds + 1)) for x in w)
        score = 0.0
        for v, u, x in zip(["<s>", "<s>", *w], ["<s>", *w], w):
            n = first.get(u, 0)
            above = three[v, u, x] + weight * (two[u, x] + prior * (one[x] + 1) / (total + kinds + 1))
            score += math.log10(above / (second.get((v, u), 0) + weight * (n + prior)))
        out.append((len(w), sum(one[x] > 0 for x in w), total, base, score))
    return out


def same(got, want):
    assert got[:3] == want[:3]
    assert got[3] == pytest.approx(want[3], rel=1e-9) and got[4] == pytest.approx(want[4], rel=1e-4, abs=1e-3)


def test_odd_texts_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(None, True), ("", False), (" \n ", True), ("Word", True), ("word WORD\x0bé\x1cÉ", None), ("x " * 30_000, True)]
    rows += [(" ".join(rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(rng.randrange(80))), rng.random() < 0.7) for _ in range(100)]
    rows += rows[3:5]
    docs = spark.createDataFrame([(i, t, k, 1.0) for i, (t, k) in enumerate(rows)] + [(None, "word", False, 1.0)], "doc_id long, text string, learn boolean, score double")
    want = brute([*rows, ("word", False)], 20.0)
    for shards in (1, 5):
        got = lm.score(docs, "learn", prior=20.0, least_shards=shards).collect()
        assert len(got) == len(want)
        for r in got:
            same((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), want[-1 if r.doc_id is None else r.doc_id])


def test_many_tiny_texts(spark):
    """More rows in a shard than 16 bits count."""
    docs = spark.range(70_000).selectExpr("id as doc_id", "if(id % 2 = 0, 'a b', 'b') as text", "true as learn")
    got = lm.score(docs, "learn", prior=20.0, least_shards=1)
    want = brute([("a b", True), ("b", True)] * 35_000, 20.0)[:2]
    for r in got.where("doc_id in (0, 1, 69998, 69999)").collect():
        same((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), want[r.doc_id % 2])
    assert got.groupBy("n_tokens", "n_known").count().count() == 2


def test_words_in_parts_sum_to_the_same(spark, monkeypatch, tmp_path):
    """One shard by hand, in this process, with tiny parts."""
    import pyarrow as pa

    rng = random.Random(4)
    rows = [(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40))), rng.random() < 0.6) for _ in range(30)]
    batch = pa.RecordBatch.from_pydict({"key": list(range(30)), "text": [t for t, _ in rows], "train": [k for _, k in rows]})
    want = brute(rows, 9.0, 0.25)
    texts = sum(k for _, k in rows)
    kinds = len({w for t, k in rows if k for w in t.split()} | {None})
    asks = pa.Table.from_batches(list(lm._ask(1, np.zeros(0, np.uint64))(iter([batch]))))
    shard = asks.filter(pa.array([x >= 0 for x in asks.column("shard").to_pylist()]))
    for part in (1, 7, 10**6):
        monkeypatch.setattr(lm, "PART_TOKENS", part)
        sums = lm._answer(want[0][2], kinds, 9.0, 0.25, np.zeros(0, np.uint64), np.zeros(0, np.int64), f"file://{tmp_path}")(shard)
        score = np.frombuffer(sums.column("score")[0].as_py())
        assert len(score) == 30
        known = np.frombuffer(sums.column("known")[0].as_py(), np.int32)
        for s, k, w in zip(score, known, want):
            assert k == w[1] and s - math.log10(texts + 0.25 * (texts + 9.0)) == pytest.approx(w[4], abs=1e-3)


def test_no_rows_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, learn boolean")
    assert lm.score(docs.limit(0), "learn").count() == 0
    r = lm.score(docs, "learn").first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == 0


def test_op4_against_brute_force_and_held_out_likelihood(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    want = dict(zip([k for k, _ in rows], zip(held, brute([(t, not h) for (_, t), h in zip(rows, held)], lm.PRIOR)), strict=True))
    got = queries.op4_elias_fano_lm(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        h, w = want[r.doc_id]
        assert r.held_out == h
        same((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), w)
    out = [r for r in got if r.held_out]
    # beyond the base by more than half a digit a token
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.5 * sum(r.n_tokens for r in out)


def test_words_split_over_shards(spark):
    """Two words that are more than half a shard: scores are those of any number of shards."""
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("aaaabbbcc" + "defghijklmnopqrstuvwxyz" * 2) for _ in range(rng.randrange(60))), rng.random() < 0.8) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "doc_id long, text string, learn boolean")
    want = brute(rows, 20.0, 0.1)
    got = lm.score(docs, "learn", prior=20.0, pair_weight=0.1, least_shards=12).collect()
    assert len(got) == len(want)
    for r in got:
        same((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), want[r.doc_id])


def test_short_texts_after_known_and_unknown_beginnings(spark):
    texts, words = ["a b c", "a b d", "b c a b", "d a"], ["a", "b", "c", "d", "zz"]
    heads = ["a b", "b c", "d", "q q"]
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(100 * (k + 1) + j, f"{h} {w}" if w else h, False) for k, h in enumerate(heads) for j, w in enumerate([*words, ""])]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), "learn", prior=2.0, pair_weight=0.5, least_shards=1).collect()}
    want = brute([(t, k) for _, t, k in rows], 2.0, 0.5)
    for (i, *_), w in zip(rows, want, strict=True):
        assert got[i] == pytest.approx(w[4], abs=1e-3)
