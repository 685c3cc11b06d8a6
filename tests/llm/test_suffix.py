import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tideline.llm import queries, suffix


def brute(texts, length):
    """By row: (bytes, removed, spans, hash of what is left)."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(150):
        x = np.array([rng.choice([0, 1, 2, 256]) for _ in range(rng.randrange(1, 90))], np.int64)
        order, place = suffix.suffix_array(x)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        got = suffix.common_prefixes(x, order, place, np.array([0]), np.array([len(x)]), 12)
        for i in range(len(x)):
            h = 0
            if place[i]:
                j = order[place[i] - 1]
                while h < 12 and i + h < len(x) and j + h < len(x) and x[i + h] == x[j + h]:
                    h += 1
            assert got[i] == h


def test_merge_by_binary_search():
    parts = [np.array(x, suffix.PAIR) for x in ([(1, 0), (2, 5), (9, 9)], [(2, 5)], [(0, 0), (9, 8)])]
    assert [x.tolist() for x in suffix.merge_kinds(parts)] == [[False, True, False], [True], [False, False]]


def made_up():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [text(70) for _ in range(6)]
    texts = [None, "", "a" * 19, "a" * 20, "a" * 21, "ab" * 40, text(3000)]
    for _ in range(60):
        parts = [text(rng.randrange(60)) for _ in range(3)]
        texts.append(parts[0] + rng.choice(shared)[rng.randrange(10) :] + parts[1] + rng.choice([rng.choice(shared), ""]) + parts[2])
    texts += texts[8:11] + [texts[8]] * 40
    return texts


@pytest.mark.parametrize("how", [{}, {"shard_runs": 3}, {"shard_bytes": 300}])
def test_made_up_texts_against_brute_force(spark, how):
    texts = made_up()
    docs = spark.createDataFrame([(i if i % 9 else None, i, t, "x") for i, t in enumerate(texts)], "doc_id long, at long, text string, kept string")
    got = suffix.remove_repeats(docs, length=20, piece=6, **how).collect()
    want = brute(texts, 20)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) == want[r.at]


def test_long_texts_in_parts_have_the_same_windows():
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 500, 19, 20, 21, 300)]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    def windows(part):
        out = []
        for first, skip, body, offs in suffix._parts(raw, offsets, 20, part):
            h, _, r, s, w = suffix.piece_runs(body, offs, 20, 6)
            out += [(int(x), int(first + y), int(skip + z + k)) for x, y, z, n in zip(h, r, s, w) for k in range(n)]
        return sorted(out)

    assert windows(1 << 20) == windows(64) == windows(20)
    assert len(windows(64)) == sum(max(0, len(t) - 19) for t in texts)


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x" * 30 + "tail"), (1, "x" * 30 + "tail"), (2, "no")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in suffix.remove_repeats(docs, length=20, piece=6).collect())
    assert got == [(1, 34), (1, 34), (2, 0)]
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


def test_op5_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = dict(zip([k for k, _ in rows], brute([t for _, t in rows], 200), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_suffix_repeats(spark, sf).collect()}
    assert got == want and sum(x[1] > 0 for x in got.values()) > 10
