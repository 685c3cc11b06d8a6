import random

import numpy as np
from xxhash import xxh64_intdigest

from tideline.llm import hamming, queries, simhash
from tideline.llm.components import components


def brute_print(text, size=3):
    words = (text or "").encode().lower().split()
    runs = [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []
    hs = [xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius):
    """By key: the smallest key reachable. prints: (key, fingerprint)."""
    values = sorted({f for _, f in prints})
    of = {f: f for f in values}

    def root(f):
        while of[f] != f:
            f = of[f]
        return f

    arr = np.array(values, np.uint64)
    for f in values:
        for g in arr[np.bitwise_count(arr ^ np.uint64(f)) <= radius].tolist():
            a, b = root(f), root(g)
            of[max(a, b)] = min(a, b)
    least = {}
    for k, f in prints:
        least.setdefault(root(f), []).append(k)
    return [(k, f, min((x for x in least[root(f)] if x is not None), default=None)) for k, f in prints]


def test_trees_find_every_link():
    rng = np.random.default_rng(2)
    for radius, centres in ((2, 400), (9, 60)):
        seeds = rng.integers(0, 2**63, centres, dtype=np.uint64)
        points = []
        for s in seeds:
            for _ in range(rng.integers(1, 12)):
                f = s
                for b in rng.choice(64, rng.integers(0, 5), replace=False):
                    f ^= np.uint64(1) << np.uint64(b)
                points.append(f)
        points = np.unique(np.concatenate([np.array(points, np.uint64), seeds[:1] ^ np.arange(900, dtype=np.uint64)]))[:, None]
        n = len(points)
        full = hamming.Forest(n)
        d = np.bitwise_count(points ^ points.T)
        full.join(*np.nonzero(d <= radius))
        full.flatten()
        tree = hamming.Forest(n)
        hamming.link(points, np.arange(n), np.zeros(0, int), radius, tree)
        tree.flatten()
        assert (tree.of == full.of).all()
        top = hamming.TopTree(points[::3], 16, radius)
        row, leaf, own = top.deal(points)
        assert top.leaves > 4 and sorted(row[own]) == list(range(n))
        dealt = hamming.Forest(n)
        for k in range(top.leaves):
            here = leaf == k
            hamming.link(points, row[here & own], row[here & ~own], radius, dealt)
        dealt.flatten()
        assert (dealt.of == full.of).all()


def test_odd_texts_and_components(spark):
    rng = random.Random(8)
    base = [rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(400)]
    texts = [None, "", " \n", "one", "one two", "one two three", "ONE  two\tthree", "a\x1cb c", "é É"] + [" ".join(base)] * 4
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "one", 1), (5, "one two three", 1), (None, "alone here", 1)], "doc_id long, text string, f0 int")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_components([(k, brute_print(t)) for k, t in rows], 2)
    got = simhash.linked_fingerprints(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.f0 % 2**64, r.component_id) for r in got], key=key) == sorted(want, key=key)
    assert simhash.linked_fingerprints(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    got = dict((r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}


def test_op6_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {k: (f"{f:016x}", c) for k, f, c in brute_components([(k, brute_print(t)) for k, t in rows], 2)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, sf).collect()} == want


def brute_groups(texts, least=0.8, size=5):
    """For each text the number of its group: chains of pairs whose shingle sets have a Jaccard similarity of least or more."""
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if (w := t.lower().split()) else set() for t in texts]
    of = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b) - 1e-9:
                x, y = of[i], of[j]
                of = [min(x, y) if o in (x, y) else o for o in of]
    return of


def test_near_duplicates_are_exact_at_the_similarity(spark):
    """Pairs at 0.8 hang together, pairs just below and far below do not; a repeated line does not hide a pair."""
    rng = random.Random(4)
    made, texts = iter(range(10**6)), []

    def words(n):
        return [f"w{next(made)}" for _ in range(n)]

    for n in (40, 96, 300):
        for similarity in (0.60, 0.70, 0.75, 0.79, 0.8, 0.81, 0.9):
            for _ in range(4):
                # a common start of c shingles and an end of its own for each: c / (c + 2 x) is the similarity
                c = n * 4 // 5
                x = round((c / similarity - c) / 2)
                start = words(c + 4)
                texts += [" ".join(start + words(x)), " ".join(start + words(x))]
    line, start = words(12), words(300)
    texts += [" ".join(start + line * 60), " ".join(start + line), " ".join(words(30)), " ".join(words(30))]
    chain = words(260)
    texts += [" ".join(chain[k : k + 120]) for k in range(0, 60, 10)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string")
    want = brute_groups(texts)
    for how in ({}, {"held": 500}, {"held": 500, "meeting": 3}):
        groups = {r.doc_id: r.root for r in simhash.near_duplicate_groups(docs, **how).collect()}
        first = {}
        assert [first.setdefault(groups[i], i) for i in range(len(texts))] == want, how


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    """Null ids with near copies, and one id on texts of two groups."""
    text = lambda name, edit="": " ".join([*(f"{name}{i}" for i in range(120)), edit])
    rows = [(None, text("a"), 1), (None, text("a", "x"), 2), (None, text("a", "y"), 3), (None, text("b"), 4), (None, text("b"), 5)]
    rows += [(7, text("c"), 6), (7, text("d", "z"), 7), (3, text("d"), 8), (9, text("e"), 9), (9, text("f"), 10)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect()
    assert sorted(r.text[0] for r in kept) == list("abcdef") and {(r.doc_id, r.text[0]) for r in kept} == {(None, "a"), (None, "b"), (7, "c"), (3, "d"), (9, "e"), (9, "f")}


def test_similar_sets_of_any_size_share_a_meeting_key():
    """Pairs at a similarity of 0.8 or just above, of few shingles and many: none may be left without a key in common."""
    rng = np.random.default_rng(5)
    for n in (5, 6, 9, 10, 15, 25, 60, 200):
        pairs = 3000 if n < 100 else 600
        both = -(-4 * n // 5)
        union, left = rng.integers(0, 2**64, (pairs, n), dtype=np.uint64), rng.random((pairs, n - both)) < 0.5
        keys = []
        for side in (left, ~left):
            sets = [np.concatenate([u[:both], u[both:][x]]) for u, x in zip(union, side)]
            least = simhash.minima(np.concatenate(sets), np.array([len(x) for x in sets])).reshape(pairs, -1, simhash.BAND)
            keys.append(least)
        assert (keys[0] == keys[1]).all(2).any(1).all(), n


def test_planted_near_copies_are_caught(spark):
    """Copies of whole documents with words changed, dropped, put in or moved, at measured similarities of 0.8 and more: every one is found, and the texts it was made from stay apart from others."""
    rng = random.Random(11)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = lambda words: set(simhash.shingle_hashes(" ".join(words).encode().lower(), 5))
    planted, pairs, exact = [], [], []
    for r in rows:
        words = (r.text or "").split(" ")
        if len(words) < 40:
            continue
        own, copy = sets(words), list(words)
        for _ in range(rng.randrange(1, 1 + max(1, len(words) // 45))):
            k = rng.randrange(len(copy))
            how = rng.randrange(4)
            if how == 0:
                copy[k] = f"changed{rng.randrange(10**6)}"
            elif how == 1:
                del copy[k]
            elif how == 2:
                copy.insert(k, f"new{rng.randrange(10**6)}")
            else:
                copy.insert(rng.randrange(len(copy)), copy.pop(k))
        new = sets(copy)
        likeness = len(own & new) / len(own | new)
        if 0.8 <= likeness < 1:
            planted.append((10**6 + r.doc_id, " ".join(copy)))
            pairs.append((r.doc_id, 10**6 + r.doc_id))
            exact.append(likeness)
    assert len(pairs) > 300 and sum(x < 0.9 for x in exact) > 60
    docs = spark.createDataFrame([tuple(r) for r in rows] + planted, "doc_id long, text string")
    root = {r.doc_id: r.root for r in simhash.near_duplicate_groups(docs).collect()}
    caught = sum(root[a] == root[b] for a, b in pairs)
    assert caught == len(pairs)
