import itertools
import random
import zlib

from tideline.llm import queries, sharding


def test_differencing_is_near_the_best(spark=None):
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randrange(1, 40) for _ in range(7)]
        got = sharding.differencing(sizes, 3)
        sums = [sum(s for s, g in zip(sizes, got) if g == k) for k in range(3)]
        best = min(max(sum(s for s, g in zip(sizes, a) if g == k) for k in range(3)) for a in itertools.product(range(3), repeat=7))
        assert max(sums) <= best * 1.2 + 1
    assert sharding.differencing([], 4) == [] and sharding.differencing([8, 7, 6, 5, 4], 2).count(0) in (2, 3)


def plain_differencing(sizes, shards):
    """The sums of all shards, each partition a full list."""
    parts = [(size, i, [size] + [0] * (shards - 1)) for i, size in enumerate(sizes)]
    n = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p[0], p[1]))
        (_, _, a), (_, _, b), *parts = parts
        sums = sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)
        n += 1
        parts.append((sums[0] - sums[-1], n, sums))
    return parts[0][2]


def test_differencing_equals_the_plain_one():
    rng = random.Random(6)
    for shards, n in ((2, 9), (3, 40), (7, 5), (7, 60), (40, 300), (5, 1)):
        for _ in range(4):
            sizes = [rng.choice([rng.randrange(1, 50), rng.randrange(1, 10**6)]) for _ in range(n)]
            got = sharding.differencing(sizes, shards)
            assert sorted((sum(s for s, g in zip(sizes, got) if g == k) for k in range(shards)), reverse=True) == plain_differencing(sizes, shards)


def test_many_shards_take_memory_by_items():
    """60,000 items for 1000 shards: full lists would be 480 MB."""
    import tracemalloc

    rng = random.Random(2)
    sizes = sorted((rng.randrange(10**5, 10**6) for _ in range(60_000)), reverse=True)
    tracemalloc.start()
    got = sharding.differencing(sizes, 1000)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    sums = [0] * 1000
    for s, g in zip(sizes, got):
        sums[g] += s
    assert max(sums) - min(sums) < 0.001 * max(sums)


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 16, zlib.crc32(t))
        by.setdefault(r.shard, []).append(r)
    assert all(0 <= s < shards for s in by)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    where = {}
    for r in rows:
        assert where.setdefault(texts[r.doc_id] or "", r.shard) == r.shard
    return [sum(r.size for r in by.get(s, [])) for s in range(shards)]


def test_op10_balances_and_keeps_groups(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op10_karmarkar_karp(spark, sf).collect()
    sums = check(rows, texts, 40)
    assert max(sums) <= 1.02 * sum(sums) / 40
    # the query's shards are those of a plain differencing of the same groups and bundles
    sizes, total = {}, sum(sums)
    frame = spark.createDataFrame([(k, t or "") for k, t in texts.items()], "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) AS h").collect()
    size_of = {}
    for r in frame:
        size_of[r.h] = size_of.get(r.h, 0) + len((texts[r.doc_id] or "").encode()) + 16
    for h, n in size_of.items():
        item = ("own", h) if n > total // (40 * sharding.OWN_PART) else ("bundle", h % (40 * sharding.BUNDLES))
        sizes[item] = sizes.get(item, 0) + n
    assert sorted(sums, reverse=True) == plain_differencing(sorted(sizes.values(), reverse=True), 40)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_odd_rows(spark):
    texts = dict(enumerate([None, "", "", "same", "same", "é" * 50, "x" * 100_000] + ["same"] * 500))
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in texts.items()], "doc_id long, text string, shard int, slot string")
    check(sharding.shard_documents(docs, shards=5).collect(), texts, 5)
    assert sharding.shard_documents(docs.limit(0), shards=5).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None)], "doc_id long, text string")
    assert sorted(r.slot for r in sharding.shard_documents(twice, shards=1).collect()) == [0, 1, 2, 3]
