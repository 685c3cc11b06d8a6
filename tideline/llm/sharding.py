"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Groups of equal texts stay together. At any input size the differencing sees a bounded list: groups
above a share of all bytes stand for themselves (there can be only so many), the others
are bundled by the hash of their text into a fixed number of bundles.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Bundles for each shard, and the part of a shard's fair share from which a group is an item of its own (1 / OWN_PART).
BUNDLES, OWN_PART = 64, 256
#: Bytes added to each text's own.
ROW_BYTES = 16
#: Rows that number their slots in one task, about.
SLICE_ROWS = 20_000


def differencing(sizes: Sequence[int], shards: int) -> list[int]:
    """The shard of each item, by multi-way Karmarkar-Karp.

    Each item begins as a partition with one filled shard. The two partitions with the largest spread
    (largest less smallest sum) are joined again and again, the largest sums of one meeting the smallest of the other.
    A partition holds its filled shards only, largest first, each with one item that stands for all in it; so memory grows with the items, not with
    items times shards. No items: an empty list. Ties break by the order of items.
    """
    if shards == 1 or not len(sizes):
        return [0] * len(sizes)
    of = list(range(len(sizes)))  # of two items that meet the second is put under the first
    heap = [(-int(size), i, np.array([size], np.int64), np.array([i])) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        # b back to front ends at the last shard: what is beyond the free ones lies on a's smallest
        over = max(0, len(a) + len(b) - shards)
        apart = len(a) - over
        for x, y in zip(in_a[apart:].tolist(), in_b[::-1][:over].tolist(), strict=True):
            of[y] = x
        sums = np.concatenate([a[:apart], a[apart:] + b[::-1][:over], b[::-1][over:]])
        names = np.concatenate([in_a, in_b[::-1][over:]])
        order = np.argsort(-sums, kind="stable")
        sums, names = sums[order], names[order]
        n += 1
        least = int(sums[-1]) if len(sums) == shards else 0
        heapq.heappush(heap, (least - int(sums[0]), n, sums, names))
    shard_of = {name: k for k, name in enumerate(heap[0][3].tolist())}
    out = []
    for i in range(len(sizes)):
        path = []
        while of[i] != i:
            path.append(i)
            i = of[i]
        for x in path:
            of[x] = i
        out.append(shard_of[i])
    return out


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """key, size, text_crc32, shard, slot of every row; shards hold nearly equal bytes, equal texts share a shard.

    A null text is an empty one: size row_bytes, CRC 0, in the group of empty texts. Repeated rows each have a slot.
    Slots count from 0 without gaps in each shard, ordered by a slice of the key's hash, then by key. An empty table gives an empty result.
    Other columns are not read. A group larger than a shard's fair share has a shard by itself.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(key).alias("key"),
            (F.octet_length(body).cast("long") + F.lit(row_bytes)).alias("size"),
            F.crc32(body.cast("binary")).alias("crc"),
            F.xxhash64(body).alias("h"),
        ),
        "shard-rows",
    )
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cut = max(1, total // (shards * OWN_PART))
    groups = rows.groupBy("h").agg(F.sum("size").alias("size"))
    own = F.when(F.col("size") > cut, F.col("h"))
    bundle = F.pmod("h", F.lit(shards * BUNDLES))
    # at most shards * OWN_PART groups can be larger than cut, so this list has a fixed bound
    items = groups.groupBy(own.alias("own"), F.when(own.isNull(), bundle).alias("bundle")).agg(F.sum("size").alias("size")).collect()
    items.sort(key=lambda r: (-r["size"], r["own"] is None, r["own"] or 0, r["bundle"] or 0))
    chosen = differencing([r["size"] for r in items], shards)
    placed = spark.createDataFrame([(r["own"], r["bundle"], s) for r, s in zip(items, chosen, strict=True)], "own long, bundle long, shard int")
    by_own, by_bundle = placed.where("own is not null").select(F.col("own").alias("h"), F.col("shard").alias("s1")), placed.where("own is null").select("bundle", F.col("shard").alias("s2"))
    slices = max(1, n_rows // (shards * SLICE_ROWS))
    at = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(by_own), "h", "left")
        .join(F.broadcast(by_bundle), "bundle", "left")
        .select("key", "size", "crc", F.coalesce("s1", "s2").alias("shard"), F.pmod(F.xxhash64("key", F.lit("slice")), F.lit(slices)).alias("slice"))
    )
    # shards * slices small rows: the slots that come before each slice; both sides are dealt by shard and slice, so rows do not move for this join
    before = at.groupBy("shard", "slice").count().withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("slice")) - F.col("count")).drop("count")
    within = Window.partitionBy("shard", "slice").orderBy("key", "crc", "size")
    return at.withColumn("rank", F.row_number().over(within)).join(before, ["shard", "slice"]).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("rank") - 1 + F.col("before")).cast("long").alias("slot")
    )
