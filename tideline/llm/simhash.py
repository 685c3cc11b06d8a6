"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming distance by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise, numbered, small_batches, sorted_groups, tidy, views, whole_groups
from .components import components
from .hamming import PAIRS, Forest, TopTree, link
from .words import mix

SEED = 42
#: Text bytes whose shingles are looked at together.
SLICE = 1 << 20
#: Fingerprints that the top tree is grown from, and that a leaf holds, about. The sample is a fixed bound; beyond it leaves grow.
SAMPLE, LEAF = 16_384, 4096
#: Minima that a sketch keeps, and how many in a row make a key under which documents meet.
MINIMA, BAND = 63, 3


def shingle_hashes(body: bytes, size: int) -> list[int]:
    """XXH64 of each run of `size` words of lower-cased bytes, joined by single spaces; of all words, if there are fewer."""
    from xxhash import xxh64_intdigest

    words = body.split()
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[i] hashes the word whose bits are set in over half of them; 0 for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    some = counts > 0
    if not some.any():
        return out
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = (np.cumsum(counts) - counts)[some]
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > counts[some][:, None], axis=1, bitorder="little")
    out[some] = packed.view("<u8").ravel()
    return out


def minima(hashes: np.ndarray, counts: np.ndarray, n: int = MINIMA) -> np.ndarray:
    """For each run the smallest hash in each of n bins; an empty bin takes the next filled one's, mixed with its distance."""
    out = np.full((len(counts), n), np.iinfo(np.uint64).max, np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    values = mix(hashes)
    at = row * n + (values % np.uint64(n)).astype(np.int64)
    order = np.lexsort((values, at))
    at, values = at[order], values[order]
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    out.reshape(-1)[at[first]] = values[first]
    empty = out == np.iinfo(np.uint64).max
    open_, true = empty & ~empty.all(1, keepdims=True), out.copy()
    for shift in range(1, n):
        r, c = np.nonzero(open_)
        if not len(r):
            break
        lender = (c + shift) % n
        lent = ~empty[r, lender]
        out[r[lent], c[lent]] = mix(true[r[lent], lender[lent]] + np.uint64(shift))
        open_[r[lent], c[lent]] = False
    return out


def _kernel(size: int, wide: int, bands: bool):
    """From key and text to fingerprint words. With bands the shingles count as a set, and its meeting keys, its hash (node) and its size follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            prints, keys, nodes, sizes = [], [], [], []
            for a, b, raw, offsets in views(batch.column(1), SLICE):
                body, at = raw.tobytes().lower(), offsets.tolist()
                each = [shingle_hashes(body[x:y], size) for x, y in zip(at, at[1:], strict=False)]
                if bands:
                    each = [np.unique(np.array(x, np.uint64)) for x in each]
                    nodes += [xxh64_intdigest(x.astype("<u8").tobytes(), SEED) for x in each]
                    sizes += [len(x) for x in each]
                counts = np.array([len(x) for x in each], np.int64)
                hashes = np.concatenate(each) if bands else np.array([h for x in each for h in x], np.uint64)
                words = [majority(hashes if w == 0 else mix(hashes + np.uint64(w)), counts) for w in range(wide)]
                prints.append(np.stack(words, 1).view(np.int64))
                if bands:
                    least = minima(hashes, counts).reshape(b - a, -1, BAND)
                    keys.append(mix(mix(mix(least[:, :, 0]) + least[:, :, 1]) + least[:, :, 2] + np.arange(least.shape[1], dtype=np.uint64)).view(np.int64))
            prints = np.concatenate(prints) if prints else np.zeros((0, wide), np.int64)
            columns = [batch.column(0), *(pa.array(prints[:, w]) for w in range(wide))]
            if bands:
                keys = np.concatenate(keys) if keys else np.zeros((0, MINIMA // BAND), np.int64)
                offs = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
                columns += [pa.ListArray.from_arrays(offs, pa.array(keys.ravel())), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(np.array(sizes, np.int64))]
            columns += batch.columns[2:]
            names = ["key", *(f"f{w}" for w in range(wide)), *(["bands", "node", "size"] if bands else []), *batch.schema.names[2:]]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _digest(text: str) -> Column:
    """Names a text; a null is an empty one."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def fingerprints(docs: DataFrame, size: int = 3, wide: int = 1, bands: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, f0 .. (64 bits each, as signed), and with bands an array of meeting keys, node (a hash of the set of shingles), size (of that set) and digest (of the text), of every whole text.

    A-Z is lower-cased; words are parted by ASCII white space. A text with fewer words than a shingle is one shingle; a null text, or one
    without words, has fingerprint zero (and the meeting keys of all such texts). f0 is the plain SimHash of XXH64 with seed 42; further words take other mixes of the same hashes.
    With bands a shingle that is repeated counts once.
    """
    frame = small_batches(docs).select(F.col(key).alias("key"), F.col(text), *([_digest(text).alias("digest")] if bands else []))
    more = [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), T.StructField("digest", T.StringType())]
    schema = T.StructType([frame.schema[0], *(T.StructField(f"f{w}", T.LongType()) for w in range(wide)), *(more if bands else [])])
    return frame.mapInArrow(tidy(_kernel(size, wide, bands)), schema)


def _stars(points: np.ndarray, names: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, name of the one that it hangs together with) for each point that has a link."""
    forest = Forest(len(points))
    link(points, np.flatnonzero(home), np.flatnonzero(~home), radius, forest)
    forest.flatten()
    linked = np.flatnonzero(forest.of != np.arange(len(points)))
    return names[linked], names[forest.of[linked]]


def tree_links(prints: DataFrame, radius: int, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """a, b: links that join all distinct 64-bit fingerprints (column f0) within radius, through shards of a vantage-point tree.

    The tree's upper part is grown on the driver from a bounded sample. Each fingerprint lives in one leaf and visits those whose border is
    within radius; every pair within it so meets in one leaf at least. A leaf returns a link for each point at most, not its pairs.
    """
    n = prints.count()
    share = min(1.0, sample / max(1, n))
    picked = prints.where(F.xxhash64("f0", F.lit("top")).bitwiseAND(F.lit(2**31 - 1)) < F.lit(int(share * 2**31))).select("f0").toArrow().column("f0").to_numpy()
    tree = TopTree(np.sort(picked).view(np.uint64)[:, None], max(1, -(-n // leaf)), radius)
    shipped = prints.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy()
            row, at, own = shipped.value.deal(f.view(np.uint64)[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(f[row]), pa.array(own)], ["leaf", "f0", "own"])

    def join(group: pa.Table) -> pa.Table:
        f = group.column("f0").to_numpy()
        a, b = _stars(f.view(np.uint64)[:, None], f, group.column("own").to_numpy(), radius)
        return pa.table({"a": a, "b": b})

    return prints.select("f0").mapInArrow(tidy(deal), "leaf long, f0 long, own boolean").groupBy("leaf").applyInArrow(join, "a long, b long")


def linked_fingerprints(docs: DataFrame, size: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, f0, component_id for every row: the smallest key reachable over links of radius or fewer differing bits.

    Equal fingerprints are one point of the search, so copies cost nothing. Rows with a null key take part and have their component's id,
    null if no key is in it. Repeated rows stay. An empty table gives an empty result.
    """
    rows = materialise(fingerprints(docs, size, 1, False, key, text), "prints")
    points = rows.groupBy("f0").agg(F.min("key").alias("least"))
    roots = components(tree_links(materialise(points, "points"), radius))
    placed = points.join(roots, points.f0 == roots.node, "left").select("f0", "least", F.coalesce("root", "f0").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = placed.join(ids, "root").select("f0", "component_id")
    return rows.join(by_print, "f0").select(F.col("key").alias(key), "f0", "component_id")


#: Near-duplicates: words of a shingle, the similarity (Jaccard, of sets of shingles) from which texts are linked, fingerprint words of 64 bits, and the
#: share of bits that may differ before a pair is out unmeasured: at the similarity 15 % are expected, 19 % of the smallest sets', and 35 % is six deviations off.
NEAR_WORDS, NEAR_LEAST, NEAR_WIDE, NEAR_SHARE = 5, 0.8, 4, 0.35
#: Texts under one meeting key that are compared in one task; a key with more is split into pairs of parts.
MEETING = 20_000
#: Shingles that a task holds of each part of a group; a group with more is met by meeting key, and that in pairs of parts.
HELD = 2_000_000
#: Groups up to this size are compared all at once, over a whole partition.
SMALL = 12


def _meet(wide: int, radius: int):
    """Links among the fingerprints under each meeting key, as the sorted keys come by: a star for each set that hangs together, not its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept in whole_groups(batches, 3):
            yield joined(*(c.to_numpy() for c in kept.columns))

    def joined(band, low, high, part, node, *words) -> pa.RecordBatch:
        points = np.stack(words, 1).view(np.uint64)
        names, index = np.unique(node, return_inverse=True)
        forest = Forest(len(names))
        new = np.append(True, (band[1:] != band[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(band)))
        member = np.repeat(np.arange(len(first)), size)
        small = (size <= SMALL)[member]
        for d in range(1, SMALL):
            a = np.flatnonzero(small[:-d] & (member[:-d] == member[d:])) if len(member) > d else np.zeros(0, np.int64)
            if not len(a):
                break
            near = np.bitwise_count(points[a] ^ points[a + d]).sum(1, dtype=np.int32) <= radius
            forest.join(index[a[near]], index[a[near] + d])
        for k in np.flatnonzero(size > SMALL).tolist():
            rows = np.arange(first[k], first[k] + size[k])
            own = Forest(len(rows))
            home = part[rows] == low[rows[0]]
            link(points[rows], np.flatnonzero(home), np.flatnonzero(~home), radius, own)
            own.flatten()
            forest.join(index[rows], index[rows[own.of]])
        forest.flatten()
        at = np.flatnonzero(forest.of != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(names[forest.of[at]])], ["a", "b"])

    return run


def _sets(size: int):
    """From text, the first column, to the sorted hashes of its shingles; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for _, _, raw, offsets in views(batch.column(0), SLICE):
                body, at = raw.tobytes().lower(), offsets.tolist()
                sets += [np.unique(np.array(shingle_hashes(body[x:y], size), np.uint64)).tobytes() for x, y in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *batch.columns[1:]], ["shingles", *batch.schema.names[1:]])

    return run


def link_similar(sets: list[np.ndarray], points: np.ndarray, part: np.ndarray, bands: np.ndarray, radius: int, least: float) -> Forest:
    """Joins all pairs of sorted sets with a Jaccard similarity of `least` or more that share a meeting key and whose points are within radius; of parts that differ, if there are any.

    So the size of the group that two sets are met in doesn't matter: a pair is linked wherever its meeting key is.
    Sets that hang together already are not measured again.
    """
    n = len(sets)
    forest, size, across = Forest(n), np.array([len(x) for x in sets]), bool((part != part[0]).any())
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        fits = (forest.of[rest] != forest.of[i]) & (np.minimum(size[rest], size[i]) >= least * np.maximum(size[rest], size[i]) - 1e-9)
        if across:
            fits &= part[rest] != part[i]
        rest = rest[fits]
        rest = rest[(bands[rest] == bands[i]).any(1)]
        rest = rest[np.bitwise_count(points[rest] ^ points[i]).sum(1, dtype=np.int32) <= radius]
        if not len(rest) or not size[i]:
            continue
        for at in np.split(rest, np.flatnonzero(np.diff(np.cumsum(size[rest]) // PAIRS)) + 1):
            theirs = np.concatenate([sets[j] for j in at])
            where = np.minimum(np.searchsorted(sets[i], theirs), size[i] - 1)
            both = np.add.reduceat((sets[i][where] == theirs).astype(np.int64), np.cumsum(size[at]) - size[at])
            near = at[both >= least * (size[i] + size[at] - both) - 1e-9]
            forest.join(near, np.full(len(near), i))
    return forest


def _measure(wide: int, radius: int, least: float):
    """Links among the sets of each group, as the sorted groups come by: a star for each set that hangs together, not its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept in whole_groups(batches, 4):
            root, band, low, high, part, node, *words = (kept.column(k).to_numpy() for k in ("root", "band", "low", "high", "part", "node", *(f"f{w}" for w in range(wide))))
            new = np.append(True, np.any([x[1:] != x[:-1] for x in (root, band, low, high)], axis=0))
            points = np.stack(words, 1).view(np.uint64)
            bands, shingles = kept.column("bands"), kept.column("shingles")
            for a, b in zip(np.flatnonzero(new).tolist(), [*np.flatnonzero(new)[1:].tolist(), len(kept)], strict=True):
                own = np.array(bands.slice(a, b - a).to_pylist(), np.int64)
                sets = [np.frombuffer(x, np.uint64) for x in shingles.slice(a, b - a).to_pylist()]
                forest = link_similar(sets, points[a:b], part[a:b], own, radius, least)
                at = np.flatnonzero(forest.of != np.arange(b - a))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a + at]), pa.array(node[a + forest.of[at]])], ["a", "b"])

    return run


def _proposed(points: DataFrame, f: list[str], radius: int, meeting: int) -> DataFrame:
    """node, root: what hangs together over pairs that share a meeting key and differ in radius bits or fewer. A similar pair has one root."""
    meet = points.select("node", *f, F.explode(F.array_distinct("bands")).alias("band"))
    met = meet.groupBy("band").count().where("count > 1").select("band", F.ceil(F.col("count") / meeting).cast("int").alias("parts"))
    dealt = meet.join(met, "band").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", *f)
    links = sorted_groups(dealt, "band", "low", "high").mapInArrow(tidy(_meet(len(f), radius)), "a long, b long")
    return components(links)


def near_duplicate_groups(docs: DataFrame, size: int = NEAR_WORDS, wide: int = NEAR_WIDE, share: float = NEAR_SHARE, meeting: int = MEETING, key: str = "doc_id", text: str = "text", least: float = NEAR_LEAST, held: int = HELD) -> DataFrame:
    """key, digest (of the text), node, root for every row: rows with one root are near-duplicates of each other, directly or over others.

    Two texts are linked if the Jaccard similarity of their sets of shingles is `least` or more, measured on the sets. Pairs are proposed by a meeting key,
    which is made of three of 63 minima of the shingles, and by SimHash fingerprints of 64 * wide bits that differ in at most `share` of the bits: at a similarity
    of 0.8, one key of 21 fails to be shared with all others less than once in a million for sets of some hundred shingles. Texts with the same shingles are one node.
    What proposals join is measured pair by pair where a meeting key is shared: in one place, to which each set is sent once, or, beyond `held` shingles, by meeting key. The links are the same either way.
    """
    prints = materialise(fingerprints(docs, size, wide, True, key, text), "sketches")
    f, radius = [f"f{w}" for w in range(wide)], int(share * 64 * wide)
    points = prints.groupBy("node").agg(*(F.first(c).alias(c) for c in f), F.first("bands").alias("bands"), F.first("size").alias("size"), F.min("digest").alias("digest"))
    points = points.join(_proposed(points, f, radius, meeting), "node")
    total = (F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    whole = points.groupBy("root").agg(*total).select("root", ((F.col("n") <= meeting) & (F.col("total") <= held)).alias("whole"))
    keyed = points.join(whole, "root").withColumn("band", F.explode(F.when(F.col("whole"), F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct("bands"))))
    parts = F.greatest(F.ceil(F.col("n") / meeting), F.ceil(F.col("total") / held)).cast("int")
    met = keyed.groupBy("root", "band").agg(*total).where("n > 1").select("root", "band", parts.alias("parts"))
    places = keyed.join(met, ["root", "band"]).groupBy("node", "digest", "root", "bands", *f).agg(F.collect_list(F.struct("band", "parts")).alias("places"))
    # one text for each digest before the join: copies of one text never meet in a task
    texts = small_batches(docs).select(F.coalesce(F.col(text), F.lit("")).alias("body"), _digest(text).alias("digest")).groupBy("digest").agg(F.first("body").alias("body"))
    chosen = texts.join(places, "digest").select("body", "node", "root", "bands", *f, "places")
    schema = T.StructType([T.StructField("shingles", T.BinaryType()), *chosen.schema[1:]])
    dealt = chosen.mapInArrow(tidy(_sets(size)), schema).select("*", F.inline("places")).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("root", "band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "bands", *f, "shingles")
    links = sorted_groups(dealt, "root", "band", "low", "high").mapInArrow(tidy(_measure(wide, radius, least)), "a long, b long")
    roots = components(links)
    return prints.select("key", "digest", "node").join(roots, "node", "left").select(F.col("key").alias(key), "digest", "node", F.coalesce("root", "node").alias("root"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest key, a null key being smaller than all.

    Of each group exactly one row stays, whatever the keys: of equal keys the one with the smallest digest of its text. Texts without words, nulls among them, are near-duplicates of each other.
    Columns are those of docs, whatever their names. An empty table gives an empty result.
    """
    frame, at = numbered(docs)
    groups = near_duplicate_groups(frame, key=at[key], text=at[text], **how)
    least = F.min(F.struct(F.col(at[key]).isNotNull().alias("has"), F.col(at[key]).alias("key"), "digest"))
    # a name for each key, null as well: texts are dealt by it and their digest once, for the join and for the rows that are alike
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    keepers = groups.groupBy("root").agg(least.alias("k")).select(name(F.col("k.key")).alias("name"), F.col("k.digest").alias("same"))
    named = frame.withColumns({"name": name(F.col(at[key])), "same": _digest(at[text])})
    # a text has one root, so a key and a text are those of one group
    kept = named.join(keepers, ["name", "same"], "left_semi")
    again = Window.partitionBy("name", "same").orderBy(at[key])
    return kept.withColumn("nth", F.row_number().over(again)).where("nth = 1").select(*frame.columns).toDF(*docs.columns)
