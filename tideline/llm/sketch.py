"""Document fingerprints: all hashes of word shingles below a fixed mark, which estimate how much of one text another one holds, however unequal they are.

The mark is the same for all texts, so sketches can be merged: the sketch of two texts together is made of their sketches alone. A text whose hashes
are all above the mark keeps the smallest, which merging respects; so only a text without words has an empty sketch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy, views

#: Words of a shingle, and the part of all hashes that is kept (1 / SCALED).
SIZE, SCALED = 5, 8
#: A shingle's hash is the sum of its words' hashes times the powers of this odd number, modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
#: Words whose hashes a worker remembers; beyond it, it starts anew.
MEMORY = 200_000
#: Documents that are put in order together, about, and the most such buckets; beyond that they grow.
BUCKET_ROWS, BUCKETS = 512, 32_768
DIGITS = 16


class WordHashes(dict):
    """The first 64 bits of a word's MD5, big-endian."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = out = int.from_bytes(hashlib.md5(word).digest()[:8], "big")
        return out


def shingles(words: np.ndarray, counts: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of size words, its row), from the words' hashes and the number of words in each row. A row of fewer words, but not none, has one run."""
    row = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words from here to the row's end
    total, power = words.copy(), 1
    for j in range(1, size):
        power = power * FACTOR % 2**64
        end = max(0, len(words) - j)
        inside = left[:end] > j
        total[:end][inside] += words[j:][inside] * np.uint64(power)
    first = np.ones(len(words), bool)
    first[1:] = row[1:] != row[:-1]
    runs = (left >= size) | first
    return total[runs], row[runs]


def retained(hashes: np.ndarray, rows: np.ndarray, n: int, scaled: int = SCALED) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many for each of n rows): those below the mark, or the smallest where there are none; ascending and without repetition. rows ascends."""
    below = hashes < np.uint64(2**64 // scaled)
    some = np.zeros(n, bool)
    some[rows[below]] = True
    bare = np.flatnonzero(np.bincount(rows, minlength=n).astype(bool) & ~some)
    if len(bare):
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        least = np.minimum.reduceat(hashes, starts)[np.searchsorted(rows[starts], bare)]
    else:
        least = hashes[:0]
    return distinct(np.concatenate([hashes[below], least]), np.concatenate([rows[below], bare]), n)


def distinct(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(each row's hashes, ascending and without repetition; how many for each of n rows)."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(rows[new], minlength=n)


class Sketches:
    """The sketches of a column of texts, one after the other."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.hashes, self.counts = hashes, counts

    @classmethod
    def of(cls, column: pa.Array, memo: WordHashes, size: int = SIZE, scaled: int = SCALED) -> Sketches:
        found = []
        for a, b, raw, offsets in views(column, 1 << 20):
            body, at = raw.tobytes().lower(), offsets.tolist()
            words: list[bytes] = []
            counts = []
            for x, y in zip(at, at[1:], strict=False):
                own = body[x:y].split()
                counts.append(len(own))
                words += own
            hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
            found.append(retained(*shingles(hashes, np.array(counts, np.int64), size), b - a, scaled))
        hashes, counts = zip(*found, strict=True) if found else ([np.zeros(0, np.uint64)], [np.zeros(0, np.int64)])
        return cls(np.concatenate(hashes), np.concatenate(counts))

    def part(self, a: int, b: int) -> Sketches:
        ends = np.concatenate([[0], np.cumsum(self.counts)])
        return Sketches(self.hashes[ends[a] : ends[b]], self.counts[a:b])

    def strings(self) -> pa.Array:
        """Each as its hashes in hexadecimal, 16 digits each."""
        ends = np.concatenate([[0], np.cumsum(self.counts * DIGITS)]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(self.counts), [None, pa.py_buffer(ends), pa.py_buffer(self.hashes.astype(">u8").tobytes().hex().encode())])

    def compared(self, others: Sketches) -> tuple[np.ndarray, np.ndarray]:
        """(likeness, containment) of each to the other at its place: shared hashes by those of both together, and by its own. Two empty ones are alike; beside one that is not they share nothing."""
        n = len(self.counts)
        both = np.concatenate([np.repeat(np.arange(n), self.counts), np.repeat(np.arange(n), others.counts)])
        together = distinct(np.concatenate([self.hashes, others.hashes]), both, n)[1]
        shared = self.counts + others.counts - together
        alike = np.where(together > 0, shared / np.maximum(together, 1), 1.0)
        held = np.where(self.counts > 0, shared / np.maximum(self.counts, 1), np.where(together > 0, 0.0, 1.0))
        return alike, held


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def merged(*fingerprints: str, scaled: int = SCALED) -> str:
    """The fingerprint of all the shingles of several texts together."""
    hashes = np.concatenate([parsed(f) for f in fingerprints]) if fingerprints else np.zeros(0, np.uint64)
    return Sketches(*retained(hashes, np.zeros(len(hashes), np.int64), 1, scaled)).strings()[0].as_py()


def containment(one: Column, other: Column) -> Column:
    """The part of one fingerprint's hashes that another holds, as a column: an estimate of the part of the text that is in the other. Null for a fingerprint without hashes."""
    hashes = lambda f: F.filter(F.regexp_extract_all(f, F.lit(f"([0-9a-f]{{{DIGITS}}})"), F.lit(1)), lambda x: x != "")
    own = hashes(one)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, hashes(other))) / F.size(own))


def _in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """bucket, guest, key, text in descending order of key, in buckets of neighbours, each followed by the row that comes after its last (guest).

    Bounds are keys that occur, so a bucket's last row is followed by the rows of the bound below it, which go to both buckets; the first row of all follows
    the last. A bucket is found by binary search in the bounds, within the plan. The texts move once, and no task sees more than its buckets.
    """
    least = -(2**63)
    k = F.coalesce(F.col(key).cast("long"), F.lit(least))  # nulls come after the smallest key
    rows = small_batches(docs).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), k.alias("k"))
    n, top = rows.agg(F.count("*"), F.max("k")).first()
    parts = min(BUCKETS, -(-n // BUCKET_ROWS))
    bounds: list[int] = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        bounds = sorted(set(rows.agg(F.percentile_approx("k", shares, max(10_000, 4 * parts))).first()[0]) - {top})
    if bounds:
        known, steps = F.lit(bounds).cast("array<long>"), [1 << i for i in reversed(range(len(bounds).bit_length()))]
        step = lambda at, s: F.when((at + s <= len(bounds)) & (F.get(known, at + s - 1) < F.col("k")), at + s).otherwise(at)
        own = F.aggregate(F.lit(steps), F.lit(0), step)
        after = F.when(F.get(known, F.col("own")) == F.col("k"), F.col("own") * 2 + 3)
    else:
        own, after = F.lit(0), F.lit(None).cast("int")
    places = F.array(F.col("own") * 2, after, F.when(F.col("k") == F.lit(top), F.lit(1)))
    placed = rows.withColumn("own", own).select("key", "k", "text", F.explode(F.array_compact(places)).alias("place"))
    dealt = placed.select(F.shiftright("place", 1).alias("bucket"), (F.col("place") % 2).alias("guest"), "key", "k", "text").repartition("bucket")
    return dealt.sortWithinPartitions("bucket", "guest", F.desc("k"), F.col("key").isNull(), "text").select("bucket", "guest", "key", "text")


def edited(text: str, after: str) -> str:
    """text, the last third of its code points replaced by as many of the next text, or all that it has."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, scaled: int = SCALED) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, held_edited, held_next of every whole text.

    A text is edited with the next document's, by descending key (whole numbers; nulls come last, equal keys go by their texts; the first follows the last, so a single document follows itself). near_ is
    the likeness of fingerprints (shared hashes by those of both), held_ the part of the own fingerprint that the other holds; two fingerprints without hashes are alike.
    Shingles are runs of words, A-Z in lower case, parted by ASCII white space; a text of fewer words is one. A null text is an empty one. Repeated rows each have a row. Other
    columns are not read, so their names don't matter; an empty table gives no rows.
    """
    frame = _in_order(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held = WordHashes(), None
        for batch in batches:
            rows = pa.Table.from_batches([b for b in (held, batch) if b is not None and b.num_rows]).combine_chunks().to_batches()
            if not rows:
                continue
            rows = rows[0]
            last = rows.num_rows - 1
            held = rows.slice(last)  # what follows it is in the next batch
            bucket, guest = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            own = np.flatnonzero(guest[:last] == 0)
            if (bucket[own] != bucket[own + 1]).any():
                raise RuntimeError("a document's next one is missing")
            texts = rows.column(3).to_pylist()
            changed = [edited(texts[i], texts[i + 1]) for i in own.tolist()]
            all_of = Sketches.of(rows.column(3), memo, size, scaled)
            news = Sketches.of(pa.array(changed, pa.string()), memo, size, scaled)
            ends = np.cumsum(all_of.counts)
            pick = lambda at: Sketches(np.concatenate([all_of.hashes[ends[i] - all_of.counts[i] : ends[i]] for i in at.tolist()] or [all_of.hashes[:0]]), all_of.counts[at])
            mine = pick(own)
            (near, held_by), (near_next, held_next) = mine.compared(news), mine.compared(pick(own + 1))
            columns = [
                rows.column(2).take(pa.array(own)), pa.array([len(texts[i]) for i in own.tolist()], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                mine.strings(), news.strings(), pa.array(near), pa.array(near_next), pa.array(held_by), pa.array(held_next),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", *NAMES])
        if held is not None and held.column(1)[0].as_py() == 0:
            raise RuntimeError("a document's next one is missing")

    kind = frame.schema["key"].dataType.simpleString()
    out = frame.mapInArrow(tidy(run), f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, held_edited double, held_next double")
    return out.withColumnRenamed("key", key)


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "held_edited", "held_next"]
