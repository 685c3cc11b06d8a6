"""Product codes of vectors: integer components, a codebook for each part of a vector, and the nearest entries found by a float32 product.

The product only screens. Each of its entries has a proven error bound, every entry whose interval reaches the best one's is
measured again in 64-bit integers, and of equal distances the lower index wins; so codes don't depend on the order of sums in a matrix library.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, tidy

#: A component becomes floor(SCALE * x); PARTS codebooks of ENTRIES entries are moved ROUNDS times.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integers beyond this are refused: up to it float32 holds them all, and squares of any part of up to 8192 components fit in 64 bits.
LARGEST = 1 << 24
#: Rows that are screened at once: bounds the memory even where all entries of a codebook are equally near.
SLICE_ROWS = 1024
#: A label with more than this part of all rows is looked up, not shuffled; there are fewer such labels than this.
HOT_PART = 256
HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)


def integers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows kept, their lengths, all their integers in order). A null or empty vector, and one with a component that is null or not finite, isn't kept.

    An integer beyond 2**24 raises ValueError.
    """
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    sound = np.isfinite(values)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~sound)])
    kept = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    whole = np.floor(SCALE * values[np.repeat(kept, lengths)])
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST / SCALE}")
    return np.flatnonzero(kept), lengths[kept], whole.astype(np.int64)


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry; ties go to the lower index. Both are integers of at most 2**24 in size.

    |x - c|^2 - |x|^2 is one product of (x, 1) and (-2c, |c|^2). In float32, whatever the order of its sums, it is off by at most
    g * (2 |x| |c| + |c|^2) with g = n u / (1 - n u), u = 2^-24 and n the number of terms plus one for the rounding of |c|^2.
    """
    _, first = np.unique(book, axis=0, return_index=True)
    first.sort()  # of equal entries only the lowest can win
    own = book[first]
    squares = (own * own).sum(1)
    right = np.vstack([-2.0 * own.T, squares[None]]).astype(np.float32)
    n = (own.shape[1] + 2) * 2.0**-24
    g, longest = n / (1 - n), float(squares.max())
    index, distance = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
    for a in range(0, len(values), SLICE_ROWS):
        x = values[a : a + SLICE_ROWS]
        scores = np.hstack([x, np.ones((len(x), 1), np.int64)]).astype(np.float32) @ right
        off = 1.01 * g * (2 * np.sqrt((x * x).sum(1) * longest) + longest)
        # lower end of an entry <= upper end of the best, rounded up to float32
        reach = np.nextafter((scores.min(1) + 2 * off).astype(np.float32), np.float32(np.inf))
        row, entry = np.nonzero(scores <= reach[:, None])
        exact = ((x[row] - own[entry]) ** 2).sum(1)
        starts = np.searchsorted(row, np.arange(len(x)))
        best = np.minimum.reduceat(exact, starts)
        wins = np.flatnonzero(exact == best[row])
        wins = wins[np.searchsorted(row[wins], np.arange(len(x)))]
        index[a : a + len(x)], distance[a : a + len(x)] = first[entry[wins]], best
    return index, distance


def sums(values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries that occur, how often, the sums of their rows)."""
    order = np.argsort(index, kind="stable")
    entries, starts, counts = np.unique(index[order], return_index=True, return_counts=True)
    return entries, counts, np.add.reduceat(values[order], starts, axis=0)


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, position], integers."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        """Of all components as decimals, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each part its values, the indexes and the distances of their nearest entries."""
        width = self.entries.shape[2]
        for p, book in enumerate(self.entries):
            values = rows[:, p * width : (p + 1) * width]
            yield values, *nearest(values, book)


def prepared(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, label and q (little-endian 32-bit integers) of all vectors that count, written once, since every round reads them."""
    frame = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, whole = integers(batch.column(2))
            offsets = np.concatenate([[0], np.cumsum(4 * lengths)]).astype(np.int32)
            q = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(whole.astype("<i4"))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), q], ["key", "label", "q"])

    schema = T.StructType([*frame.schema.fields[:2], T.StructField("q", T.BinaryType())])
    return materialise(frame.mapInArrow(tidy(run), schema), "code-vectors")


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """q of rows of one length as a matrix."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw.view("<i4").reshape(-1, width).astype(np.int64)


def learn(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of prepared vectors: begun with the vectors of the smallest keys, moved to the means (rounded down) of what is nearest to them.

    Equal keys are ordered by their vectors, null keys come last. With fewer vectors than entries, the codebooks have as many entries as there are vectors.
    Vectors have the length of the first one; others are left out, and a length that parts does not divide raises ValueError.
    Each task adds up its own rows, so a round shuffles parts * entries sums a task and the driver gets parts * entries rows.
    """
    order = [F.col("key").asc_nulls_last(), "q"]
    first = kept.orderBy(*order).limit(1).collect()
    size = len(first[0].q) // 4 if first else 0
    if size % parts:
        raise ValueError(f"vectors of {size} components have no {parts} equal parts")
    kept = kept.where(F.octet_length("q") == 4 * size)
    begun = kept.orderBy(*order).limit(entries).collect()
    width = size // parts
    books = np.array([np.frombuffer(r.q, "<i4") for r in begun], np.int64).reshape(len(begun), parts, width).transpose(1, 0, 2).copy()
    names = [f"s{i}" for i in range(width)]
    for _ in range(rounds if begun else 0):
        held = Codebooks(books)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total = np.zeros((*held.entries.shape[:2], 1 + held.entries.shape[2]), np.int64)
            for batch in batches:
                if batch.num_rows:
                    for p, (values, index, _) in enumerate(held.assign(_rows(batch.column(0), size))):
                        found, counts, added = sums(values, index)
                        total[p, found, 0] += counts
                        total[p, found, 1:] += added
            part, entry = np.nonzero(total[:, :, 0])
            columns = [part, entry, *total[part, entry].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["part", "entry", "n", *names])

        found = kept.select("q").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in ("part", "entry", "n", *names)))
        moved = found.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *names))).collect()
        books = books.copy()
        for r in moved:
            books[r.part, r.entry] = np.array(r[3:], np.int64) // r.n
    return Codebooks(books)


def coded(kept: DataFrame, books: Codebooks) -> DataFrame:
    """key, label, code (two hexadecimal digits a part), error of prepared vectors of the codebooks' length."""
    parts, entries, width = books.entries.shape
    if entries > 256:
        raise ValueError("two digits name 256 entries at most")
    size = parts * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            found = list(books.assign(_rows(batch.column(2), size))) if n else []
            digits = HEX[np.stack([index for _, index, _ in found], 1)].reshape(n, -1) if n else np.zeros((0, 2), np.uint8)
            offsets = np.arange(0, digits.size + 1, max(1, digits.shape[1]), dtype=np.int32)
            code = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(digits))])
            error = sum((d for _, _, d in found), np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(error)], ["key", "label", "code", "error"])

    schema = T.StructType([*kept.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return kept.where(F.octet_length("q") == 4 * size).mapInArrow(tidy(run), schema)


def decoded(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """codes with a column vector (array of double): the middle of the cell that each component of the entry stands for. A null code gives null."""
    width = books.entries.shape[2]
    table = F.lit([[[(int(x) + 0.5) / SCALE for x in entry] for entry in book] for book in books.entries])  # parts * entries * width numbers
    at = lambda p: F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*(F.get(F.get(table, F.lit(p)), at(p)) for p in range(len(books.entries)))) if width else F.lit(None).cast("array<double>"))


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows and label_error: error summed over the rows of a label, nulls together.

    Sums are made before the shuffle. Labels with more than 1/HOT_PART of all rows (so fewer than HOT_PART) are looked up in a broadcast list, and only
    rows of other labels are joined by a shuffle.
    """
    totals = materialise(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    n = totals.agg(F.sum("n")).first()[0] or 0
    often = totals.where(F.col("n") * HOT_PART > n).select(F.col("label").alias("hot"), F.col("label_error").alias("hot_error"))
    marked = rows.join(F.broadcast(often), F.col("label").eqNullSafe(F.col("hot")), "left").drop("hot")
    hot = marked.where("hot_error is not null").withColumnRenamed("hot_error", "label_error")
    rest = totals.where(F.col("n") * HOT_PART <= n).select(F.col("label").alias("other"), "label_error")
    cold = marked.where("hot_error is null").drop("hot_error").join(rest, F.col("label").eqNullSafe(F.col("other"))).drop("other")
    return hot.unionByName(cold)


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(key, label, code, error, label_error of every vector that counts; the codebooks that code them).

    Vectors that are null or empty, or hold a null or a number that isn't finite, are left out. Repeated rows each have a row. Other columns aren't read, so their names
    don't matter. An empty table gives no rows and empty codebooks. error is the squared distance, in units of 1 / SCALE, summed over parts.
    """
    kept = prepared(vectors, key, vector, label)
    books = learn(kept, parts, entries, rounds)
    rows = with_label_error(materialise(coded(kept, books), "codes"))
    return rows.select(F.col("key").alias(key), F.col("label"), "code", "error", "label_error"), books
