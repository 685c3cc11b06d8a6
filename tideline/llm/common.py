"""What the operators of this subpackage share: inputs, shared storage, byte views of text columns."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import drop_folder as drop_dir
from ..operators.staging import fresh_folder as fresh_dir
from ..operators.staging import staged as materialise

__all__ = ["BATCH_ROWS", "SLICE_BYTES", "SPACES", "drop_dir", "filesystem", "fitted_sample", "fresh_dir", "hash_share", "materialise", "numbered", "small_batches", "sorted_groups", "table", "tidy", "tidy_group", "views", "whole_groups"]

#: Bytes of text that a kernel handles at once; bounds the memory of a Python worker.
SLICE_BYTES = 4 << 20
#: Python calls the ASCII white space of these contracts just this: [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """(pyarrow's file system, path) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def numbered(docs: DataFrame, without: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c0, c1, .. by place, and these names by the old ones: no column of a caller can then clash with an operator's own.

    toDF() with the old names, which are the keys of the dict in order, gives them back. Columns named in without, in any case, are left out.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    kept = {c: n for c, n in zip(docs.columns, names, strict=True) if c.lower() not in (without or [])}
    return docs.toDF(*names).select(*kept.values()), kept


def hash_share(column: str, share: float):
    """True for about that share of the rows, by a hash of column alone: the same rows on every run and machine. False where column is null: nulls would be in or out together."""
    limit = int(min(1.0, max(0.0, share)) * 2**31)
    return F.col(column).isNotNull() & (F.xxhash64(F.lit("share"), F.col(column)).bitwiseAND(F.lit(2**31 - 1)) < F.lit(limit))


def fitted_sample(docs: DataFrame, label: str, key: str, per_label: int) -> tuple[DataFrame, list]:
    """About per_label rows of each label (all, where it has fewer), chosen by a hash of key, and the labels.

    One narrow count by label, then a filter; no label's rows meet in one task.
    """
    counts = {r[0]: r[1] for r in docs.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    keep = F.lit(False)
    for value in sorted(counts):
        keep = keep | ((F.col(label) == F.lit(value)) & hash_share(key, per_label / counts[value]))
    return docs.where(keep), sorted(counts)


#: Rows that Spark hands to Python at once: with texts of some KB, a batch of 10 MB or so on either side.
BATCH_ROWS = 2500


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that hands no more than BATCH_ROWS rows to Python at once: whole texts make the default of 10,000 heavy."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def _release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A mapInArrow function that gives its freed memory back when its partition is done: Python workers live on, idle, beside what runs next."""

    def wrapped(batches):
        yield from run(batches)
        _release()

    return wrapped


def tidy_group(run):
    """The same for an applyInArrow function, when each group is done."""

    def wrapped(group: pa.Table) -> pa.Table:
        out = run(group)
        _release()
        return out

    return wrapped


def sorted_groups(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys and sorted by them within partitions, keys in front: for whole_groups()."""
    return df.select(*keys, *(c for c in df.columns if c not in keys)).repartition(*keys).sortWithinPartitions(*keys)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the groups that are complete, as sorted rows come by: the first `keys` columns name a group.

    No more than a batch and the group that runs over its end is held, however large the partition.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        # where the last group of this batch begins
        same = np.ones(batch.num_rows, bool)
        for c in columns:
            same &= c == c[-1]
        first = int(np.flatnonzero(same)[0])
        runs_on = held and first == 0 and all(held[-1].column(k)[held[-1].num_rows - 1].as_py() == batch.column(k)[0].as_py() for k in range(keys))
        if not runs_on:
            done = [*held, batch.slice(0, first)] if first else held
            if done:
                yield pa.Table.from_batches(done).combine_chunks()
            held = []
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def views(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about limit bytes together; a null is empty.

    The bytes are a view of Arrow's buffer; offsets has one entry more than the run has rows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
