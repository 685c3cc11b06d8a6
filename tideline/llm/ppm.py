"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts with frozen counts. A byte's code length is taken in the
longest context that the tree holds; a byte that the context has not seen costs an escape and is looked up in the next
shorter one (escapes as many as distinct bytes, method C), down to a uniform code of all bytes. Bytes that the context has seen
are excluded below its escape, so that the code of every node is complete: its probabilities sum up to one. The language with the shortest
code of the whole text wins. The trees of all languages share their nodes, and each node holds finished code lengths, so
that scoring is a walk over preceding bytes and one lookup, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fitted_sample, numbered, small_batches, tidy, views
from .words import LOWER

#: Longest context in bytes.
ORDER = 4
#: Training texts of each language, about; a fixed bound at any input size.
TRAIN_DOCS = 1000
#: A context is a node if some language saw it so often.
LEAST = 12
UNDETERMINED = "und"


def _windows(raw: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """raw with `order` zero bytes before each row, and where each row begins in it (with the end)."""
    rows = len(offsets) - 1
    at = np.arange(len(raw)) + order * (np.repeat(np.arange(rows), np.diff(offsets)) + 1)
    out = np.zeros(len(raw) + order * rows, np.uint8)
    out[at] = raw
    return out, offsets + order * np.arange(rows + 1)


def _shifted(x: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[d:] = x[: len(x) - d] if d else x
    return out


def context_counts(sample: DataFrame, label: str, text: str, order: int) -> DataFrame:
    """label, key, n: how often each language had each byte after each `order` bytes; key holds these bytes, the latest lowest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, column = np.array(batch.column(0).to_pylist(), object), batch.column(1)
            for a, b, raw, offsets in views(column):
                body, starts = _windows(LOWER[raw], offsets, order)
                keys = np.zeros(len(body), np.int64)
                for d in range(order, -1, -1):
                    keys = (keys << 8) | _shifted(body, d)
                owner = np.repeat(np.arange(b - a), np.diff(starts))
                real = np.arange(len(body)) - starts[owner] >= order
                for name in sorted(set(names[a:b])):
                    key, n = np.unique(keys[real & (names[a:b] == name)[owner]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key), pa.array(n.astype(np.int64))], ["label", "key", "n"])

    counts = small_batches(sample).select(F.col(label).cast("string"), F.col(text)).mapInArrow(tidy(run), "label string, key long, n long")
    return counts.groupBy("label", "key").agg(F.sum("n").alias("n"))


class Trees:
    """Code lengths by node, byte and language, and the children of each node."""

    def __init__(self, labels: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int, least: int):
        self.labels, self.order = labels, order
        seen = np.unique(np.concatenate([np.zeros(1, np.int64), *(k & 255 for k, _ in counts.values())]))
        #: Symbols: 0 stands for bytes that no language had; the zero byte, which stands before each text, has its own.
        self.symbol = np.zeros(256, np.uint16)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        width = self.width = int(self.symbol.max()) + 1
        tables = {}
        for name, (key, n) in counts.items():
            for o in range(order, -1, -1):
                key, inverse = np.unique(key & ((1 << (8 * (o + 1))) - 1), return_inverse=True)
                n = np.bincount(inverse, weights=n).astype(np.int64)
                tables[name, o] = (key >> 8, key & 255, n)
        # node 0: none; node 1: the empty context; then by order, so that a deeper node has a larger number
        nodes, first = [np.zeros(1, np.int64)], [1]
        for o in range(1, order + 1):
            found = []
            for name in labels:
                context, _, n = tables[name, o]
                c, inverse = np.unique(context, return_inverse=True)
                found.append(c[np.bincount(inverse, weights=n) >= least])
            first.append(first[-1] + len(nodes[-1]))
            nodes.append(np.unique(np.concatenate(found)))
        total = first[-1] + len(nodes[-1])
        self.child = np.zeros((total, width), np.int32)
        bits = np.zeros((total, width, len(labels)), np.float32)
        uniform = np.full((1, width), 1 / 256)
        #: Bytes that a symbol stands for.
        self.bytes_of = np.append(256 - len(seen), np.ones(len(seen)))
        for k, name in enumerate(labels):
            shorter = uniform
            for o in range(order + 1):
                context, byte, n = tables[name, o]
                at = np.searchsorted(nodes[o], context)
                ok = (at < len(nodes[o])) & (nodes[o][np.minimum(at, max(0, len(nodes[o]) - 1))] == context) if len(nodes[o]) else np.zeros(len(at), bool)
                hits = np.zeros((len(nodes[o]), width))
                np.add.at(hits, (at[ok], self.symbol[byte[ok]]), n[ok])
                if o == 0:
                    below = np.repeat(uniform, len(nodes[0]), 0)
                else:
                    parent = np.searchsorted(nodes[o - 1], nodes[o] & ((1 << (8 * (o - 1))) - 1))
                    below = shorter[parent]
                    if k == 0:
                        self.child[first[o - 1] + parent, self.symbol[nodes[o] >> (8 * (o - 1))]] = first[o] + np.arange(len(nodes[o]))
                seen_here, distinct = hits.sum(1, keepdims=True), (hits > 0).sum(1, keepdims=True)
                all_of = np.maximum(seen_here + distinct, 1)
                # what an escape leads to: the shorter context's bytes less those seen here; without any left there is no escape
                rest = (below * self.bytes_of * (hits == 0)).sum(1, keepdims=True)
                open_ = rest > 0
                all_of = np.where(open_, all_of, np.maximum(seen_here, 1))
                p = np.where(hits > 0, hits / all_of, np.where(seen_here > 0, distinct / all_of / np.where(open_, rest, 1), 1.0) * below)
                bits[first[o] : first[o] + len(nodes[o]), :, k] = -np.log2(p)
                shorter = p
        self.bits = bits.reshape(total * width, len(labels))
        self.child = self.child.reshape(-1)

    def lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row under each language. raw: lower-cased bytes."""
        body, starts = _windows(raw, offsets, self.order)
        if not len(body):
            return np.zeros((len(offsets) - 1, len(self.labels)))
        symbols = self.symbol[body].astype(np.int32)
        node = np.ones(len(body), np.int32)
        deepest = node
        for d in range(1, self.order + 1):
            node = self.child[node * self.width + _shifted(symbols, d)]
            deepest = np.maximum(deepest, node)
        bits = self.bits[deepest * self.width + symbols]
        # the padding before each row costs nothing
        pad = (starts[:-1, None] + np.arange(self.order)).ravel()
        bits[pad] = 0
        return np.add.reduceat(bits, starts[:-1], axis=0, dtype=np.float64)


def fit(docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", order: int = ORDER, train_docs: int = TRAIN_DOCS, least: int = LEAST) -> Trees | None:
    """Trees from about train_docs texts of each label, chosen by a hash of key; None if there is nothing to learn from."""
    sample, labels = fitted_sample(docs.where(F.length(text) > 0), label, key, train_docs)
    if not labels:
        return None
    # the sample is bounded, and so is what is collected: single sightings decide nothing
    found = context_counts(sample, label, text, order).toArrow()
    counts = {}
    names, keys, n = found.column("label").to_numpy(zero_copy_only=False), found.column("key").to_numpy(), found.column("n").to_numpy()
    for name in sorted(set(names)):
        counts[name] = (keys[names == name], n[names == name])
    return Trees(sorted(counts), counts, order, least) if counts else None


def identify(docs: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, from the whole text alone.

    `und` and score 0 if the text is null, empty or has no letter, or if there are no trees. score: the language's share
    of 2 ** -bits among all languages. Equal code lengths: the first label in order. Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    if trees is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    own, at = docs.columns, docs.columns.index(text)
    shipped = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shipped.value
        for batch in batches:
            names, scores = [], []
            letters = batch.column(len(own)).to_numpy(zero_copy_only=False)
            for a, b, raw, offsets in views(batch.column(at)):
                bits = trees.lengths(LOWER[raw], offsets)
                best = bits.argmin(1)
                share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                known = letters[a:b].astype(bool)
                names += [trees.labels[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), known, strict=True)]
                scores.append(np.where(known, share, 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*own, "lang_pred", "score"])

    # by numbers, so that no column of the caller's can clash with the mark
    frame, names_of = numbered(docs)
    marked = small_batches(frame).withColumn("letters", F.coalesce(F.col(names_of[text]).rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
