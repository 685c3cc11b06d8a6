"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton is small and fixed in size by the benchmark; it is sent to each executor in pieces of bounded size.
Document words stream through it where two known words follow each other as in some item; the
length of the longest match is tracked, and words under a match of a whole window are hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, small_batches, tidy, views
from .words import ALNUM, FACTOR, LOWER, mix, word_hashes, word_ranges

#: Item bytes in one automaton; a larger benchmark is streamed through several, one after the other.
PIECE_BYTES = 1 << 20


class SuffixAutomaton:
    """A generalised suffix automaton over sequences of integers, with the items in which each state's strings occur."""

    def __init__(self, items: list[tuple[object, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends = [self._add(words) for _, words in items]
        #: By state: items whose windows end there. A window is the last `window` words, or a whole shorter item.
        self.items: dict[int, set] = {}
        self.short: dict[int, tuple[int, set]] = {}
        for (item, words), _ in zip(items, ends, strict=True):
            state, length = 0, 0
            for word in words:
                state, length = self.step(state, length, word)
                if length >= window:
                    self.items.setdefault(self.at(state, window), set()).add(item)
            if 0 < len(words) < window:
                self.short.setdefault(self.at(state, len(words)), (len(words), set()))[1].add(item)
        self.lengths = sorted({n for n, _ in self.short.values()})

    def _add(self, words: list[int]) -> int:
        last = 0
        for word in words:
            last = self._extend(last, word)
        return last

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if word in nxt[last]:
            there = nxt[last][word]
            return there if length[there] == length[last] + 1 else self._split(last, there, word)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p != -1:
            there = nxt[p][word]
            link[new] = there if length[there] == length[p] + 1 else self._split(p, there, word)
        return new

    def _split(self, p: int, there: int, word: int) -> int:
        """A copy of state `there` for the strings not longer than p's with word behind them."""
        nxt, link, length = self.next, self.link, self.len
        copy = len(nxt)
        nxt.append(dict(nxt[there]))
        length.append(length[p] + 1)
        link.append(link[there])
        link[there] = copy
        while p != -1 and nxt[p].get(word) == there:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and length of the longest match that ends with word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0

    def at(self, state: int, length: int) -> int:
        """The state that holds the suffix of that length."""
        while self.link[state] >= 0 and self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set]:
        """(first, last + 1) of each run of words that windows cover, and the items of these windows."""
        state, length, spans, found = 0, 0, [], set()

        def cover(a: int, b: int) -> None:
            while spans and a <= spans[-1][1]:
                a = min(a, spans.pop()[0])
            spans.append((a, b))

        for i, word in enumerate(words):
            state, length = self.step(state, length, word)
            widest = 0
            if length >= self.window:
                widest = self.window
                found |= self.items.get(self.at(state, self.window), set())
            for n in self.lengths:
                if n <= length and (hit := self.short.get(self.at(state, n))) and hit[0] == n:
                    found |= hit[1]
                    widest = max(widest, n)
            if widest:
                cover(i + 1 - widest, i + 1)
        return spans, found


def item_words(text: str | None) -> list[bytes]:
    raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    body = raw.tobytes()
    return [body[a:b] for a, b in zip(*word_ranges(raw, np.array([0, len(raw)]), ALNUM)[:2], strict=True)]


class Index:
    """The automaton of some items, their vocabulary, and hashes of their words and pairs of words, to skip what can't match."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        split = [(i, item_words(t)) for i, t in items]
        self.ids = {w: k for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        self.automaton = SuffixAutomaton([(i, [self.ids[w] for w in ws]) for i, ws in split if ws], window)
        whole = sorted(self.ids)
        ends = np.cumsum([len(w) for w in whole], dtype=np.int64) if whole else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if whole else ends
        by_id = word_hashes(np.frombuffer(b"".join(whole), np.uint8), starts, ends)
        pairs = {p for _, ws in split for p in zip(ws, ws[1:], strict=False)}
        self.words = np.sort(by_id)
        self.pairs = np.sort(np.array([pair_hash(by_id[self.ids[a]], by_id[self.ids[b]]) for a, b in pairs], np.uint64))
        self.single = np.sort(by_id[[self.ids[ws[0]] for _, ws in split if len(ws) == 1]]) if any(len(ws) == 1 for _, ws in split) else np.zeros(0, np.uint64)

    def runs(self, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """[first, last + 1] word of each run in which every two neighbours stand so in some item. Runs keep to a row."""
        if not len(hashes):
            return np.zeros((0, 2), np.int64)
        known = among(hashes, self.words)
        joined = known[1:] & known[:-1] & (rows[1:] == rows[:-1])
        at = np.flatnonzero(joined)
        joined[at] = among(pair_hash(hashes[at], hashes[at + 1]), self.pairs)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        runs = np.stack([edges[::2], edges[1::2] + 1], 1)
        least = min([self.automaton.window, *self.automaton.lengths])
        runs = runs[runs[:, 1] - runs[:, 0] >= max(2, least)]
        if len(self.single):
            alone = np.flatnonzero(known)
            alone = alone[among(hashes[alone], self.single)]
            inside = np.searchsorted(runs[:, 0], alone, "right") - 1
            free = (inside < 0) | (alone >= runs[np.maximum(inside, 0), 1]) if len(runs) else np.ones(len(alone), bool)
            runs = np.concatenate([runs, np.stack([alone[free], alone[free] + 1], 1)])
        return runs[np.argsort(runs[:, 0], kind="stable")]


def pair_hash(a, b):
    with np.errstate(over="ignore"):
        return mix(np.asarray(a) * FACTOR + np.asarray(b))


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _matches(index: Index, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list, list]]:
    """For runs of rows: words by row, and by row the spans (word numbers and bytes) and items."""
    for first, last, raw, offsets in views(column):
        lower = LOWER[raw]
        starts, ends, rows = word_ranges(lower, offsets, ALNUM)
        counts = np.bincount(rows, minlength=last - first)
        before = np.cumsum(counts) - counts
        spans: list = [[] for _ in range(last - first)]
        items: list = [set() for _ in range(last - first)]
        for a, b in index.runs(word_hashes(lower, starts, ends), rows).tolist():
            body = [lower[x:y].tobytes() for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
            got, found = index.automaton.stream([index.ids.get(w, -1) for w in body])
            if got:
                r = rows[a]
                items[r] |= found
                spans[r] += [(int(a + x - before[r]), int(a + y - before[r]), int(starts[a + x] - offsets[r]), int(ends[a + y - 1] - offsets[r])) for x, y in got]
        yield counts, spans, items


SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("first_word", "last_word", "first_byte", "last_byte")])


def _indexes(benchmark: DataFrame, item: str, text: str, window: int) -> list[Index]:
    """One automaton for each PIECE_BYTES of items; items are dealt to pieces by their hash, so no more than one piece is on the driver at once."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    pieces = max(1, -(-2 * size // PIECE_BYTES)) if size > PIECE_BYTES else 1
    for k in range(pieces):
        part = benchmark.where(F.pmod(F.xxhash64(text), F.lit(pieces)) == k) if pieces > 1 else benchmark
        yield Index([(r[0], r[1]) for r in part.select(item, text).where(F.col(text).isNotNull()).collect()], window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, spans (word numbers and bytes of each run of hit words) and items (ids, null left out).

    Words are lower-cased [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; a window is `window` item words in a row, or a whole shorter item.
    A null or empty text has no words; an empty benchmark hits nothing; items without words are ignored. Repeated rows are
    judged each by itself. If docs already has one of the new columns, it is replaced.
    """
    new = ["n_words", "n_hit", "spans", "items"]
    frame, names = numbered(small_batches(docs), without=new)
    kind = benchmark.schema[item].dataType
    found = None
    for index in _indexes(benchmark, item, item_text, window):
        found = _attach(frame if found is None else found, frame.columns, index, names[text], kind)
    return found.toDF(*names, *new)


def _attach(docs: DataFrame, own: list[str], index: Index, text: str, kind: T.DataType) -> DataFrame:
    """docs with what one automaton finds, joined to what those before it found."""
    shipped = docs.sparkSession.sparkContext.broadcast(index)  # PIECE_BYTES of items at most
    schema = T.StructType([*(docs.schema[c] for c in own), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(kind))])
    at = own.index(text)
    again = len(docs.columns) > len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            words, spans, items = [], [], []
            for counts, got, found in _matches(shipped.value, batch.column(at)):
                words.append(counts)
                spans += got
                items += found
            if again:
                for k, (old, ids) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                    spans[k] = _union([tuple(s.values()) for s in old] + spans[k])
                    items[k] |= set(ids)
            hit = [sum(s[1] - s[0] for s in x) for x in spans]
            rows = [[dict(zip(SPAN.names, s, strict=True)) for s in x] for x in spans]
            ids = [sorted((i for i in x if i is not None), key=str) for x in items]
            new = [pa.array(np.concatenate(words) if words else [], pa.int64()), pa.array(hit, pa.int64()), pa.array(rows, arrow.field("spans").type), pa.array(ids, arrow.field("items").type)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *new], schema.names)

    return docs.select(*own, *(["spans", "items"] if again else [])).mapInArrow(tidy(run), schema)


def _union(spans: list[tuple]) -> list[tuple]:
    """Overlapping or touching runs of words as one."""
    out: list[tuple] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            p = out[-1]
            out[-1] = (p[0], max(p[1], s[1]), p[2], max(p[3], s[3]))
        else:
            out.append(s)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, coverage: float = 0.8, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the spans that windows of benchmark items cover; documents covered beyond `coverage` go whole.

    The columns are those of docs, whatever their names. Texts without a hit, nulls and empty texts among them, stay as they are.
    A removed span takes the bytes from its first to its last word; what stands around it stays.
    """
    frame, at = numbered(docs)
    body = at[text]
    found = contamination(frame, benchmark, window, at[key], body, item, item_text)
    raw = F.col(body).cast("binary")
    # the bytes before each span and those after the last: cut by bytes, joined again
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.last_byte"))
    ends = F.concat(F.col("spans.first_byte"), F.array(F.octet_length(body).cast("long")))
    parts = F.zip_with(starts, ends, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))
    kept = F.when(F.col("n_hit") > 0, F.array_join(parts, "")).otherwise(F.col(body))
    clean = found.where(F.col("n_hit") <= F.lit(coverage) * F.col("n_words"))
    return clean.select(*(kept.alias(c) if c == body else F.col(c) for c in frame.columns)).toDF(*docs.columns)
