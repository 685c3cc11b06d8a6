"""How two tokenizers cut the same bytes: overlapping tokens, groups between common cuts, and how many documents link a pair of ids.

A pair of ids is one 64-bit integer. Tasks count their pairs with np.unique, one global sort by ranges sums the runs, and the result lies in sorted
shards in shared storage, which tasks map into memory and search. Distinct pairs are bounded by the two vocabularies, not by the documents.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_characters
from .common import filesystem, fresh_dir, materialise, small_batches, tidy

#: Text bytes that the tokenizers get at once, tokens that are aligned at once, and pairs that a task holds before it hands them on.
TEXT_BYTES, SLICE_TOKENS, HELD_PAIRS = 1 << 18, 1 << 17, 1 << 20
#: Pairs of a count shard, and shards that a task keeps open where they can only be read into memory.
SHARD_PAIRS, OPEN_SHARDS = 1 << 20, 4
_loaded: dict[int, tuple] = {}
#: Fixed value: how byte-level BPE of the tokenizers library splits a text before it merges.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranked(spec: dict):
    """The encoder of a byte-level BPE (its JSON) by ranks, which gives the same ids several times as fast; None where merges and ids aren't in one order, or more is done than splitting and merging."""
    import tiktoken

    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain &= split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and spec.get("normalizer") is None and all(t["special"] for t in spec.get("added_tokens", []))
    vocabulary, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if not plain or any(vocabulary.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    of = {c: b for b, c in enumerate(byte_characters())}
    ranks = {bytes(map(of.__getitem__, t)): i for t, i in vocabulary.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Tokenizers:
    """A: a byte-level BPE of the tokenizers library (the JSON), given a space before the text. B: a sentencepiece model, which puts that space itself."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece

        spec = json.loads(a_json)
        self.a_json, self.fast = a_json, ranked(spec)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        of = {c: b for b, c in enumerate(byte_characters())}
        special = {t["id"] for t in spec.get("added_tokens", [])}
        vocabulary = spec["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max([*vocabulary.values(), *special]))
        for token, i in vocabulary.items():
            if i not in special:
                self.a_bytes[i] = bytes(map(of.__getitem__, token))
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]

    @functools.cached_property
    def a(self):
        """The library's own encoder, made only where ranks won't do."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.a_json)
        out.encode_special_tokens = True
        return out

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) and re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def ids(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """The ids of each text by both; none where the text is empty, or the tokens' bytes are not the space and the text."""
        whole = [" " + t for t in texts]
        first = map(self.fast.encode_ordinary, whole) if self.fast else (x.ids for x in self.a.encode_batch_fast(whole, add_special_tokens=False))
        out = []
        for text, body, a, b in zip(texts, whole, first, self.b.encode(texts, num_threads=1), strict=True):
            raw = body.encode()
            sound = text and b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((a, b) if sound else ([], []))
        return out


def specification(a_path: str, b_path: str) -> tuple[str, bytes]:
    """The two files' contents, which are sent to all tasks: a few MB, whatever the documents."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return a.read(), b.read()


def _tokenizers(shipped) -> Tokenizers:
    """One for each worker and specification."""
    if id(shipped.value) not in _loaded:
        _loaded.clear()
        _loaded[id(shipped.value)] = (Tokenizers(*shipped.value), shipped.value)
    return _loaded[id(shipped.value)][0]


class Vocabularies:
    """Lengths in bytes of all tokens of both; what alignment needs of them."""

    def __init__(self, both: Tokenizers):
        self.a, self.b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (both.a_bytes, both.b_bytes))

    @property
    def largest(self) -> int:
        return len(self.a) * len(self.b)


#: Ids as decimals, as bytes in rows of six with their lengths: made once for each size.
_digits: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _digits:
        text = np.array([str(i) for i in range(n)], "S")
        _digits[n] = text.view(np.uint8).reshape(n, -1), np.char.str_len(text).astype(np.int64)
    return _digits[n]


class Alignment:
    """Links and groups of the tokens of several texts, whose ids lie one after the other; na and nb say how many are each text's.

    Both sides of a text have the same bytes, so ends counted over all texts agree. Between two neighbouring ends lies exactly one pair of overlapping
    tokens, so there are as many links as different ends.
    """

    def __init__(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, sizes: Vocabularies):
        self.a, self.b, self.na, self.nb, self.n = a.astype(np.int64), b.astype(np.int64), na, nb, len(na)
        self.sizes = sizes
        ends_a, ends_b = np.cumsum(sizes.a[self.a]), np.cumsum(sizes.b[self.b])
        ends = np.union1d(ends_a, ends_b)
        self.at_a, self.at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        self.row = np.repeat(np.arange(self.n), na)[self.at_a]
        common = (ends_a[self.at_a] == ends) & (ends_b[self.at_b] == ends)
        self.n_groups = np.bincount(self.row[common], minlength=self.n)
        self.n_links = np.bincount(self.row, minlength=self.n)
        cuts = ends[common]
        self.group_a, self.group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)

    def keys(self) -> np.ndarray:
        """The pair of each link as one integer."""
        return self.a[self.at_a] * len(self.sizes.b) + self.b[self.at_b]

    def distinct(self) -> np.ndarray:
        """Each pair as often as there are texts that have it linked."""
        return np.unique(self.row * self.sizes.largest + self.keys()) % self.sizes.largest

    def strings(self) -> list[bytes]:
        """The groups of each text: `a1,a2|b1;a3|b2,b3`."""
        n = len(self.a) + len(self.b)
        # a group's A tokens come before its B tokens
        place_a = np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a)
        place_b = np.arange(len(self.b)) + np.searchsorted(self.group_a, self.group_b, "right")
        mark = np.empty(n, np.uint8)
        for place, group, last in ((place_a, self.group_a, b"|"), (place_b, self.group_b, b";")):
            inner = np.zeros(len(group), bool)
            inner[:-1] = group[1:] == group[:-1]
            mark[place] = np.where(inner, ord(","), last[0])
        ends = np.cumsum(self.na + self.nb)
        mark[ends[self.na + self.nb > 0] - 1] = 0  # a text's last group has nothing after it
        table, lengths = digits(max(len(self.sizes.a), len(self.sizes.b)))
        ids = np.empty(n, np.int64)
        ids[place_a], ids[place_b] = self.a, self.b
        wide = np.zeros((n, table.shape[1] + 1), np.uint8)
        wide[:, :-1] = table[ids]
        wide[np.arange(n), lengths[ids]] = mark
        size = lengths[ids] + (mark > 0)
        body = wide[np.arange(wide.shape[1]) < size[:, None]].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])].tolist()
        return [body[x:y] for x, y in zip(at, at[1:], strict=False)]


def _slices(batch: pa.RecordBatch, sizes: Vocabularies, tokens: int = SLICE_TOKENS) -> Iterator[tuple[int, int, Alignment]]:
    """(first row, row after the last, their alignment) of runs of rows with about that many tokens. Columns: key, a, b."""

    def ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        return raw.view("<u4"), (at - at[0]) // 4

    if not batch.num_rows:
        return
    (a, at_a), (b, at_b) = ids(batch.column(1)), ids(batch.column(2))
    both, x = at_a + at_b, 0
    while x < batch.num_rows:
        y = max(x + 1, int(np.searchsorted(both, both[x] + tokens, "right")) - 1)
        yield x, y, Alignment(a[at_a[x] : at_a[y]], np.diff(at_a[x : y + 1]), b[at_b[x] : at_b[y]], np.diff(at_b[x : y + 1]), sizes)
        x = y


def encoded(docs: DataFrame, specified: tuple[str, bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, a, b (ids as little-endian unsigned 32-bit integers) of every whole text, written once: encoding is most of the work, and counts and alignments both need it."""
    shipped = docs.sparkSession.sparkContext.broadcast(specified)
    frame = small_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(shipped)
        raw = lambda ids: np.array(ids, "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found, held, size = [], [], 0
            for t in [*texts, None]:
                if held and (t is None or size >= TEXT_BYTES):
                    found += [(raw(a), raw(b)) for a, b in both.ids(held)]
                    held, size = [], 0
                if t is not None:
                    held.append(t)
                    size += len(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["key", "a", "b"])

    schema = T.StructType([frame.schema[0], T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    return materialise(frame.mapInArrow(tidy(run), schema), "aligned-ids")


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with their counts summed."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


class PairCounts:
    """Count shards by the range of their pairs: (path, first pair, last pair, pairs), in order; and the highest count of each id of A."""

    def __init__(self, shards: list[tuple[str, int, int, int]], highest: np.ndarray):
        self.shards, self.highest = shards, highest
        self.lasts = np.array([s[2] for s in shards], np.int64)
        self._open: OrderedDict[int, np.ndarray] = OrderedDict()

    def __getstate__(self):
        return self.shards, self.highest

    def __setstate__(self, state):
        self.__init__(*state)

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, counts) of a shard: a map of its file, or where that is not mounted its bytes."""
        path, _, _, n = self.shards[i]
        if i not in self._open:
            files, inside = filesystem(path)
            if files.type_name == "local":
                self._open[i] = np.memmap(inside, "<i8", "r", shape=(2 * n,))
            else:
                with files.open_input_file(inside) as f:
                    self._open[i] = np.frombuffer(f.read(), "<i8")
                if len(self._open) > OPEN_SHARDS:
                    self._open.popitem(last=False)
        body = self._open[i]
        return body[:n], body[n:]

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The counts of ascending pairs, 0 where one isn't stored."""
        out = np.zeros(len(keys), np.int64)
        bounds = np.searchsorted(keys, self.lasts, "right")  # pairs that lie up to the end of each shard
        begin = 0
        for i, end in enumerate(bounds.tolist()):
            if end > begin:
                known, counts = self.shard(i)
                at = np.minimum(np.searchsorted(known, keys[begin:end]), len(known) - 1)
                out[begin:end] = np.where(known[at] == keys[begin:end], counts[at], 0)
                begin = end
        return out

    def frame(self, spark: SparkSession, size_b: int) -> DataFrame:
        """a_id, b_id, n_docs of all pairs."""
        if not self.shards:
            return spark.createDataFrame([], "a_id int, b_id int, n_docs long")
        parts = spark.createDataFrame([(i,) for i in range(len(self.shards))], "shard int").repartition(min(len(self.shards), 1000), "shard")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    keys, counts = self.shard(i)
                    for x in range(0, len(keys), 1 << 16):
                        k = np.array(keys[x : x + (1 << 16)])
                        yield pa.RecordBatch.from_arrays([pa.array((k // size_b).astype(np.int32)), pa.array((k % size_b).astype(np.int32)), pa.array(np.array(counts[x : x + (1 << 16)]))], ["a_id", "b_id", "n_docs"])

        return parts.mapInArrow(run, "a_id int, b_id int, n_docs long")


def count_pairs(ids: DataFrame, sizes: Vocabularies, slice_tokens: int = SLICE_TOKENS, held_pairs: int = HELD_PAIRS, shard_pairs: int = SHARD_PAIRS) -> PairCounts:
    """In how many documents each pair of ids is linked.

    A task hands on its own counts, sorted; ranges of pairs are then sorted and summed, each task writing the shards of its range. A file counts only if
    the manifest names it, so lost and repeated tasks do no harm. The driver gets a row for each shard and the highest counts of A's ids.
    """
    spark = ids.sparkSession
    folder, width, size_a = fresh_dir(spark, "pair-counts"), len(sizes.b), len(sizes.a)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return summed(*map(np.concatenate, zip(*held, strict=True)))

        def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for x in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[x : x + (1 << 16)]), pa.array(counts[x : x + (1 << 16)])], ["pair", "n"])

        for batch in batches:
            for _, _, found in _slices(batch, sizes, slice_tokens):
                held.append(np.unique(found.distinct(), return_counts=True))
                n += len(held[-1][0])
                if n > held_pairs:
                    held = [merged()]
                    n = len(held[0][0])
                    if n > held_pairs // 2:
                        yield from out(*held[0])
                        held, n = [], 0
        if held:
            yield from out(*merged())

    # written, since a sort by ranges looks at its input twice
    partial = materialise(ids.mapInArrow(tidy(count), "pair long, n long"), "pair-parts")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def shard(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.pairs"
            with files.open_output_stream(f"{base}/{name}") as f:
                f.write(keys.astype("<i8").tobytes())
                f.write(counts.astype("<i8").tobytes())
            starts = np.flatnonzero(np.diff(keys // width, prepend=-1))
            row = {"path": [f"{folder}/{name}"], "first": [int(keys[0])], "last": [int(keys[-1])], "n": [len(keys)]}
            row |= {"ids": [(keys[starts] // width).astype("<i8").tobytes()], "highest": [np.maximum.reduceat(counts, starts).astype("<i8").tobytes()]}
            return pa.RecordBatch.from_pydict(row, MANIFEST)

        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            keys, counts = summed(np.concatenate([keys, new[0]]), np.concatenate([counts, new[1]]))
            while len(keys) > shard_pairs:  # the last pair may go on
                yield shard(keys[:shard_pairs], counts[:shard_pairs])
                keys, counts = keys[shard_pairs:], counts[shard_pairs:]
        if len(keys):
            yield shard(keys, counts)

    ranged = partial.repartitionByRange(parts, "pair").sortWithinPartitions("pair")
    manifest = materialise(ranged.mapInArrow(tidy(write), "path string, first long, last long, n long, ids binary, highest binary"), "pair-manifest")
    found = sorted(manifest.collect(), key=lambda r: r["first"])
    highest = np.zeros(size_a, np.int64)
    for r in found:
        np.maximum.at(highest, np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["highest"], "<i8"))
    return PairCounts([(r["path"], r["first"], r["last"], r["n"]) for r in found], highest)


MANIFEST = pa.schema([("path", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("highest", pa.binary())])
LONGS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def aligned(ids: DataFrame, sizes: Vocabularies, counts: PairCounts, groups: bool = False) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of encoded texts; with groups also their string itself.

    n_best: links whose pair has the highest count of all that its A id has, ties included. count_sum: the counts of all links. Without tokens all are 0 and groups_sha256 is ''.
    """
    shipped = ids.sparkSession.sparkContext.broadcast(counts)  # 8 bytes for each id of A, and a line for each shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            for x, y, found in _slices(batch, sizes):
                distinct, inverse = np.unique(found.keys(), return_inverse=True)
                count = known.lookup(distinct)
                best = count == known.highest[distinct // len(sizes.b)]
                edges = np.concatenate([[0], np.cumsum(found.n_links)])
                total = lambda values, edges=edges: np.diff(np.concatenate([[0], np.cumsum(values)])[edges])
                strings = found.strings()
                digests = [hashlib.sha256(s).hexdigest() if s else "" for s in strings]
                longs = [found.na, found.nb, found.n_groups, found.n_links, total(best[inverse]), total(count[inverse])]
                more = [pa.array([s.decode() for s in strings], pa.string())] if groups else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *(pa.array(v.astype(np.int64)) for v in longs), pa.array(digests, pa.string()), *more], ["key", *LONGS, "groups_sha256", *(["groups"] if groups else [])])

    more = [T.StructField(c, T.LongType()) for c in LONGS] + [T.StructField(c, T.StringType()) for c in (["groups_sha256", "groups"] if groups else ["groups_sha256"])]
    return ids.mapInArrow(tidy(run), T.StructType([ids.schema["key"], *more]))


def align(docs: DataFrame, specified: tuple[str, bytes], key: str = "doc_id", text: str = "text", groups: bool = False) -> tuple[DataFrame, PairCounts]:
    """(alignment of every whole text, counts of pairs over all of them) by two tokenizers.

    A text that is null or empty, or that one of the tokenizers doesn't give back byte for byte after a space, has no tokens. Repeated rows each have a row and each count
    as a document, null keys too. Other columns aren't read, so their names don't matter. An empty table gives no rows and no counts.
    """
    sizes = Vocabularies(Tokenizers(*specified))
    ids = encoded(docs, specified, key, text)
    counts = count_pairs(ids, sizes)
    return aligned(ids, sizes, counts, groups).withColumnRenamed("key", key), counts
