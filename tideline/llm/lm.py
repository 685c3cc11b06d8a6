"""Language-model scores from a trigram trie in Elias-Fano code, learnt and queried in shards.

p(w | v u) = (c(v u w) + G (c(u w) + B p0(w))) / (c(v u) + G (c(u) + B)), p0(w) = (c(w) + 1) / (N + V + 1)

interpolates triples, pairs and smoothed single words; over all w it sums up to what p0 does. G and B are constants: what a pair's count weighs against a triple's, and
how many tokens of single words are added to a pair's. So the logarithm of a text falls into parts that each need the counts of one word only: numerators of w, and denominators of u with the word before it, which is a pair of the same text. A shard that owns some words learns their contexts,
writes its trie, maps it to memory, answers all that documents ask about these words, and returns sums by document. No model has to fit on a
machine, and no token is sent twice.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fresh_dir, materialise, small_batches, tidy, tidy_group, views
from .eliasfano import Trie
from .words import LOWER, SPACED, mix, word_hashes, word_ranges

#: B, the weight in tokens of single words in pairs, and G, that of a pair's count against a triple's.
PRIOR, PAIR_WEIGHT = 500.0, 0.005
#: Text bytes that one message is made from, tokens in a shard (about), and shards at least.
CHUNK_BYTES, SHARD_TOKENS, LEAST_SHARDS = 4 << 20, 4_000_000, 48
#: Tokens of a shard that are worked on at once: a run of its words, with a trie of its own.
PART_TOKENS = 500_000
#: Rows in a message at most: their numbers take 16 bits.
ROWS = 1 << 16
#: Hashes of the marks at a text's end and start.
END, START = mix(np.array([0xE0F, 0x5A7], np.uint64))


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hash, hash of the one before it, row): the words of each row and its end."""
    lower = LOWER[raw]
    starts, ends, rows = word_ranges(lower, offsets, SPACED)
    n = len(offsets) - 1
    token = np.full(len(starts) + n, END)
    row = np.empty(len(token), np.int64)
    at = np.arange(len(starts)) + rows
    token[at] = word_hashes(lower, starts, ends)
    row[at] = rows
    closing = np.cumsum(np.bincount(rows, minlength=n) + 1) - 1
    row[closing] = np.arange(n)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.append(0, closing[:-1] + 1)] = START
    return token, before, row


def _views(column: pa.Array, first: int, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """views() of the ROWS rows from first on."""
    for a, b, raw, offsets in views(column.slice(first, ROWS), limit):
        yield first + a, first + b, raw, offsets


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple]:
    """(keys, null keys, train, tokens, contexts, rows) for about limit bytes of text each."""
    for batch in batches:
        keys, train = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for a, b, raw, offsets in (v for k in range(0, batch.num_rows, ROWS) for v in _views(batch.column(1), k, limit)):
            part = keys.slice(a, b - a)
            yield part.fill_null(0).to_numpy(zero_copy_only=False), part.is_null().to_numpy(zero_copy_only=False), train[a:b], *_tokens(raw, offsets)


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _by_shard(hashes: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted hashes by shard."""
    if not len(hashes):
        return
    at = _shard_of(hashes, shards)
    cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
        yield int(at[a]), slice(a, b)


def corpus_counts(docs: DataFrame, key: str, text: str, train: str, shards: int) -> tuple[int, int, int, dict[int, int]]:
    """(tokens, distinct tokens, texts, counts of the tokens that are more than half a shard) of the training texts. Exact; only these numbers come to the driver, twice as many counts as shards at most."""
    share = 2 * shards

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, known, token, _, row in _chunks(batches, CHUNK_BYTES):
            found, n = np.unique(token[known[row]], return_counts=True)
            for shard, part in _by_shard(found, shards):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([found[part].tobytes()], pa.binary()), pa.array([n[part].astype(np.uint32).tobytes()], pa.binary())], ["shard", "tokens", "n"])

    def total(group: pa.Table) -> pa.Table:
        token = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group.column("tokens")])
        n = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group.column("n")]).astype(np.int64)
        order = np.argsort(token)
        token, n = token[order], n[order]
        at = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        n = np.add.reduceat(n, at)
        top = np.flatnonzero(n * share > n.sum())  # what is frequent among all tokens is so in its shard
        return pa.table({"n": [int(n.sum())], "kinds": [len(n)], "top": pa.array([token[at[top]].view(np.int64).tolist()], pa.list_(pa.int64())), "top_n": pa.array([n[top].tolist()], pa.list_(pa.int64()))})

    frame = _frame(docs, key, text, train)
    found = materialise(frame.mapInArrow(tidy(count), "shard int, tokens binary, n binary").groupBy("shard").applyInArrow(tidy_group(total), "n long, kinds long, top array<long>, top_n array<long>"), "lm-counts")
    sums = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    tops = found.select(F.explode(F.arrays_zip("top", "top_n")).alias("x")).select("x.top", "x.top_n").where(F.col("top_n") * share > F.lit(sums[0])).toArrow()
    return sums[0], sums[1], docs.where(train).count(), dict(zip(tops.column(0).to_pylist(), tops.column(1).to_pylist(), strict=True))


def _frame(docs: DataFrame, key: str, text: str, train: str) -> DataFrame:
    return small_batches(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))


_ASK = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("sizes", pa.binary()), ("firsts", pa.binary()), ("contexts", pa.binary()), ("befores", pa.binary()), ("rows", pa.binary()), ("docs", pa.binary()), ("train", pa.binary())])
_SUMS = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("base", pa.binary()), ("known", pa.binary()), ("score", pa.binary()), ("heads", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary'})[f.type]}" for f in schema)


def _context(token: np.ndarray) -> np.ndarray:
    """The 32-bit hash that stands for a word where it is a context."""
    return (mix(token) >> np.uint64(32)).astype(np.uint32)


def _in_order(token: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The order by token and context: by the halves that matter at once, or by both in full where two tokens share their upper half."""
    order = np.argsort((token & np.uint64(0xFFFFFFFF00000000)) | context)
    t = token[order]
    return np.lexsort((context, token)) if (t[1:] < t[:-1]).any() else order


def _ask(shards: int, frequent: np.ndarray):
    """For each chunk and shard: its words, their pairs, and of each token the word before the pair and the row. One more message has the chunk's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
        for chunk, (keys, nulls, train, token, before, row) in enumerate(_chunks(batches, CHUNK_BYTES), base):
            counts = np.bincount(row, minlength=len(keys))
            head = [np.asarray(keys, np.int64), nulls.astype(np.int8), counts.astype(np.int64), train.astype(np.int8)]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([-1 - chunk % shards, chunk, *(x.tobytes() for x in head), *[None] * 4], _ASK.types, strict=True)], _ASK.names)
            context = _context(before)
            # the word before the context is the context of the token before; a text's first token has the start there, as its context is
            second = np.append(context[:1], context[:-1])
            second = np.where(before == START, context, second)
            route = token
            if len(frequent):
                hot = frequent[np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)] == token
                route = np.where(hot, mix(token ^ mix(before)), token)
            to = _shard_of(route, shards)
            order = _in_order(token, context)
            order = order[np.argsort(to[order].astype(np.uint16) if shards < 65536 else to[order], kind="stable")]
            token, context, second, row, to = token[order], context[order], second[order], row[order], to[order]
            cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))  # each text has its end at least
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)], strict=True):
                t, c = token[a:b], context[a:b]
                starts = np.append(True, t[1:] != t[:-1])
                new, pair = np.flatnonzero(starts), starts | np.append(True, c[1:] != c[:-1])
                docs, at = np.unique(row[a:b], return_inverse=True)
                parts = [t[new], np.diff(np.append(new, b - a)).astype(np.uint32), np.packbits(pair), c[pair], second[a:b], at.astype(np.uint16), docs.astype(np.uint16), train[docs].astype(np.int8)]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([int(to[a]), chunk, *(x.tobytes() for x in parts)], _ASK.types, strict=True)], _ASK.names)

    return run


@contextlib.contextmanager
def _mapped(trie: Trie, folder: str) -> Iterator[list[Trie]]:
    """The trie, written to the shared folder and opened there: mapped where the folder is a mounted one, else read into a buffer. The file goes when it is done with."""
    from pyarrow import fs

    files, path = filesystem(f"{folder}/{uuid.uuid4().hex}.trie")
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(path) as f:
        layout = trie.write(f)
    try:
        if isinstance(files, fs.LocalFileSystem):
            yield Trie.open(np.memmap(path, np.uint8, "r"), layout)
        else:
            with files.open_input_file(path) as f:
                yield Trie.open(np.frombuffer(f.read(), np.uint8), layout)
    finally:
        files.delete_file(path)


def _answer(tokens: int, kinds: int, prior: float, weight: float, split: np.ndarray, hot_n: np.ndarray, folder: str):
    """A shard: counts its training pairs and triples, writes and maps the trie, and sums up what each document asked. split: words that several shards have, by unsigned hash, hot_n their counts."""

    def run(group: pa.Table) -> pa.Table:
        if group.column("shard")[0].as_py() < 0:
            rows = group.to_pylist()
            heads = [b"".join(x[k] for k in ("words", "sizes", "firsts", "contexts")) for x in rows]
            return pa.Table.from_arrays([pa.array([x["chunk"] for x in rows], pa.int64()), *(pa.array([None] * len(rows), pa.binary()) for _ in range(4)), pa.array(heads, pa.binary())], _SUMS.names)
        read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in group.column(name)]
        asked, sizes, docs, train = read("words", np.uint64), read("sizes", np.uint32), read("docs", np.uint16), read("train", np.int8)
        # views of the group's own memory; only the contexts are spread to their tokens
        befores, rows = read("befores", np.uint32), read("rows", np.uint16)
        contexts = [c[np.cumsum(np.unpackbits(f, count=len(r))) - 1] for c, f, r in zip(read("contexts", np.uint32), read("firsts", np.uint8), rows, strict=True)]
        first = np.cumsum([0, *map(len, docs)])
        learns = np.concatenate(train) > 0
        every, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        # words in order, cut where about PART_TOKENS tokens are full
        weights = np.cumsum(np.bincount(inverse, np.concatenate(sizes), len(every)))
        cuts = [*np.unique(np.searchsorted(weights, np.arange(PART_TOKENS, weights[-1], PART_TOKENS)) + 1).tolist(), len(every)]
        numbers = np.split(inverse.astype(np.int32), np.cumsum([len(x) for x in asked])[:-1])
        ends = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in sizes]
        base, score, knew = np.zeros(first[-1]), np.zeros(first[-1]), np.zeros(first[-1], np.int32)
        low = 0
        for high in cuts:
            if high == low:
                continue
            word, context, before, doc = [], [], [], []
            for number, end, c, v, r, f in zip(numbers, ends, contexts, befores, rows, first.tolist(), strict=False):
                a, b = np.searchsorted(number, [low, high])
                if a < b:
                    word.append(np.repeat(number[a:b] - low, np.diff(end[a : b + 1])))
                    context.append(c[end[a] : end[b]])
                    before.append(v[end[a] : end[b]])
                    doc.append(r[end[a] : end[b]].astype(np.int32) + f)
            _sum_part(every[low:high], *map(np.concatenate, (word, context, before, doc)), learns, base, knew, score)
            low = high
        cut = lambda x: [x[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
        return pa.Table.from_arrays([group.column("chunk").combine_chunks(), *(pa.array(x, pa.binary()) for x in ([d.tobytes() for d in docs], cut(base), cut(knew), cut(score))), pa.array([None] * len(docs), pa.binary())], _SUMS.names)

    def _sum_part(every, word, context, before, doc, learns, base, knew, score) -> None:
        """Learns the pairs and triples of some words and adds what they give to the documents' sums."""
        learn = learns[doc]
        counts = np.bincount(word[learn], minlength=len(every))
        if len(split):
            at = np.minimum(np.searchsorted(split, every), len(split) - 1)
            counts = np.where(split[at] == every, hot_n[at], counts)
        # pairs and triples, each once
        half, mask = np.uint64(32), np.uint64(0xFFFFFFFF)
        pairs, of = np.unique((word.astype(np.uint64) << half) | context, return_inverse=True)
        triples, of3 = np.unique((of.astype(np.uint64) << half) | before, return_inverse=True)
        owner, left = (pairs >> half).astype(np.int64), (pairs & mask).astype(np.uint32)
        under, left3 = (triples >> half).astype(np.int64), (triples & mask).astype(np.uint32)
        seen = np.bincount(of[learn], minlength=len(pairs))
        seen3 = np.bincount(of3[learn], minlength=len(triples))
        single = lambda n: prior * (n + 1) / (tokens + kinds + 1)
        both = weight * (seen + single(counts)[owner])
        some, some3 = np.flatnonzero(seen), np.flatnonzero(seen3)
        built = Trie.build(
            every[counts > 0], counts[counts > 0],
            ((np.cumsum(counts > 0) - 1)[owner[some]], left[some]), np.log10(both[some]), np.log10(seen[some] + (weight * (counts + prior))[owner[some]]),
            ((np.cumsum(seen > 0) - 1)[under[some3]], left3[some3]), np.log10(seen3[some3] + both[under[some3]]),
        )
        with _mapped(built, folder) as trie:
            del built
            at, n = trie.lookup(every)
            pair = trie.pairs.find(at[owner], left)
            tops = trie.tops.get(pair, np.log10(weight * single(n)[owner]))
            downs = trie.downs.get(pair, np.log10(weight * (n + prior))[owner])
            logs = trie.thirds.get(trie.triples.find(pair[under], left3), tops[under])
            del trie
        # a pair is also the context of what follows it; nothing follows the end
        downs[every[owner] == END] = 0.0
        base += np.bincount(doc, np.log10(n + 1.0)[word], len(base))
        score += np.bincount(doc, logs[of3] - downs[of], len(base))
        knew += np.bincount(doc, (n > 0)[word], len(base)).astype(np.int32)

    return run


def _sum_up(group: pa.Table) -> pa.Table:
    """The rows of a chunk from its keys and what the shards returned."""
    head = next(x.as_py() for x in group.column("heads") if x.is_valid)
    n = len(head) // 18
    keys, nulls = np.frombuffer(head, np.int64, n), np.frombuffer(head, np.int8, n, 8 * n)
    sizes, train = np.frombuffer(head, np.int64, n, 9 * n), np.frombuffer(head, np.int8, n, 17 * n)
    base, score, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for d, b, k, s in zip(*(group.column(c).to_pylist() for c in ("docs", "base", "known", "score")), strict=True):
        if d is not None:
            at = np.frombuffer(d, np.uint16)
            base[at] += np.frombuffer(b)
            known[at] += np.frombuffer(k, np.int32)
            score[at] += np.frombuffer(s)
    return pa.table({"key": pa.array(keys, mask=nulls.astype(bool)), "train": train.astype(bool), "n_tokens": sizes, "n_known": known, "base": base, "score": score})


def score(docs: DataFrame, train: str, key: str = "doc_id", text: str = "text", prior: float = PRIOR, pair_weight: float = PAIR_WEIGHT, shard_tokens: int = SHARD_TOKENS, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """key, train, n_tokens, n_known, train_tokens, base_score, score of every whole text, learning from rows where column `train` is true.

    Tokens are lower-cased (A-Z) words between ASCII white space, and one end; a null or empty text has its end only. n_known: tokens that training texts
    have. base_score: log10 of (c + 1) / (N + V + 1) summed over tokens; score: the model's log10 probability. Repeated rows are scored each by itself and
    count each in training; a null in `train` is false. Without training rows every token is unknown. key: an integer column; a null stays null.
    """
    # a first look at the size decides on shards: bytes are at least twice the tokens
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(least_shards, int(size // 6 // shard_tokens) + 1)
    tokens, kinds, texts, top = corpus_counts(docs, key, text, train, shards)
    frequent = {k % 2**64: n for k, n in top.items()}  # words of more than half a shard are dealt by their contexts too; scores are the same
    split = np.array(sorted(frequent), np.uint64)
    hot_n = np.array([frequent[k] for k in split.tolist()], np.int64)
    asks = _frame(docs, key, text, train).mapInArrow(tidy(_ask(shards, split)), _ddl(_ASK))
    sums = asks.groupBy("shard").applyInArrow(tidy_group(_answer(tokens, kinds, prior, pair_weight, split, hot_n, fresh_dir(docs.sparkSession, "lm-tries"))), _ddl(_SUMS))
    rows = sums.groupBy("chunk").applyInArrow(_sum_up, "key long, train boolean, n_tokens long, n_known long, base double, score double")
    return rows.select(
        F.col("key").alias(key), "train", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(tokens + kinds + 1)))).alias("base_score"),
        (F.col("score") - F.log10(F.lit(texts + pair_weight * (texts + prior)))).alias("score"),
    )
