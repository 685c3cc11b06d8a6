"""Repeated passages by suffix arrays: Larsson-Sadakane refinement, Kasai's common prefixes, binary search between shards.

A window of `length` bytes holds a smallest piece: the position whose hash of PIECE bytes is least. Equal windows have it at the same place, so
windows that share their piece are candidates for each other and no others are. Neighbouring windows with one
piece form a run; pieces that occur once leave the search at once, and runs of equal bytes stand for each other. What is left, runs that
share a piece and differ, is dealt to shards by piece. Each shard sorts its suffixes; a window is repeated if a
neighbour in the array shares `length` bytes with it. A piece with very many runs is split over shards, whose sorted windows are
merged by binary search, in groups whose number grows with the shards. Pieces that a bounded sample shows to be heavy are dealt by their runs' bytes from the start, so
their runs do not meet in one task. So every repeat is found, and no shard outgrows its bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, numbered, small_batches, tidy, views
from .words import BYTE_VALUES, FACTOR, mix

#: Bytes of a repeated string, and of a piece within it.
LENGTH, PIECE = 200, 48
#: Runs of one piece in a shard at most, and bytes whose suffixes are sorted at once, about.
SHARD_RUNS, SHARD_BYTES = 4096, 1 << 20
#: Split pieces that are sent to every task.
FEW = 20_000
#: Texts that are looked at for heavy pieces, and the runs among them from which a piece is dealt by its runs' bytes. What is found only spreads the work: results do not depend on it.
HEAVY_TEXTS, HEAVY_RUNS = 4096, 8
#: Groups in which the windows of a split piece are merged, for each of its shards.
MERGES = 16
#: Window starts that are looked at together; longer texts go in overlapping parts.
PART = 2 << 20
_powers: list[np.ndarray] = []


def _power(n: int) -> np.ndarray:
    """FACTOR to the power -i modulo 2**64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.full(max(n, PART + (1 << 16)), np.uint64(pow(int(FACTOR), -1, 1 << 64)))
        inverse[0] = 1
        _powers[:] = [np.multiply.accumulate(inverse)]
    return _powers[0][:n]


def _forward(n: int) -> np.ndarray:
    if len(_powers) < 2 or len(_powers[1]) < n:
        _power(n)
        ahead = np.full(len(_powers[0]), FACTOR)
        ahead[0] = 1
        _powers[1:] = [np.multiply.accumulate(ahead)]
    return _powers[1][:n]


def piece_runs(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(piece hash, digest of the run's bytes, row, first window's place in the row, number of windows) of each run."""
    n = len(raw)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    # substring hashes from sums of byte values times powers
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * _forward(n), out=sums[1:])
    back = _power(n)
    count = n - piece + 1
    hashes = mix((sums[piece:] - sums[:count]) * back[:count])
    # least hash in each window, the rightmost of equal ones
    width = length - piece + 1
    keys = (hashes & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - np.arange(count, dtype=np.uint64))
    step = 1
    while 2 * step <= width:
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        step *= 2
    if step < width:
        keys = np.minimum(keys[: len(keys) - (width - step)], keys[width - step :])
    at = (np.uint64(0xFFFFFF) - (keys & np.uint64(0xFFFFFF))).astype(np.int64)
    # windows keep to a row
    starts = np.arange(len(at))
    ends_of_rows = np.repeat(offsets[1:], np.diff(offsets))[: len(at)]
    inside = starts + length <= ends_of_rows
    first = inside.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
    # a new row begins a new run even where windows touch: the one before it ended length bytes earlier
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    rows = np.searchsorted(offsets, a, "right") - 1
    digest = mix((sums[b + length] - sums[a]) * back[a] + (b - a).astype(np.uint64) * FACTOR)
    return hashes[at[a]], digest, rows, a - offsets[rows], b - a + 1


def _parts(raw: np.ndarray, offsets: np.ndarray, length: int, part: int = PART) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes skipped in it, bytes, offsets): rows together, a row beyond PART in overlapping parts."""
    if len(raw) <= 2 * part:
        yield 0, 0, raw, offsets
        return
    for r in range(len(offsets) - 1):
        for skip in range(0, max(1, int(offsets[r + 1] - offsets[r]) - length + 1), part):
            body = raw[offsets[r] + skip : min(offsets[r + 1], offsets[r] + skip + part + length - 1)]
            yield r, skip, body, np.array([0, len(body)])


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the place of each suffix in it.

    Larsson and Sadakane: suffixes start in groups by their first symbols; in each round the suffixes of groups with more than one
    member are sorted by the group of what follows, twice as far on, and finished ones are not touched again. text: below 511.
    """
    n = len(text)
    padded = np.zeros(n + 7, np.uint64)
    padded[:n] = text.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    # a group's number is one more than the place of its first member; 0 is the end of the text
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) + 1
    places = np.arange(n)
    h = 7
    while True:
        alone = fresh & np.append(fresh[1:], True)
        places = places[~alone]
        if not len(places):
            break
        some = order[places]
        key = rank[some] * (n + 2) + rank[np.minimum(some + h, n)]
        sort = np.argsort(key)
        some, key = some[sort], key[sort]
        order[places] = some
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[some] = np.maximum.accumulate(np.where(fresh, places, 0)) + 1
        h *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def common_prefixes(text: np.ndarray, order: np.ndarray, place: np.ndarray, lanes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """For the positions lanes[k] to lanes[k] + counts[k] - 1 the symbols shared with the suffix just before in the array, up to `most`; -1 elsewhere.

    Kasai's rule, one step on all lanes together: the next position shares at most one symbol less, so each comparison
    goes on where the last one stopped. Eight symbols are compared at once while they are equal.
    """
    n = len(text)
    padded = np.zeros(n + most + 8, np.uint8)
    wide = np.zeros(n + most + 8, bool)
    padded[:n], wide[:n] = text & 255, text > 255
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    packed = np.ascontiguousarray(eight).view(np.uint64).ravel()
    # where no separator stands within the next eight
    sep = np.zeros(n + most + 9, np.int64)
    np.cumsum(wide, out=sep[1:])
    plain = sep[8:] == sep[:-8]
    out = np.full(n, -1, np.int64)
    share = np.zeros(len(lanes), np.int64)
    for t in range(int(counts.max()) if len(counts) else 0):
        on = np.flatnonzero(counts > t)
        i = lanes[on] + t
        before = place[i] - 1
        has = before >= 0
        j = order[np.maximum(before, 0)]
        h = np.where(has, np.maximum(share[on] - 1, 0), 0)
        going = np.flatnonzero(has & (h < most))
        while len(going):
            x, y = i[going] + h[going], j[going] + h[going]
            inside = (x < n) & (y < n)
            x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
            same = (x + 8 <= n) & (y + 8 <= n) & (packed[x] == packed[y]) & plain[x] & plain[y]
            h[going[same]] += 8
            tail = going[~same & inside]
            if len(tail):
                x, y = i[tail] + h[tail], j[tail] + h[tail]
                left = np.ones(len(tail), bool)
                for k in range(8):
                    ok = (x + k < n) & (y + k < n)
                    a, b = np.minimum(x + k, n - 1), np.minimum(y + k, n - 1)
                    left &= ok & (text[a] == text[b])
                    h[tail[left]] += 1
            going = going[same]
            going = going[h[going] < most]
        share[on] = np.minimum(h, most)
        out[i] = share[on]
    return out


def shard_repeats(runs: list[bytes], windows: np.ndarray, length: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Which windows of each run are repeated in this shard; and (for merging) the first windows of each kind, as (run, window) in sorted order.

    A run of m windows has m + length - 1 bytes. Runs end in a separator that no byte equals.
    """
    sizes = np.array([len(r) for r in runs], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.full(int((sizes + 1).sum()), 256, np.int64)
    raw = np.frombuffer(b"".join(runs), np.uint8)
    text[np.arange(len(raw)) + np.repeat(np.arange(len(runs)), sizes)] = raw
    order, place = suffix_array(text)
    own = np.zeros(len(text), bool)
    own[np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts, windows)] = True
    prefix = common_prefixes(text, order, place, starts, windows, length)
    in_order = prefix[order]
    like_before = in_order >= length
    repeated = like_before.copy()
    repeated[:-1] |= like_before[1:]
    flags = np.zeros(len(text), bool)
    flags[order] = repeated
    kinds = order[own[order] & ~like_before]
    run = np.searchsorted(starts, kinds, "right") - 1
    return [flags[s : s + w] for s, w in zip(starts.tolist(), windows.tolist(), strict=True)], run, kinds - starts[run]


#: A run that is repeated as a whole; one that stands alone so far; one that stands for equal ones elsewhere.
WHOLE, ALONE, MANY = 0, 1, 2
_RUN = pa.schema([("dest", pa.int64()), ("piece", pa.int64()), ("digest", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("kind", pa.int8())])
_RUN_DDL = "dest long, piece long, digest long, row long, start long, windows int, kind byte"


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema.names)


def _same(piece: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of piece and digest, and True where another pair begins."""
    order = np.lexsort((digest, piece))
    p, d = piece[order], digest[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
    return order, fresh


def _heavy(rows: DataFrame, n: int, length: int, piece: int) -> np.ndarray:
    """Pieces with many runs in a bounded sample of rows, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in views(batch.column(0), PART):
                for _, _, body, offs in _parts(raw, offsets, length):
                    h, d, *_ = piece_runs(body, offs, length, piece)
                    found, count = np.unique(np.unique(np.stack([h, d], 1), axis=0)[:, 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count.astype(np.int64))], ["piece", "n"])

    share = F.lit(int(min(1.0, HEAVY_TEXTS / max(1, n)) * (2**31 - 1)))
    some = rows.where(F.xxhash64(F.lit("heavy"), "row").bitwiseAND(F.lit(2**31 - 1)) <= share).select("text")
    found = some.mapInArrow(tidy(run), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_RUNS).select("piece").toArrow()
    return np.sort(found.column("piece").to_numpy())


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _runs(docs: DataFrame, text: str, length: int, piece: int, heavy: np.ndarray) -> DataFrame:
    """The runs of all texts. Equal runs of one batch are settled here, and one of them goes on for all; dest deals those that go on by piece, those of heavy pieces by piece and bytes, and the settled by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = batch.column(0).to_numpy(), []
            for a, _, raw, offsets in views(batch.column(1), PART):
                for first, skip, body, offs in _parts(raw, offsets, length):
                    h, d, r, s, w = piece_runs(body, offs, length, piece)
                    found.append((h.view(np.int64), d.view(np.int64), names[a + first + r], s + skip, w))
            if not found:
                continue
            h, d, r, s, w = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(h):
                continue
            order, fresh = _same(h, d)
            h, d, r, s, w = h[order], d[order], r[order], s[order], w[order]
            count = np.diff(np.append(np.flatnonzero(fresh), len(h)))
            kind = np.where(count > 1, MANY, ALONE).astype(np.int8)
            p = h[fresh]
            dest = np.where(_in(p, heavy), mix((p ^ d[fresh]).view(np.uint64)).view(np.int64), p)
            yield _batch(_RUN, dest, p, d[fresh], r[fresh], s[fresh], w[fresh], kind)
            whole = np.repeat(count > 1, count)
            if whole.any():
                yield _batch(_RUN, r[whole], h[whole], d[whole], r[whole], s[whole], w[whole], np.zeros(whole.sum(), np.int8))

    return docs.select("row", text).mapInArrow(tidy(run), _RUN_DDL)


def _settle(heavy: np.ndarray):
    """Of the runs of a partition's pieces: lone pieces go; equal runs are repeated as wholes; of pieces with different runs one of each stays for the suffix arrays, as all of heavy pieces do, which no partition sees whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [[] for _ in _RUN.names]
        for batch in batches:
            settled = batch.column("kind").to_numpy() == WHOLE
            if settled.any():
                yield batch.filter(pa.array(settled))
            for k, c in enumerate(batch.columns):
                kept[k].append(c.to_numpy()[~settled])
        if not kept[0]:
            return
        _, piece, digest, row, start, windows, kind = (np.concatenate(x) for x in kept)
        order, fresh = _same(piece, digest)
        piece, digest, row, start, windows, kind = (x[order] for x in (piece, digest, row, start, windows, kind))
        at = np.flatnonzero(fresh)
        if not len(at):
            return
        count = np.diff(np.append(at, len(piece)))
        many = (count > 1) | (kind[at] == MANY)
        whole = np.repeat(count > 1, count)  # several batches had it
        new = np.ones(len(at), bool)
        new[1:] = piece[at][1:] != piece[at][:-1]
        kinds = np.diff(np.append(np.flatnonzero(new), len(at)))
        mixed = np.repeat((kinds > 1) | _in(piece[at][new], heavy), kinds)
        some = at[mixed]
        out = [(piece[whole], digest[whole], row[whole], start[whole], windows[whole], np.zeros(whole.sum(), np.int8)), (piece[some], digest[some], row[some], start[some], windows[some], np.where(many[mixed], MANY, ALONE).astype(np.int8))]
        for part in out:
            for i in range(0, len(part[0]), 100_000):
                p = [x[i : i + 100_000] for x in part]
                yield _batch(_RUN, p[0], *p)

    return run


_SPAN_DDL = "row long, a long, b long"
_SHARD = pa.schema([("row", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("piece", pa.int64()), ("bucket", pa.int64()), ("kinds", pa.binary()), ("places", pa.binary())])
_SHARD_DDL = _SPAN_DDL + ", piece long, bucket long, kinds binary, places binary"


#: A window's 16-byte digest as two integers, which sort as its bytes do.
PAIR = np.dtype([("x", ">u8"), ("y", ">u8")])


def _spans(rows: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, byte after the last) of the bytes under windows at these places, neighbours joined."""
    if not len(rows):
        return rows, places, places
    order = np.lexsort((places, rows))
    rows, places = rows[order], places[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (places[1:] > places[:-1] + 1)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(rows)) - 1
    return rows[at], places[at], places[last] + length


def _shard(length: int):
    """Suffix array of one shard: spans of its repeated windows; of a piece that is split over shards also its sorted windows, by bucket."""

    def run(group: pa.Table) -> pa.Table:
        import hashlib

        row, start = group.column("row").to_numpy(), group.column("start").to_numpy()
        _, one = np.unique(np.stack([row, start]), axis=1, return_index=True)
        row, start, windows = row[one], start[one], group.column("windows").to_numpy()[one].astype(np.int64)
        alone = group.column("kind").to_numpy()[one] == ALONE
        column = group.column("body")
        bodies = [column[i].as_py() for i in one.tolist()]
        flags, run_of, at = shard_repeats(bodies, windows, length)
        hits = [(np.full(f.sum(), r), s + np.flatnonzero(f)) for f, r, s, x in zip(flags, row.tolist(), start.tolist(), alone, strict=True) if x]
        r, p = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 2
        r, a, b = _spans(r.astype(np.int64), p.astype(np.int64), length)
        none = [None] * len(r)
        out = [pa.RecordBatch.from_arrays([pa.array(r), pa.array(a), pa.array(b), *(pa.array(none, t) for t in _SHARD.types[3:])], _SHARD.names)]
        if (parts := group.column("parts")[0].as_py()) is not None:
            buckets = parts * MERGES
            kinds = np.frombuffer(b"".join(hashlib.blake2b(bodies[k][x : x + length], digest_size=16).digest() for k, x in zip(run_of.tolist(), at.tolist(), strict=True)), PAIR)
            # where a window of this kind would be flagged: -1 where it is already
            open_ = np.array([alone[k] and not flags[k][x] for k, x in zip(run_of, at, strict=True)], bool)
            place = np.where(open_, start[run_of] + at, -1)
            into = kinds["x"].astype(np.uint64) % np.uint64(buckets)
            for bucket in np.unique(into).tolist():
                some = np.flatnonzero(into == bucket)
                some = some[np.argsort(kinds[some])]
                places = np.stack([row[run_of[some]], place[some]], 1).astype("<i8")
                out.append(pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 3 + [pa.array([group.column("piece")[0].as_py()]), pa.array([bucket], pa.int64()), pa.array([kinds[some].tobytes()], pa.binary()), pa.array([places.tobytes()], pa.binary())], _SHARD.names))
        return pa.Table.from_batches(out, pa.schema(list(zip(_SHARD.names, _SHARD.types, strict=True))))

    return run


def merge_kinds(parts: list[np.ndarray]) -> list[np.ndarray]:
    """For each shard's sorted, distinct windows: which of them another shard has too, by binary search in all."""
    everything = np.sort(np.concatenate(parts))
    return [np.searchsorted(everything, p, "right") - np.searchsorted(everything, p, "left") > 1 for p in parts]


def _merge(length: int):
    def run(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), PAIR) for x in group.column("kinds")]
        places = [np.frombuffer(x.as_py(), "<i8").reshape(-1, 2) for x in group.column("places")]
        hit = np.concatenate([q[h & (q[:, 1] >= 0)] for q, h in zip(places, merge_kinds(parts), strict=True)])
        r, a, b = _spans(hit[:, 0].astype(np.int64), hit[:, 1].astype(np.int64), length)
        return pa.table({"row": r, "a": a, "b": b})

    return run


def _bodies(length: int, text_at: int, runs_at: int):
    """A row for each of a text's runs with its bytes."""
    fields = pa.schema([("piece", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("kind", pa.int8()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                body, runs = batch.column(text_at)[k].as_py().encode(), batch.column(runs_at)[k].as_py()
                yield pa.RecordBatch.from_pylist([r | {"row": batch.column(0)[k].as_py(), "body": body[r["start"] : r["start"] + r["windows"] + length - 1]} for r in runs], fields)

    return run, "piece long, row long, start long, windows int, kind byte, body binary"


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, piece: int = PIECE, shard_runs: int = SHARD_RUNS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """row, a, b: byte ranges that repeated strings of `length` bytes cover; row is xxhash64(key, text). Ranges may overlap."""
    rows = small_batches(docs).select(F.xxhash64(key, text).alias("row"), F.col(text).alias("text")).where(F.octet_length("text") >= length)
    heavy = _heavy(rows, docs.count(), length, piece)
    runs = materialise(_runs(rows, "text", length, piece, heavy).repartition("dest").mapInArrow(tidy(_settle(heavy)), _RUN_DDL).drop("dest", "digest"), "runs")
    whole = runs.where(F.col("kind") == WHOLE).select("row", F.col("start").alias("a"), (F.col("start") + F.col("windows") + (length - 1)).alias("b"))
    differ = runs.where(F.col("kind") != WHOLE)
    n_bytes = differ.agg(F.sum(F.col("windows") + length)).first()[0] or 0
    shards = max(1, n_bytes // shard_bytes)
    # a set: rows alike share a name, and each of them looks its runs up once
    by_row = differ.groupBy("row").agg(F.collect_set(F.struct("piece", "start", "windows", "kind")).alias("runs"))
    fetch, ddl = _bodies(length, 1, 2)
    bodies = rows.join(by_row, "row").select("row", "text", "runs").mapInArrow(tidy(fetch), ddl)
    large = differ.groupBy("piece").count().where(F.col("count") > shard_runs).select("piece", F.ceil(F.col("count") / shard_runs).cast("long").alias("parts"))
    few = large.limit(FEW + 1).collect()
    if len(few) <= FEW:  # a checked size; with more of them Spark joins as it likes
        large = F.broadcast(docs.sparkSession.createDataFrame(few, "piece long, parts long"))
    dealt = bodies.join(large, "piece", "left").select(
        "piece", "row", "start", "windows", "kind", "body",
        "parts",
        F.coalesce(F.when(F.col("parts").isNotNull(), F.col("piece")), F.pmod("piece", F.lit(shards))).alias("shard"),
        F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("row", "start"), F.col("parts"))).otherwise(F.lit(-1)).alias("salt"),
    )
    sorted_ = materialise(dealt.groupBy("shard", "salt").applyInArrow(_shard(length), _SHARD_DDL), "shards")
    inner = sorted_.where("piece is null").select("row", "a", "b")
    across = sorted_.where("piece is not null").groupBy("piece", "bucket").applyInArrow(_merge(length), _SPAN_DDL)
    return whole.unionByName(inner).unionByName(across)


def _edge(body: bytes, at: int, step: int) -> int:
    """The next border of a character of UTF-8 from at on, back or ahead."""
    for k in range(at, at + 4 * step, step):
        if not 0 < k < len(body) or body[k] & 0xC0 != 0x80:
            return k
    return at


def _cut(width: int, whole: bool = False):
    """Cuts the bytes under the spans (the last column) out of the texts (the one before it); a null list cuts nothing. With whole, characters that a cut goes through go too, and a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(width).to_pylist(), batch.column(width + 1)
            offs = spans.offsets.to_numpy()
            a, b = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            full = spans.is_valid().to_numpy(zero_copy_only=False)
            sizes, removed, count, kept = [], [], [], []
            for k, body in enumerate(texts):
                sizes.append(len(body or b""))
                if not body or not full[k] or offs[k] == offs[k + 1]:
                    removed.append(0)
                    count.append(0)
                    kept.append(body if body or whole else b"")
                    continue
                x, y = a[offs[k] : offs[k + 1]], b[offs[k] : offs[k + 1]]
                order = np.argsort(x)
                x, y = x[order], np.maximum.accumulate(y[order])
                new = np.ones(len(x), bool)
                new[1:] = x[1:] > y[:-1]  # ranges that touch are one
                begin, end = x[new].tolist(), np.append(y[:-1][new[1:]], y[-1]).tolist()
                if whole:
                    begin = [_edge(body, i, -1) for i in begin]
                    end = [_edge(body, i, 1) for i in end]
                kept.append(b"".join(body[i:j] for i, j in zip([0, *end], [*begin, len(body)], strict=True)))
                removed.append(len(body) - len(kept[-1]))
                count.append(len(begin))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], [*batch.schema.names[:width], "n_bytes", "n_removed", "n_spans", "kept"])

    return run


NEW = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]


def _without(docs: DataFrame, key: str, text: str, length: int, keep: list[str], whole: bool, how: dict) -> DataFrame:
    """The columns in keep as c0, c1, .., by place, then n_bytes, n_removed, n_spans and kept."""
    frame, at = numbered(docs)
    spans = repeated_spans(frame, at[key], at[text], length, **how).groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    own = [F.col(at[c]).alias(f"c{k}") for k, c in enumerate(keep)]
    rows = frame.select(F.xxhash64(at[key], at[text]).alias("row"), *own, F.col(at[text]).cast("binary").alias("body"))
    both = rows.join(spans, "row", "left").select(*(f"c{k}" for k in range(len(keep))), "body", "spans")
    return both.mapInArrow(tidy(_cut(len(keep), whole)), T.StructType([*both.schema[: len(keep)], *NEW]))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep: list[str] | None = None, whole: bool = False, **how) -> DataFrame:
    """docs (or its columns in keep) with n_bytes, n_removed, n_spans (removed runs) and kept (binary: what is left of the text).

    Each byte is removed that lies in a string of `length` bytes which begins at another place too, of this text or any other.
    A null text is an empty one; texts below `length` bytes lose nothing. Rows with the same key and text are two texts that
    repeat each other, a null key makes no difference. With whole, what is left of a character of UTF-8 that a cut goes through is removed too, and kept is null for a null text. An empty table gives an empty result.
    Columns with the new names are replaced; columns of any other name stay as they are.
    """
    own = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name for f in NEW}]
    return _without(docs, key, text, length, own, whole, how).toDF(*own, *(f.name for f in NEW))


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, **how) -> DataFrame:
    """docs with the text less its repeated strings; columns of any name stay as they are.

    Of a character that a cut goes through nothing stays. A text without repeats stays as it is; a null text stays null.
    """
    others = [c for c in docs.columns if c != text]
    cut = _without(docs, key, text, length, others, True, how)
    place = {c: f"c{k}" for k, c in enumerate(others)}
    return cut.select(*(F.col("kept").cast("string") if c == text else F.col(place[c]) for c in docs.columns)).toDF(*docs.columns)
