"""Monotone integers in Elias-Fano code, and an n-gram trie of three levels made of them, in flat arrays that can be memory-mapped.

A value's low bits are stored as they are; its high bits in unary, a one for each value and a zero for each step of the high part. All
queries are answered for many values at once, in numpy, on the packed arrays.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_WORD = 64


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest `width` bits of each value, one after the other, in 64-bit words (two more than needed)."""
    n = len(values)
    out = np.zeros(n * width // _WORD + 2, U)
    if not n or not width:
        return out
    at = np.arange(n, dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(U)
    values = values.astype(U) & U((1 << width) - 1)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out[word[first]] |= np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero(shift.astype(np.int64) + width > _WORD)
    out[word[over] + 1] |= values[over] >> (U(_WORD) - shift[over])
    return out


def unpack(words: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(index), U)
    at = index.astype(np.int64) * width
    word, shift = at >> 6, (at & 63).astype(U)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((U(_WORD) - shift) & U(63)), U(0))
    return (low | high) & U((1 << width) - 1)


def select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one (from 0) in each word."""
    at, words, k = np.zeros(len(words), np.int64), words.copy(), k.astype(np.int64).copy()
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words & U((1 << half) - 1)).astype(np.int64)
        up = k >= low
        k -= np.where(up, low, 0)
        at += np.where(up, half, 0)
        words = np.where(up, words >> U(half), words)
    return at


class EliasFano:
    """Sorted unsigned 64-bit integers. The arrays low, high, ones and zeros (running counts before each word of high) hold everything."""

    def __init__(self, n: int, width: int, low, high, ones, zeros):
        self.n, self.width, self.low, self.high, self.ones, self.zeros = n, width, low, high, ones, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = min(63, max(0, (top // max(n, 1)).bit_length() - 1))
        upper = (values >> U(width)).astype(np.int64)
        bits = n + (int(upper[-1]) if n else 0) + 1
        marks = np.zeros((bits // _WORD + 1) * _WORD, bool)
        marks[upper + np.arange(n)] = True
        high = np.packbits(marks, bitorder="little").view(U)
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(count)])
        return cls(n, width, pack(values, width), high, ones, np.arange(len(ones)) * _WORD - ones)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high, self.ones, self.zeros]

    @classmethod
    def from_arrays(cls, head, *rest) -> EliasFano:
        return cls(int(head[0]), int(head[1]), *rest)

    def _select(self, counts: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(counts, k, "right") - 1
        body = self.high[np.minimum(word, len(self.high) - 1)]
        return word * _WORD + select_in_word(~body if flip else body, k - counts[word])

    def get(self, index: np.ndarray) -> np.ndarray:
        index = index.astype(np.int64)
        upper = self._select(self.ones, index, False) - index
        return (upper.astype(U) << U(self.width)) | unpack(self.low, self.width, index)

    def below(self, upper: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part."""
        out = np.zeros(len(upper), np.int64)
        some = upper > 0
        out[some] = self._select(self.zeros, upper[some] - 1, True) - (upper[some] - 1)
        return out

    def successor(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The index of the first stored value from begin on, and before end, that is not smaller; end if there is none. By default all n are searched."""
        begin = np.zeros(len(values), np.int64) if begin is None else begin
        end = np.full(len(values), self.n, np.int64) if end is None else end
        out = end.copy()
        if not self.n:
            return out
        last = int(self.get(np.array([self.n - 1]))[0])
        some = np.flatnonzero((values <= U(last)) & (begin < end))
        want = values[some]
        upper = (want >> U(self.width)).astype(np.int64)
        a, b = np.maximum(self.below(upper), begin[some]), np.minimum(self.below(upper + 1), end[some])
        rest = want & U((1 << self.width) - 1)
        while len(open_ := np.flatnonzero(a < b)):
            middle = (a[open_] + b[open_]) >> 1
            less = unpack(self.low, self.width, middle) < rest[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
        out[some] = np.minimum(a, end[some])
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """The index of each value, -1 where it is not stored."""
        at = self.successor(values)
        ok = at < self.n
        ok[ok] = self.get(at[ok]) == values[ok]
        return np.where(ok, at, -1)


class Level:
    """The contexts under each entry of the level above: pointers say where an entry's contexts begin, and both are monotone.

    A context is stored relative to its entry: on top of the last value of the entry before that has any. So the level rises as a whole, and a context
    is looked for only between its entry's pointers.
    """

    def __init__(self, pointers: EliasFano, contexts: EliasFano):
        self.pointers, self.contexts = pointers, contexts

    @classmethod
    def of(cls, above: int, owner: np.ndarray, contexts: np.ndarray) -> Level:
        """owner: the number, of `above`, of each context's entry; contexts rise within an entry and stay below 2^32."""
        starts = np.searchsorted(owner, np.arange(above + 1))
        some = np.flatnonzero(starts[1:] > starts[:-1])
        span = np.zeros(above, U)
        span[some] = contexts[starts[some + 1] - 1].astype(U) + U(1)
        return cls(EliasFano.of(starts.astype(U)), EliasFano.of((np.cumsum(span, dtype=U) - span)[owner] + contexts.astype(U)))

    def arrays(self) -> list[np.ndarray]:
        return [*self.pointers.arrays(), *self.contexts.arrays()]

    def find(self, above: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """The index of each context under its entry; -1 where it is not stored, or the entry is -1."""
        out = np.full(len(above), -1, np.int64)
        known = np.flatnonzero(above >= 0)
        begin, end = (self.pointers.get(above[known] + k).astype(np.int64) for k in (0, 1))
        filled = begin < end
        known, begin, end = known[filled], begin[filled], end[filled]
        want = contexts[known].astype(U)
        later = np.flatnonzero(begin)
        want[later] += self.contexts.get(begin[later] - 1) + U(1)
        at = self.contexts.successor(want, begin, end)
        near = np.flatnonzero(at < end)
        hit = near[self.contexts.get(at[near]) == want[near]]
        out[known[hit]] = at[hit]
        return out


class Codes:
    """Logarithms in 16 bits, linear between the least and the greatest."""

    def __init__(self, scale: np.ndarray, codes: np.ndarray):
        self.scale, self.codes = scale, codes

    @classmethod
    def of(cls, logs: np.ndarray) -> Codes:
        low, high = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
        step = max((high - low) / 65535, 1e-12)
        return cls(np.array([low, step]), np.rint((logs - low) / step).astype(np.uint16))

    def arrays(self) -> list[np.ndarray]:
        return [self.scale, self.codes]

    def get(self, index: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        """The logarithm at each index, `otherwise` at -1."""
        out = otherwise.copy()
        some = np.flatnonzero(index >= 0)
        out[some] = self.scale[0] + self.scale[1] * self.codes[index[some]]
        return out


class Trie:
    """Words with their counts, under each word the words before it, and under each such pair the words before that.

    words: sorted hashes. pairs, triples: levels of 32-bit hashes of preceding words. tops: for each pair the log of what it gives to a probability
    whose triple is not stored; downs: the log that is taken off where the pair itself is the context; thirds: the log of each triple.
    """

    def __init__(self, words: EliasFano, counts: np.ndarray, pairs: Level, tops: Codes, downs: Codes, triples: Level, thirds: Codes):
        self.words, self.counts, self.pairs, self.tops, self.downs, self.triples, self.thirds = words, counts, pairs, tops, downs, triples, thirds

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray, pairs: tuple, tops: np.ndarray, downs: np.ndarray, triples: tuple, thirds: np.ndarray) -> Trie:
        """pairs, triples: the number of the entry above and the context of each, in order; then what belongs to them."""
        return cls(EliasFano.of(words), counts.astype(np.uint64), Level.of(len(words), *pairs), Codes.of(tops), Codes.of(downs), Level.of(len(tops), *triples), Codes.of(thirds))

    def write(self, stream) -> list[tuple]:
        """All arrays one after the other; their type, length and place."""
        layout, at = [], 0
        for x in [a for part in (self.words, self.pairs, self.triples, self.tops, self.downs, self.thirds) for a in part.arrays()] + [self.counts]:
            layout.append((x.dtype.str, len(x), at))
            stream.write(x.tobytes() + b"\0" * (-x.nbytes % 8))
            at += x.nbytes + -x.nbytes % 8
        return layout

    @classmethod
    def open(cls, body: np.ndarray, layout: list[tuple]) -> Trie:
        """The trie over the bytes that write() wrote, such as a memory map of its file."""
        a = [np.frombuffer(body, kind, n, at) for kind, n, at in layout]
        words, *rest = (EliasFano.from_arrays(*a[k : k + 5]) for k in range(0, 25, 5))
        tops, downs, thirds = (Codes(*a[k : k + 2]) for k in (25, 27, 29))
        return cls(words, a[31], Level(*rest[:2]), tops, downs, Level(*rest[2:]), thirds)

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each word; -1 and 0 for an unknown one."""
        at = self.words.find(words)
        return at, np.where(at >= 0, self.counts[np.maximum(at, 0)] if len(self.counts) else 0, 0).astype(np.int64)
