"""Words of many texts at once: byte ranges and 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

#: Lower-cases A-Z and leaves other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: An odd factor for polynomial hashes modulo 2**64, and the tables of its powers.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def byte_table(separators: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes of words: those outside the ranges."""
    out = np.ones(256, bool)
    for a, b in separators:
        out[a : b + 1] = False
    return out


#: Between words: ASCII white space; or all of ASCII but digits and lower-case letters (after lower-casing).
SPACED = byte_table([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = byte_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random-looking value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * FACTOR)


def word_ranges(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, row) of each word; words never cross rows. raw: the rows' bytes together."""
    inside = table[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0], edge[-1] = (inside[0], inside[-1]) if len(raw) else (False, False)
    edge[1:-1] = inside[1:] != inside[:-1]
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[::2], bounds[1::2]
    # a word that runs over the end of a row is cut there
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    cuts = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial of its bytes, mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    # the words' bytes alone, each with its place in its word
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(firsts, lengths)
    longest = int(lengths.max())
    powers = np.ones(longest, np.uint64)
    if longest > 1:
        powers[1:] = FACTOR
        powers = np.multiply.accumulate(powers)
    values = BYTE_VALUES[raw[np.repeat(starts - firsts, lengths) + np.arange(total)]] * powers[place]
    return mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64) * FACTOR)
