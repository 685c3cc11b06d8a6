"""Exact token counts at every prefix of a text, by dynamic programming over the prefixes of its words.

For byte-pair vocabularies with word ends. The encoding of a prefix ends with the one token that may stand behind the encoding
of what is before it: two tokens may be neighbours if no merge across their border comes before the merges that made them. So a word's
prefixes are solved each from a shorter one, and a text's table of counts at every word's end is summed up from its words'. The whole count,
truncation and budgets are then looked up in the tables, by binary search, and nothing is encoded again.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import small_batches, tidy

#: Words, prefixes and pairs that a worker remembers of each kind; beyond it, it starts anew.
MEMORY = 400_000
#: Prefixes of longer words are not remembered.
LONG = 40
#: White space of Unicode.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_loaded: dict[int, tuple] = {}


class Prefixes(dict):
    """From a word to its number of tokens, filled as words come."""

    def __init__(self, spec: dict):
        import regex

        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        vocab = model["vocab"]
        #: Tokens within a word, and those that end it (without the mark).
        self.inner = {t for t in vocab if not t.endswith(self.end)}
        self.last = {t[: -len(self.end)] for t in vocab if t.endswith(self.end)}
        self.longest = max(map(len, vocab))
        self.mapped = dict(enumerate(byte_characters()))
        self.prefix: dict[str, tuple[str, int]] = {"": ("", 0)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.edges: dict[tuple[str, bool], list[tuple[str, int]]] = {}
        #: The merge that makes each token; every token has one, and its rank is above those of its parts.
        self.made = {a + b: (a, b, i) for (a, b), i in self.rank.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", WHITE))
        self.white = regex.compile(f"[{WHITE}]+")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.special_strings = special

    def merged(self, parts: list[str]) -> list[str]:
        """The merges of byte-pair encoding, best rank first."""
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _edge(self, token: str, right: bool) -> list[tuple[str, int]]:
        """The parts that stood at a token's edge while it was made, each with the rank of the merge that ended it; the token itself never ends."""
        known = self.edges.get((token, right))
        if known is None:
            known, ended = [], 1 << 60
            while token in self.made:
                known.append((token, ended))
                a, b, ended = self.made[token]
                token = b if right else a
            known.append((token, ended))
            self.edges[known[0][0], right] = known
        return known

    def neighbours(self, a: str, b: str) -> bool:
        """Whether token a may stand before token b: no merge of parts at the border ranks before those that took the parts up. Of equal ranks the left one is first."""
        if not a:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            rank = self.rank.get
            known = True
            for x, x_ends in self._edge(a, True):
                for y, y_ends in self._edge(b, False):
                    if (m := rank((x, y))) is not None and m < x_ends and m <= y_ends:
                        known = False
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def state(self, text: str) -> tuple[str, int]:
        """Last token and number of tokens of a prefix, taken as the beginning of a longer word. text: mapped characters."""
        if (known := self.prefix.get(text)) is not None:
            return known
        if len(text) > LONG:
            return self.parts(text)[-1]
        for n in range(min(len(text), self.longest), 0, -1):
            if (piece := text[-n:]) in self.inner:
                last, count = self.state(text[:-n])
                if self.neighbours(last, piece):
                    if len(self.prefix) >= MEMORY:
                        self.prefix = {"": ("", 0)}
                    self.prefix[text] = found = (piece, count + 1)
                    return found
        raise ValueError(f"no encoding of {text!r}")

    def parts(self, text: str) -> list[tuple[str, int]]:
        """state() of each prefix from none to all, from left to right."""
        done = [("", 0)]
        for i in range(1, len(text) + 1):
            for n in range(min(i, self.longest), 0, -1):
                piece = text[i - n : i]
                if piece in self.inner and self.neighbours(done[i - n][0], piece):
                    done.append((piece, done[i - n][1] + 1))
                    break
            else:
                raise ValueError(f"no encoding of {text[:i]!r}")
        return done

    def whole(self, text: str, before=None) -> int:
        """The number of tokens of a whole word. before: the states of its prefixes, if they are there."""
        for n in range(min(len(text), self.longest), 0, -1):
            if (piece := text[-n:]) in self.last:
                last, count = before[len(text) - n] if before else self.state(text[:-n])
                if self.neighbours(last, piece + self.end):
                    return count + 1
        raise ValueError(f"no encoding of {text!r}")

    def of_bytes(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.mapped)

    def __missing__(self, word: str) -> int:
        text = self.of_bytes(word)
        count = self.whole(text, self.parts(text) if len(text) > LONG else None)
        if len(self) >= MEMORY:
            self.clear()
        self[word] = count
        return count

    def counts(self, word: str) -> list[int]:
        """The number of tokens of each prefix of a word, taken as a whole word; from no character to all."""
        text, at = self.of_bytes(word), [0]
        done = self.parts(text)
        for c in word:
            at.append(at[-1] + len(c.encode()))
        return [0] + [self.whole(text[:i], done) for i in at[1:]]

    def folded(self, text: str) -> str:
        """text composed and in lower case."""
        import unicodedata

        text = unicodedata.normalize("NFC", text)
        # each character by itself: a final sigma is as any other
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def normal(self, text: str) -> str:
        """The normalised text: white space is one blank, composed, in lower case."""
        return self.white.sub(" ", self.folded(text))

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text's parts and whether each is a special token."""
        if self.special is None or not any(s in text for s in self.special_strings):
            yield text, False
            return
        for k, part in enumerate(self.special.split(text)):
            yield part, k % 2 == 1

    def table(self, text: str) -> list[int]:
        """The exact number of tokens of the text up to the end of each word, after a 0 for none. Special tokens are words of their own."""
        found: list[int] = []
        for part, special in self.pieces(text):
            found += [1] if special else map(self.__getitem__, self.words.findall(self.folded(part)))
        return list(accumulate(found, initial=0))

    def place(self, text: str, word: int) -> tuple[int, str]:
        """Where word number `word` begins in the normalised text, and the word; special tokens stand in the normalised text as they are."""
        base = 0
        for part, special in self.pieces(text):
            shown = part if special else self.normal(part)
            if special:
                if not word:
                    return base, part
                word -= 1
            else:
                for m in self.words.finditer(shown):
                    if not word:
                        return base + m.start(), m[0]
                    word -= 1
            base += len(shown)
        raise IndexError("no such word")

    def cut(self, text: str, table: list[int], budget: int) -> int | None:
        """Characters of the longest prefix of the normalised text, to the end of a word or within one, of at most budget tokens; None if all of it is within. Looked up in the text's table and in the word's."""
        k = bisect_right(table, budget) - 1
        if k == len(table) - 1:
            return None
        start, word = self.place(text, k)
        special = self.special is not None and word in self.special_strings
        inside = last_within(self.counts(word), budget - table[k]) if not special else 0
        if inside or not k:
            return start + inside if inside else 0
        before, last = self.place(text, k - 1)
        return before + len(last)


def last_within(counts: list[int], budget: int) -> int:
    """The last place whose count is within the budget; counts of a word's prefixes may fall as well as rise."""
    return max(i for i, k in enumerate(counts) if k <= budget)


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _prefixes(shipped) -> Prefixes:
    at = id(shipped.value)
    if at not in _loaded:
        _loaded.clear()
        _loaded[at] = (Prefixes(shipped.value), shipped.value)
    return _loaded[at][0]


def token_counts(docs: DataFrame, spec: dict, budget: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens of every whole text, and with a budget cut_chars: the longest prefix (characters of the normalised text) within it, null if all fits. Both are read off one table a text.

    spec: a tokenizer's .json. A null text is an empty one: no bytes, no tokens. Strings of special tokens in a text are one token each,
    as the tokenizers library has it by default. Rows stand for themselves; other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(spec)  # the vocabulary, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = _prefixes(shipped)
        for batch in batches:
            n, cuts = [], []
            for text in batch.column(1):
                counts = prefixes.table(body := text.as_py() or "")
                n.append(counts[-1])
                if budget is not None:
                    cuts.append(prefixes.cut(body, counts, budget))
            columns = [batch.column(0), pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64()), pa.array(n, pa.int64())]
            if budget is not None:
                columns.append(pa.array(cuts, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [key, "n_bytes", "n_tokens", "cut_chars"][: len(columns)])

    frame = small_batches(docs.select(F.col(key), F.col(text)))
    return frame.mapInArrow(tidy(run), f"`{key}` {frame.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long" + (", cut_chars long" if budget is not None else ""))
