import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import common, words

TEXTS = st.lists(st.text(alphabet="aBz09 \t\x1c\n\xa0é-:`{", max_size=12), min_size=1, max_size=6)
PATTERNS = {"SPACED": rb"[^\x20\x09-\x0D]+", "ALNUM": rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_patterns(texts):
    bodies = [t.encode() for t in texts]
    raw = words.LOWER[np.frombuffer(b"".join(bodies), np.uint8)]
    offsets = np.cumsum([0, *map(len, bodies)])
    for table, pattern in PATTERNS.items():
        starts, ends, rows = words.word_ranges(raw, offsets, getattr(words, table))
        got = [(r, raw[a:b].tobytes()) for a, b, r in zip(starts.tolist(), ends.tolist(), rows.tolist())]
        assert got == [(r, w) for r, b in enumerate(bodies) for w in re.findall(pattern, b.lower())]
        hashes = words.word_hashes(raw, starts, ends)
        assert len(set(zip(hashes.tolist(), (w for _, w in got)))) == len({w for _, w in got}) == len(set(hashes.tolist()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=9)), max_size=12), st.integers(1, 20), st.integers(0, 3))
def test_views_cover_every_row(texts, limit, skip):
    column = pa.array(["x" * skip, *texts], pa.string())[1:]
    seen = []
    for a, b, raw, offsets in common.views(column, limit):
        assert a == len(seen) and len(offsets) == b - a + 1
        seen += [raw[x:y].tobytes() for x, y in zip(offsets, offsets[1:])]
    assert seen == [(t or "").encode() for t in texts]
