import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest

from tideline.llm import align, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def specified():
    return align.specification(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def brute(rows):
    """Straight from the definition, with the libraries' own calls, over (key, text)."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printed = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    of = {chr(c): c for c in printed} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in printed)}
    assert isinstance(a.decoder, decoders.ByteLevel)
    spell_a = lambda i: bytes(of[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    tokens, linked, n_docs = [], [], {}
    for _, text in rows:
        ta = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        tb = b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not (text and b"".join(map(spell_a, ta)) == raw == b"".join(map(spell_b, tb))):
            ta, tb = [], []
        spans = []
        for ids, spell in ((ta, spell_a), (tb, spell_b)):
            at, own = 0, []
            for i in ids:
                own.append((i, at, at := at + len(spell(i))))
            spans.append(own)
        links, k = [], 0
        for i, x, y in spans[0]:
            while k and spans[1][k - 1][2] > x:
                k -= 1
            while k < len(spans[1]) and spans[1][k][1] < y:
                if spans[1][k][2] > x:
                    links.append((i, spans[1][k][0]))
                k += 1
        common = sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]})
        groups, x = [], 0
        pa, pb = iter(spans[0]), iter(spans[1])
        for end in common:
            side = []
            for it in (pa, pb):
                own = []
                for i, _, y in it:
                    own.append(str(i))
                    if y == end:
                        break
                side.append(",".join(own))
            groups.append("|".join(side))
        tokens.append((len(ta), len(tb), len(common), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if ta else ""))
        linked.append(links)
        for pair in set(links):
            n_docs[pair] = n_docs.get(pair, 0) + 1
    highest = {}
    for (i, _), n in n_docs.items():
        highest[i] = max(n, highest.get(i, 0))
    out = [(k, *t[:4], sum(n_docs[p] == highest[p[0]] for p in links), sum(n_docs[p] for p in links), t[4]) for (k, _), t, links in zip(rows, tokens, linked)]
    return sorted(map(repr, out)), n_docs


def found(frame):
    return sorted(repr(tuple(r)) for r in frame.select("doc_id", *align.LONGS, "groups_sha256").collect())


def test_op11_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op11_pair_counts(spark, SF)) == brute(rows)[0]


def odd():
    rng = random.Random(4)
    pool = ["the", "Straße", "日本語", "😀", "▁", "<|endoftext|>", "<s>", "</s>", "<0x41>", "á", "\t", "\n\n", "  ", "x" * 40, "12345", "\x00", " ", "ﬁ", "e" * 3]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randrange(0, 12)))) for i in range(150)]
    rows += [(1000 + i, "".join(rng.choices(pool, k=rng.randrange(0, 12)))) for i in range(150)]
    return rows + [(None, None), (None, "again"), (7, ""), (8, " "), (8, "same"), (8, "same"), (9, "long words " * 30_000)]


def test_odd_rows(spark, specified):
    rows = odd()
    frame = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "doc_id long, text string, a string, b string, pair int").repartition(3)
    want, n_docs = brute(rows)
    assert any(eval(r)[1] == 0 and eval(r)[0] not in (None, 7, 8) for r in want)  # some texts aren't given back
    got, counts = align.align(frame, specified)
    assert found(got) == want and len(counts.shards) <= 4
    # many slices, parts and shards
    sizes = align.Vocabularies(align.Tokenizers(*specified))
    ids = align.encoded(frame, specified)
    counts = align.count_pairs(ids, sizes, slice_tokens=50, held_pairs=100, shard_pairs=7)
    assert found(align.aligned(ids, sizes, counts).withColumnRenamed("key", "doc_id")) == want
    assert len(counts.shards) > 10 and {(r.a_id, r.b_id): r.n_docs for r in counts.frame(spark, 32_000).collect()} == n_docs
    none, counts = align.align(frame.limit(0), specified)
    assert none.count() == 0 and counts.shards == [] and counts.frame(spark, 32_000).count() == 0


def test_ranks_give_the_ids_of_the_library(specified):
    """On random strings of all sorts of characters, and between letters, digits and spaces for code points of every block."""
    both, plain = align.Tokenizers(*specified), align.Tokenizers(*specified)
    assert both.fast
    plain.fast = None
    rng = random.Random(8)
    marks = [" ", "  ", "\n", "\t", "\u00a0", "\u2581", "\u200b", "\x1c", "\x85", "\u3000", "'", "'s", ".", ",", "¿", "1", "é", "e\u0301", "日", "😀", "<s>", "<|endoftext|>", "<0x41>", "x", "Word", "d'un", "ǅ", "\u0378", "ⅷ"]
    texts = ["".join(rng.choices(marks, weights=[12] + [1] * (len(marks) - 1), k=rng.randrange(1, 30))) for _ in range(3000)]
    texts += [f"a{c}b 1{c}2 {c} .{c}. '{c}s{c} \t{c}{c} " for c in map(chr, range(0, 0x110000, 97)) if not "\ud800" <= c <= "\udfff"]
    assert both.ids(texts) == plain.ids(texts)
    spec = json.loads(specified[0])
    assert align.ranked(spec | {"normalizer": {"type": "Lowercase"}}) is None


def test_groups_join_to_the_text(spark, specified):
    both = align.Tokenizers(*specified)
    text = "Grüße aus <Köln>, tokenization  misalignments 😀!"
    got = align.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), specified, groups=True)[0].first()
    sides = [g.split("|") for g in got.groups.split(";")]
    a, b = ([b"".join(spell[int(i)] for i in side.split(",")) for side in part] for part, spell in zip(zip(*sides), (both.a_bytes, both.b_bytes)))
    assert a == b and b"".join(a).decode() == " " + text and hashlib.sha256(got.groups.encode()).hexdigest() == got.groups_sha256


def test_summed_and_lookup(tmp_path):
    keys, counts = align.summed(np.array([5, 1, 5, 9]), np.array([1, 2, 3, 4]))
    assert keys.tolist() == [1, 5, 9] and counts.tolist() == [2, 4, 4]
    assert align.summed(np.zeros(0, np.int64), np.zeros(0, np.int64))[0].tolist() == []
    shards = []
    for i, part in enumerate(([1, 5], [9])):
        path = tmp_path / f"{i}.pairs"
        path.write_bytes(np.array(part + [10 * k for k in part], "<i8").tobytes())
        shards.append((str(path), part[0], part[-1], len(part)))
    table = align.PairCounts(shards, np.zeros(1, np.int64))
    assert table.lookup(np.array([0, 1, 2, 5, 6, 9, 10])).tolist() == [0, 10, 0, 50, 0, 90, 0]
