import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tideline.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " ", "\n\n  a", "a\x00b", "<|endoftext|>", "naïve Ünïcode 😀😀", "x" * 5000, "  lead and trail  ", "it's I'LL", "  z", "日本語テキスト", "1234567 890", "a\r\n\tb" * 40]


@pytest.fixture(scope="module")
def truth():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_odd_texts(spark, truth):
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(ODD + ODD[:3])], "doc_id long, text string, ids string, n_tokens int")
    tokens = bpe.read_ranks(PATH)
    got = bpe.decode(bpe.encode(docs, tokens, public_tokenizers.PATTERN), tokens).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        text = (ODD + ODD[:3])[r["doc_id"]] or ""
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == truth.encode_ordinary(text)
        assert r["n_tokens"] == len(r["ids"]) // 4 and bytes(r["decoded"]) == text.encode()


def test_bpe_empty_table(spark):
    tokens = bpe.read_ranks(PATH)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, tokens, public_tokenizers.PATTERN), tokens).count() == 0


def test_op3_against_tiktoken(spark, truth):
    sf = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op3_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = truth.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_decode_refuses_a_clash(spark):
    with pytest.raises(ValueError):
        bpe.decode(spark.range(1).select(F.lit(b"").alias("ids"), F.lit(1).alias("decoded")), [b"a"])


WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_prefix_counts_are_exact_at_every_prefix(library):
    from tideline.llm import counting

    p = counting.Prefixes(counting.load(WORDS))
    for word in ["internationalisation", "thhatheresttion", "éleauxê", "zzzzzzzzzzzz", "don", "x", "ß" * 60, "!!!???...", "日本語"]:
        got = p.counts(word)
        assert got == [len(library.encode(word[:i], add_special_tokens=False).ids) for i in range(len(word) + 1)]
    text = "The  quick brownish fox<|endoftext|>jumps; overs 42 unbelievables"
    n = len(library.encode(text, add_special_tokens=False).ids)
    tokens = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for text in [text, "unbelievably thhatherest words here", "<|endoftext|><|endoftext|>ab", "one\u2003 TWO\n\nthree 4", "éleauxê   étés"]:
        table, shown = p.table(text), "".join(x if special else p.normal(x) for x, special in p.pieces(text))
        n = tokens(text)
        assert table[-1] == n and table == sorted(table) and p.cut(text, table, n) is None
        # the table has the exact count at the end of every word
        ends = [sum(map(len, p.place(text, k)[1:])) + p.place(text, k)[0] for k in range(len(table) - 1)]
        assert table == [0] + [tokens(shown[:e]) for e in ends]
        borders = {i for i in range(len(shown) + 1) if not any(p.place(text, k)[0] < i < e and p.place(text, k)[1] in p.special_strings for k, e in enumerate(ends))}
        for budget in range(n):
            assert p.cut(text, table, budget) == max((i for i in borders if tokens(shown[:i]) <= budget and (i in ends or i == 0 or any(p.place(text, k)[0] < i < e for k, e in enumerate(ends)))), default=0), (text, budget)


def test_token_counts_of_odd_texts(spark, library):
    from tideline.llm import counting

    texts = ODD + ["ΟΔΥΣΣΕΥΣ Σ", "é İstanbul", "a\x1cb\x85c d", "<|startoftext|>a<|endoftext|><|endoftext|> b", "<|ENDOFTEXT|>", "'s 's' don'T", "½²٣", "ﬁ ǅ"]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(0, "", 9)], "doc_id long, text string, n_tokens int")
    got = counting.token_counts(docs, counting.load(WORDS), budget=3).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)), t
        assert (r.cut_chars is not None) == (r.n_tokens > 3)
    assert counting.token_counts(docs.limit(0), counting.load(WORDS)).count() == 0


def test_op7_against_the_library(spark, library):
    sf = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op7_prefix_counts(spark, sf).collect()
    want = {k: len(e.ids) for k, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
