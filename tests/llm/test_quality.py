import math
import random
import re
from collections import Counter

import pytest

from tideline.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, window=8):
    words, text = WORD.findall(text or ""), text or ""
    wins = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    hit = set()
    for i in range(len(words) - window + 1):
        if wins[tuple(words[i : i + window])] > 1:
            hit |= set(range(i, i + window))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed)


def base(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_counts_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "a\xa0b c d", "x\x1cy z", "😀 é #$ \x0b|", "same line\nsame line\n same line\n\n\n", "w " * 8, "w " * 9, "w " * 15, "a b c d e f g h " * 2, "long " * 30_000]
    for _ in range(80):
        texts.append(rng.choice(["", " "]) + rng.choice([" ", "\n", "  "]).join(rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randrange(90))))
    docs = spark.createDataFrame([(i, t, "en", 5) for i, t in enumerate(texts)] + [(0, None, None, 5)], "doc_id long, text string, lang string, kept int")
    got = quality.judge(docs, []).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert base(r) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept == (not r.base_failed)
    assert quality.judge(docs.limit(0), []).count() == 0 and quality.references(docs.limit(0)) == []


def jsd(p, q):
    part = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x)
    return math.sqrt(max(0.0, (part(p, q) + part(q, p)) / 2))


def test_distances_against_brute_force(spark):
    known = [("en", ["the", "of"], [0.2, 0.1, 0.7], [0.6, 0.2, 0.1, 0.05, 0.0, 0.0, 0.05]), (quality.POOLED, ["of"], [0.3, 0.7], [1 / 7] * 7)]
    texts = [("The cat of the house, 12 é# " * 20, "en"), ("of of Of x " * 30, None), ("of of Of x " * 30, "zz"), ("tiny text " * 12, "en")]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality.judge(docs, known).collect():
        text, lang = texts[r.doc_id]
        _, common, shares, classes = known[0 if lang == "en" else 1]
        words = [w.lower() for w in WORD.findall(text)]
        hist = [words.count(c) for c in common]
        hist.append(len(words) - sum(hist))
        if len(words) >= 100:
            assert r.words_distance == pytest.approx(jsd([h / len(words) for h in hist], shares))
        else:
            assert r.words_distance is None
        rest, n = text, []
        for pattern in quality.CLASSES.values():
            less = re.sub(pattern, "", rest)
            n.append(len(rest) - len(less))
            rest = less
        n.append(len(rest))
        if len(words) >= 30:
            assert r.chars_distance == pytest.approx(jsd([x / len(text) for x in n], classes))
        else:
            assert r.chars_distance is None


def test_op8_keeps_clean_documents_and_drops_junk(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()}
    got = {r.doc_id: r for r in queries.op8_quality_divergence(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert base(r) == brute(texts[i])
        assert not (r.kept and r.base_failed)
    good = [i for i, q in labels.items() if q == 1 and not got[i].base_failed]
    bad = [i for i, q in labels.items() if q == 0]
    assert all(got[i].kept for i in good) and sum(not got[i].kept for i in bad) >= 0.8 * len(bad)


def test_references_are_of_all_texts_each_weighed_once(spark):
    """More texts than any sample, one of them long, some without an id: brute force over all of them."""
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        lang = ("en", "en", "de", None)[i % 4]
        rows.append((i if i % 5 else None, " ".join(rng.choice("The of and House x1 é.".split()) for _ in range(rng.randrange(1, 40))), lang))
    rows += [(5000, "log 12345 |# " * 50_000, "en"), (5001, " \n ", "de"), (5002, "", "en"), (5003, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = {k[0]: k[1:] for k in quality.references(docs)}
    assert set(known) == {"en", "de", quality.POOLED}
    for name, (common, shares, classes) in known.items():
        texts = [t for _, t, lang in rows if t and (lang == name or name == quality.POOLED and lang)]
        words, chars, n = Counter(), [0.0] * 7, 0
        for t in texts:
            found = WORD.findall(t.lower())
            n += bool(found)
            for x, c in Counter(found).items():
                words[x] += c / len(found)
            rest = t
            for i, pattern in enumerate(quality.CLASSES.values()):
                less = re.sub(pattern, "", rest)
                chars[i] += (len(rest) - len(less)) / len(t)
                rest = less
            chars[6] += len(rest) / len(t)
        assert set(common) == set(words) and shares[:-1] == pytest.approx([words[x] / n for x in common], abs=1e-6)
        assert classes == pytest.approx([c / len(texts) for c in chars], abs=1e-6)
