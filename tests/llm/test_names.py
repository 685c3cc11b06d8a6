"""Extra columns of any name pass through unchanged, also those that an operator uses itself; nulls and empty tables as well."""

import numpy as np
import pytest

import corpus_pipeline
from tideline.llm import decontaminate, eliasfano, quality, simhash, suffix

NAMES = [
    "spans", "row", "_row", "_body", "body", "runs", "piece", "digest", "kind", "dest", "start", "windows", "parts", "shard", "salt", "a", "b", "n_bytes", "n_removed", "n_spans", "kept",
    "_n", "_same", "same", "nth", "root", "node", "key", "keeper", "keeper_digest", "_keeper", "_digest", "bands", "band", "f0", "f1", "f2", "f3", "size", "low", "high", "places", "shingles", "whole", "total", "n",
    "n_words", "n_hit", "items", "N_HIT", "_words", "_lines", "_classes", "_label", "_h1", "_h8", "_twice", "_sorted", "_at", "_rest_lower", "_n_lower", "_some", "_each", "_hist", "_common", "_class_shares",
    "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_distance", "words_distance", "c0", "c1", "a.b", "with `tick`", "lang", "source", "n_chars",
]
PROSE = "the quick brown fox said that it would rather walk along the river than wait for the boat in the rain because of the old man"
PASSAGE = " ".join(f"shared{i}" for i in range(60))
TEXTS = [
    (1, PROSE + " one way or another " + PASSAGE),
    (2, "different words open this text before it " + PASSAGE + " and others close it after a while as such texts do in life"),
    (3, None),
    (4, ""),
    (5, PROSE + " and that is all that there is to say about it today"),
    (None, PROSE + " and that is all that there is to say about it today"),
    (6, "short"),
    (7, "item words that a test has in it one two three four " + PROSE),
]
BENCH = [("i1", "words that a test has in it one two three four"), ("i2", None)]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string")
    low = [n for n in NAMES if n != "N_HIT"]
    rows = [(*t, *(f"{n} {i}" for n in low)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, frame.schema.simpleString()[7:-1].replace(":", " ") + "".join(f", `{n.replace('`', '``')}` string" for n in low))


def passed(out, docs):
    """By row number the text; all other columns must be as they were."""
    assert out.columns == docs.columns
    rows = [tuple(r) for r in out.collect()]
    for r in rows:
        i = int(r[2].rsplit(" ", 1)[1])
        assert list(r[2:]) == [f"{n} {i}" for n in docs.columns[2:]] and r[0] == TEXTS[i][0]
    return {int(r[2].rsplit(" ", 1)[1]): r[1] for r in rows}


def test_repeats(docs):
    got = passed(suffix.drop_repeats(docs), docs)
    assert set(got) == set(range(8)) and got[2] is None and got[3] == "" and got[6] == "short" and "shared30" not in got[0] + got[1] and got[0].startswith(PROSE[:80])
    both = suffix.remove_repeats(docs)
    new = ["n_bytes", "n_removed", "n_spans", "kept"]
    assert both.columns == [c for c in docs.columns if c not in new] + new
    for r in both.collect():
        i = int(r["row"].rsplit(" ", 1)[1])
        assert r["spans"] == f"spans {i}" and r["_body"] == f"_body {i}" and r["n_bytes"] == len((TEXTS[i][1] or "").encode()) and r["kept"] is not None
    assert suffix.drop_repeats(docs.limit(0)).columns == docs.columns and suffix.drop_repeats(docs.limit(0)).count() == 0


def test_rows_alike_cost_no_square(spark):
    """Many rows with a null key and one text: all is repeated, in short time."""
    text = " ".join(f"w{i}" for i in range(200))
    rows = spark.range(3000).selectExpr("cast(null AS long) AS doc_id", f"'{text}' AS text").union(spark.createDataFrame([(1, "other " + text + " end")], "doc_id long, text string"))
    got = {(r.n_removed, r.n_spans): r["count"] for r in suffix.remove_repeats(rows, keep=[]).groupBy("n_removed", "n_spans").count().collect()}
    assert got == {(len(text), 1): 3001}


def test_near_duplicates(docs):
    got = passed(simhash.drop_near_duplicates(docs), docs)
    # nulls and empty texts are one group, and a null key is the smallest
    assert set(got) == {0, 1, 2, 5, 6, 7} or set(got) == {0, 1, 3, 5, 6, 7}
    assert passed(simhash.drop_near_duplicates(docs.limit(0)), docs) == {}


def test_decontamination(spark, docs):
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    got = passed(decontaminate.decontaminate(docs, bench), docs)
    assert set(got) == set(range(8)) and got[7] == "item  " + PROSE and got[2] is None and got[4] == TEXTS[4][1]
    frame = decontaminate.contamination(docs.drop("spans"), bench)
    assert frame.columns.count("n_words") == 1 and {r.n_hit for r in frame.collect()} == {0, 11}


def test_quality(docs):
    known = [("en", ["the", "of"], [0.2, 0.1, 0.7], [0.7, 0.2, 0.0, 0.1, 0.0, 0.0, 0.0]), (quality.POOLED, ["of"], [0.3, 0.7], [1 / 7] * 7)]
    loose = {"chars": 2.0, "words": 2.0}
    assert set(passed(quality.keep(docs, known, limits=loose), docs)) == {0, 1, 4, 5, 7}
    judged = quality.judge(docs, known, limits=loose)
    assert judged.columns == [c for c in docs.columns if c not in quality.JUDGED] + quality.JUDGED
    for r in judged.collect():
        i = int(r["row"].rsplit(" ", 1)[1])
        assert r["_body"] == f"_body {i}" and r["_words"] == f"_words {i}" and r.kept == (i in {0, 1, 4, 5, 7}) and r.n_words == len((TEXTS[i][1] or "").split())
    assert quality.keep(docs.limit(0), known).count() == 0


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Clashing columns, null ids, null and empty texts, repeated rows, then no rows at all, through all stages."""
    spark.createDataFrame(BENCH, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    fields = "doc_id long, text string, lang string, source string, n_chars int, row string, kept string, spans string, _n string, items string, n_words string"
    rows = [(k, t, "en", "s", len(t or ""), "r", "k", "s", "n", "i", "w") for k, t in [*TEXTS, TEXTS[4], (None, None), (8, "x" * 300_000)]]
    for some in (rows, []):
        docs = spark.createDataFrame(some, fields)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), f"odd{k}")
            assert k == 4 or out.columns == docs.columns
            if k < 4:
                assert all(tuple(r)[5:] == ("r", "k", "s", "n", "i", "w") for r in out.collect())
            docs = out
        assert (docs.count() > 2) == bool(some)


def test_counts_beyond_32_bits():
    words = np.array([5, 9], np.uint64)
    pairs, triples = (np.array([0]), np.array([4], np.uint32)), (np.array([0]), np.array([6], np.uint32))
    trie = eliasfano.Trie.build(words, np.array([2**33 + 7, 3], np.int64), pairs, np.array([-1.0]), np.array([-2.0]), triples, np.array([-0.5]))
    at, n = trie.lookup(np.array([5, 9, 11], np.uint64))
    assert at.tolist() == [0, 1, -1] and n.tolist() == [2**33 + 7, 3, 0]
    pair = trie.pairs.find(at, np.array([4, 4, 4], np.uint32))
    assert pair.tolist() == [0, -1, -1] and trie.triples.find(pair[:1], np.array([6], np.uint32)).tolist() == [0]
