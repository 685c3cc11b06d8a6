import hashlib
import random
import re

from tideline.llm import decontaminate as d
from tideline.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = WORD.findall(low(t))
        if w:
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(w) for w in wins}
    out = {}
    for key, t in docs:
        w = WORD.findall(low(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= got
        out[key] = (len(w), len(hit), sorted(map(str, found - {None})))
    return out


def test_random_texts_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "b", "Cé", "d9", "e"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([3, 4, 6, 12, 20]))) for i in range(25)] + [(90, "zz"), (91, ""), (92, None), (93, "zz"), (None, text(6))]
    docs = [(i, text(rng.randrange(0, 300))) for i in range(120)] + [(500, None), (501, ""), (502, "ZZ zz-q"), (503, "Ü" * 9)]
    got = d.contamination(spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, spans string"), spark.createDataFrame(items, "item_id long, text string"), window=6).collect()
    want = brute(docs, items, 6)
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["n_hit"], [str(i) for i in r["items"]]) == want[r["doc_id"]]


def test_several_automata_agree_with_one(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    docs = spark.createDataFrame([(i, text(200)) for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(i, text(8)) for i in range(30)], "item_id long, text string")
    one = sorted(d.contamination(docs, items, 5).collect())
    monkeypatch.setattr(d, "PIECE_BYTES", 100)
    many = sorted(d.contamination(docs, items, 5).collect())
    assert [(r.doc_id, r.n_words, r.n_hit, r.items) for r in one] == [(r.doc_id, r.n_words, r.n_hit, r.items) for r in many]


def test_decontaminate_cuts_spans_and_keeps_the_rest(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Clean é start. {item.upper()}! And an end with some more clean words here"), (2, "nothing to see"), (3, None), (4, item), (5, "")]
    got = d.decontaminate(spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, source string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    rows = {r.doc_id: r for r in got.collect()}
    assert got.columns == ["doc_id", "text", "source"] and set(rows) == {1, 2, 3, 5}
    assert rows[1].text == "Clean é start. ! And an end with some more clean words here" and rows[3].text is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(none, items).count() == 0
    assert d.contamination(spark.createDataFrame([(1, "a b")], none.schema), items).first().n_hit == 0


def test_op9_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    read = lambda n, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select(*c).collect()]
    want = brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    got = queries.op9_decontaminate(spark, sf).collect()
    assert len(got) == len(want) and sum(r.contaminated for r in got) > 5
    for r in got:
        n, hit, ids = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(ids), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
