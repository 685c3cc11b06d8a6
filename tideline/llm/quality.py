"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of common words are compared with those of its language by Jensen-Shannon
distance; texts too short for a histogram are not judged by it. A few plain counts, with rules of their own, stand beside them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, numbered

SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Classes of characters, each counted among what the ones before it left; the last class is the rest (letters beyond ASCII above all).
CLASSES = {"lower": "[a-z]+", "space": r"[\x20\x09-\x0D]+", "upper": "[A-Z]+", "stop": r"[.,;:!?'\"()-]+", "digit": "[0-9]+", "symbol": r"[\x00-\x7F]+"}
#: Common words of a language. A text's weight in its language's references, in whole numbers: two thousand million texts fit a long.
COMMON_WORDS, UNIT = 24, 1 << 32
#: Parts in which a label's words are ranked.
TOP_PARTS = 64
#: Words in a window that is looked for a second time.
WINDOW = 8
#: Distances (0 to 1) beyond which a document goes, and the words from which each histogram counts.
LIMITS = {"chars": 0.34, "words": 0.42}
LEAST_WORDS = {"chars": 30, "words": 100}
#: The base rules.
BASE_WORDS, BASE_REPEATED = 20, 0.30
POOLED = "\x00all"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE + "+")).otherwise(F.array().cast("array<string>"))


def _classes(docs: DataFrame, text: str) -> DataFrame:
    """docs with an array of counts by class in the column classes: each step counts on what is left by the one before."""
    rest, counts = text, []
    for name, pattern in CLASSES.items():
        docs = docs.withColumn(f"_rest_{name}", F.regexp_replace(rest, pattern, "")).withColumn(f"_n_{name}", F.length(rest) - F.length(f"_rest_{name}"))
        rest = f"_rest_{name}"
        counts.append(F.col(f"_n_{name}"))
    out = docs.withColumn("_classes", F.array(*counts, F.length(rest)).cast("array<double>"))
    return out.drop(*(f"_{a}_{name}" for a in ("rest", "n") for name in CLASSES))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: 0.5 * (part(a, (a + b) / 2) + part(b, (a + b) / 2)))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))


def _repeated(docs: DataFrame, window: int) -> DataFrame:
    """docs with n_repeat_words: words in windows that occur twice or more in the text. A window is a 64-bit hash of its words' hashes.

    Texts without an equal pair, nearly all, stop at a set of their windows; only the others sort them.
    """
    docs = docs.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    size, last, steps = 1, "_h1", []
    while size < window:  # a window of 2n words from two of n
        new = f"_h{2 * size}"
        n = F.size(last) - size
        docs = docs.withColumn(new, F.when(n > 0, F.zip_with(F.slice(last, F.lit(1), n), F.slice(last, F.lit(size + 1), n), lambda a, b: F.xxhash64(a, b))))
        steps.append(last)
        size, last = 2 * size, new
    docs = docs.drop(*steps).withColumn("_twice", F.size(last) > F.size(F.array_distinct(last)))
    docs = docs.withColumn("_sorted", F.when(F.col("_twice"), F.array_sort(F.transform(last, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n = F.size("_sorted")
    same = F.zip_with(F.slice("_sorted", F.lit(1), n - 1), F.slice("_sorted", F.lit(2), n - 1), lambda a, b: a["h"] == b["h"])
    docs = docs.withColumn("_same", F.when(F.col("_twice"), same))
    no = F.array(F.lit(False))
    marks = F.zip_with(F.zip_with(F.concat(no, "_same"), F.concat("_same", no), lambda a, b: a | b), "_sorted", lambda a, x: F.when(a, x["i"]))
    docs = docs.withColumn("_at", F.when(F.col("_twice"), F.array_sort(F.filter(marks, lambda x: x.isNotNull()))))
    # each window adds the words up to the next one, the last all of its own
    far = F.array(F.element_at("_at", -1) + F.lit(window))
    gaps = F.zip_with("_at", F.concat(F.slice("_at", F.lit(2), F.size("_at") - 1), far), lambda a, b: F.least(F.lit(window), b - a))
    covered = F.when(F.col("_twice"), F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x))
    return docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_twice", "_sorted", "_same", "_at", last)


def counts(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and _words and _classes for what follows. A null text has none of them."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("_body", body).withColumn("_words", _words(F.col("_body")))
    docs = docs.withColumn("_lines", F.filter(F.split("_body", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0))
    docs = docs.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_body", F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_lines")
    return _repeated(_classes(docs, "_body").drop("_body"), window)


def references(docs: DataFrame, label: str = "lang", text: str = "text", common: int = COMMON_WORDS) -> list[tuple]:
    """(label, words, shares of the words and of all others, shares of the character classes) for each label, and pooled ones.

    From all texts with a label. Each text adds its shares, so a long one weighs no more than a short one; the pooled ones have the labels as the texts do. No labels: an empty list.
    """
    base = docs.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(label).cast("string").alias("label"), F.col(text).alias("_body"))
    whole = lambda share: (share * F.lit(float(UNIT)) + 0.5).cast("long")  # noqa: E731  sums of whole numbers are the same in any order
    width = len(CLASSES) + 1
    shares = _classes(base, "_body").select("label", _shares(F.col("_classes")).alias("_shares"))
    classes = {r[0]: list(r[1:]) for r in shares.groupBy("label").agg(*(F.sum(whole(F.col("_shares")[i])) for i in range(width))).collect()}
    if not classes:
        return []
    # a text's share once, before its words part; words in lower case each by itself, since most are ASCII and most texts are not
    split = base.select("label", _words(F.col("_body")).alias("_words")).withColumn("share", whole(1 / F.size("_words")))
    each = split.select("label", F.explode("_words").alias("word"), "share").withColumn("word", F.lower("word"))
    # one row for each word of a label: read three times, and one pass over the whole table is enough
    words = materialise(each.groupBy("label", "word").agg(F.sum("share").alias("share")), "references")
    words = words.unionByName(words.groupBy("word").agg(F.sum("share").alias("share")).withColumn("label", F.lit(POOLED)))
    classes[POOLED] = [sum(x) for x in zip(*classes.values(), strict=True)]
    total_of = {r[0]: r[1] for r in words.groupBy("label").agg(F.sum("share")).collect()}
    # the most common of each part of a label's words, then of these: no label's words meet in one task
    w = Window.partitionBy("label", F.pmod(F.xxhash64("word"), F.lit(TOP_PARTS))).orderBy(F.desc("share"), "word")
    top = words.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= common).collect()
    found = []
    for name in sorted(classes):
        mine = sorted((r for r in top if r["label"] == name), key=lambda r: (-r["share"], r["word"]))[:common]
        shares = [r["share"] / total_of[name] for r in mine]
        total = sum(classes[name])
        found.append((name, [r["word"] for r in mine], [*shares, max(0.0, 1 - sum(shares))], [c / total for c in classes[name]]))
    return found


JUDGED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_distance", "words_distance", "kept"]


def judge(docs: DataFrame, known: list[tuple], label: str = "lang", text: str = "text", limits: dict = LIMITS, least: dict = LEAST_WORDS, window: int = WINDOW) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, chars_distance, words_distance and kept.

    A text fails the base rules with fewer than 20 words (so a null or empty one does) or more than 30 % of its words in repeated windows. The
    others are kept unless a distance exceeds its limit; a text with fewer words than the least has none (null) and is kept.
    A missing or unknown label is held against the references of all labels together; without references nothing is. Rows are judged each by itself;
    columns of these names are replaced, columns of any other name stay as they are. An empty table gives an empty result.
    """
    frame, at = numbered(docs, without=JUDGED)
    return _judged(frame, known, at.get(label), at[text], limits, least, window).toDF(*at, *JUDGED)


def keep(docs: DataFrame, known: list[tuple], label: str = "lang", text: str = "text", **how) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs, whatever their names."""
    frame, at = numbered(docs)
    rules = {"limits": LIMITS, "least": LEAST_WORDS, "window": WINDOW} | how
    return _judged(frame, known, at.get(label), at[text], **rules).where("kept").select(*frame.columns).toDF(*docs.columns)


def _judged(frame: DataFrame, known: list[tuple], label: str | None, text: str, limits: dict, least: dict, window: int) -> DataFrame:
    """frame, whose columns are c0, c1, .., with the columns of JUDGED."""
    out = counts(frame, text, window)
    out = out.withColumn("base_failed", (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > 100 * BASE_REPEATED * F.col("n_words")))
    if known:
        spark = frame.sparkSession
        names = [k[0] for k in known]
        # a row for each language, a few hundred bytes each
        refs = F.broadcast(spark.createDataFrame(known, "_label string, _common array<string>, _word_shares array<double>, _class_shares array<double>"))
        all_words = sorted({w for k in known for w in k[1]})
        named = F.col(label).cast("string") if label else F.lit(None).cast("string")
        out = out.withColumn("_label", F.when(named.isin(names), named).otherwise(F.lit(POOLED))).join(refs, "_label", "left")
        some = F.filter("_words", lambda x: F.lower(x).isin(all_words))
        out = out.withColumn("_some", F.when(F.col("n_words") >= least["words"], F.transform(some, lambda x: F.lower(x))))
        # the words' counts among the few that any language has as common
        each = F.transform("_common", lambda c: F.size(F.filter("_some", lambda x: x == c)).cast("double"))
        out = out.withColumn("_each", F.when(F.col("_some").isNotNull(), each))
        rest = F.col("n_words") - F.aggregate("_each", F.lit(0.0), lambda s, x: s + x)
        out = out.withColumn("_hist", F.concat("_each", F.array(rest)))
        out = out.withColumn("chars_distance", F.when(F.col("n_words") >= least["chars"], _distance(_shares(F.col("_classes")), F.col("_class_shares"))))
        out = out.withColumn("words_distance", F.when(F.col("_hist").isNotNull(), _distance(_shares(F.col("_hist")), F.col("_word_shares"))))
    else:
        out = out.withColumns({"chars_distance": F.lit(None).cast("double"), "words_distance": F.lit(None).cast("double")})
    far = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"{k}_distance") > F.lit(float(limits[k])), F.lit(False)) for k in ("chars", "words")))
    # an id is never negative; it keeps a filter on the verdict above this projection, where each step is computed once. Pushed down,
    # the filter would repeat the whole chain of expressions inside itself
    once = F.monotonically_increasing_id() >= 0
    return out.withColumn("kept", ~F.col("base_failed") & ~far & once).select(*frame.columns, *JUDGED)
