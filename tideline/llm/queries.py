"""The queries of this subpackage by name: each applies an operator with its production parameters to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, codes, counting, decontaminate, lm, ppm, quality, sharding, simhash, sketch, suffix, warc
from .common import table
from .oracles import ORACLES  # noqa: F401  SQL by name of the query


TOKEN_LIMIT = 2048
#: Digits of a distance that are shown; verdicts are made on all of them.
DISTANCE_PLACES = 6


def op1_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    trees = ppm.fit(docs.where(~held_out))
    return ppm.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), trees).drop("text")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode(table(spark, sf_dir, "documents"), tokens, public_tokenizers.PATTERN)
    return bpe.decode(encoded, tokens).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train"))
    return lm.score(docs, "train").withColumn("held_out", ~F.col("train")).drop("train")


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(table(spark, sf_dir, "documents"), length=200, keep=["doc_id"])
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.linked_fingerprints(table(spark, sf_dir, "documents"), size=3, radius=2)
    return linked.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op7_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = counting.load(public_tokenizers.path("word_bpe_49k.json"))
    counted = counting.token_counts(table(spark, sf_dir, "documents"), spec, budget=TOKEN_LIMIT)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs.select("doc_id", "text", "lang"), quality.references(docs))
    return judged.drop("text", "lang").withColumns({c: F.round(c, DISTANCE_PLACES) for c in ("chars_distance", "words_distance")})


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    specified = align.specification(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return align.align(table(spark, sf_dir, "documents"), specified)[0]


def op12_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_fingerprints(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_language_ppm, op2_warc, op3_byte_bpe, op4_elias_fano_lm, op5_suffix_repeats, op6_simhash, op7_prefix_counts, op8_quality_divergence, op9_decontaminate, op10_karmarkar_karp, op11_pair_counts, op12_scaled_sketch, op13_vector_codes)}
