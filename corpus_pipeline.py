"""A corpus from raw documents: STAGES in order, each written as Parquet and read again by the next.

Quality rules drop documents, near-duplicates leave one of each group, repeated passages and benchmark passages are cut out of the texts, and what
is left is encoded. Every stage works on all that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, decontaminate, quality, simhash, suffix
from tideline.llm.common import materialise, table


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars as the text is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; those with a null or empty text go, since they have no words. Columns stay, whatever their names; rows are judged each by itself."""
    return quality.keep(docs, quality.references(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id, a null one first. Texts without words are one group; repeated rows leave one."""
    return simhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the strings of 200 bytes that stand in two places; all copies go. A null text stays null, n_chars follows the text."""
    return _sized(suffix.drop_repeats(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages of benchmark; those covered beyond 80 % go whole. A null text stays null, n_chars follows the text."""
    return _sized(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and the number of bytes that the ids decode to. A null text has no tokens; each row stands for itself."""
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = bpe.decode(bpe.encode(docs, tokens, public_tokenizers.PATTERN), tokens)
    return decoded.select("doc_id", "n_tokens", "ids", F.octet_length("decoded").cast("long").alias("n_bytes"))


STAGES = [("quality rules", quality_rules), ("SimHash near-duplicates", near_duplicates), ("suffix-array repeats", repeated_passages), ("benchmark decontamination", benchmark_passages), ("byte-level BPE", encoded)]

#: SQL has no SimHash, suffix array or tokenizer: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
