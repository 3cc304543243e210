"""documents in five stages: quality rules, near-duplicates, repeated passages, benchmark text, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontaminate, order_minhash, quality_rules, repeated_bytes
from tidemark.llm.common import materialize, read
from tidemark.llm.queries import rank_file
from tidemark.session import ship_code

#: Bytes from which a repeated string is cut: what 50 words of three letters and their spaces have. And of its grams.
PASSAGE, PASSAGE_GRAM = 200, 64


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs of their language."""
    return quality_rules.keep(docs, read(ship_code(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    ship_code(spark)
    return order_minhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that a PASSAGE-byte string found elsewhere covers."""
    ship_code(spark)
    return _counted(repeated_bytes.cut_text(docs, length=PASSAGE, gram=PASSAGE_GRAM))


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows."""
    return _counted(decontaminate.cut_text(docs, read(ship_code(spark), sf_dir, "benchmark")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of what is left, with digests of ids and decoded bytes."""
    ship_code(spark)
    return byte_bpe.round_trip(docs, rank_file(), public_tokenizers.PATTERN)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return docs.withColumn("n_chars", F.length("text").cast(kind)) if kind else docs


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_text", benchmark_text),
    ("encoding", encoding),
]

#: SQL can't express near-duplicate alignment, suffix sorting or BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
