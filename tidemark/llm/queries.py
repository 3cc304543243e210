"""The registered queries of the training-data operators, with their SQL where there is any."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, compression_langid, decontaminate, html_layout, masked_lm, order_minhash, ordinal_toxicity, quality_rules, repeated_bytes, token_attribution
from tidemark.llm import oracles as sql
from tidemark.llm.common import materialize, read

#: The rank file's place is a parameter; the file is read on the driver and sent with the tasks (under 1 MB).
RANKS = "byte_bpe_50k.tiktoken"


def rank_file(name: str = RANKS) -> bytes:
    return Path(public_tokenizers.path(name)).read_bytes()


def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, from grades 0 (clean) to 2."""
    docs = read(spark, sf_dir, "documents")
    model = ordinal_toxicity.fit(docs, read(spark, sf_dir, "labels"), ordinal_toxicity.severity_grade())
    return ordinal_toxicity.predict(docs, model)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict under the certified cutoffs of its language."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = materialize(quality_rules.measure(docs).drop("text"), "quality")
    cutoffs = quality_rules.calibrate(measured, read(spark, sf_dir, "labels"))
    judged = quality_rules.judge(measured, cutoffs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"_q_.{n}").alias(n) for n in names], F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"))


def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_layout.extract(read(spark, sf_dir, "pages"))


def op4_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the two folds that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    fold = compression_langid.fold("doc_id")
    models = compression_langid.fit(docs.where(fold != 1))
    found = compression_langid.predict(docs, models)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document, and whether it stands for the class."""
    found = order_minhash.classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op6_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every section (run of lines of one kind) of every document, by three allocation rules."""
    return token_attribution.attribute(read(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every whole document, as digests."""
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN)


def op8_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document under a window network trained on all of them."""
    return masked_lm.fit_and_score(read(spark, sf_dir, "documents"))


def op9_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window, as counts and digests."""
    return decontaminate.digest(decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a 400-byte string found elsewhere covers, removed."""
    return repeated_bytes.digest(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_ordinal_toxicity": op1_ordinal_toxicity,
        "op2_quality_rules": op2_quality_rules,
        "op3_html_layout": op3_html_layout,
        "op4_compression_langid": op4_compression_langid,
        "op5_order_minhash": op5_order_minhash,
        "op6_token_attribution": op6_token_attribution,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_masked_lm": op8_masked_lm,
        "op9_fm_decontamination": op9_fm_decontamination,
        "op10_suffix_dedup": op10_suffix_dedup,
    }


def oracles() -> dict:
    return {
        "op2_quality_rules": sql.quality(),
        "op9_fm_decontamination": sql.decontamination(),
    }
