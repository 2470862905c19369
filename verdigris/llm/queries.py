"""The registered queries of this subpackage, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import chat, decontam, langid, line_rules, mixing, ngram_join, substring, token_counts, token_files, weak_quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer on this machine; its files are installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.counts(_table(spark, sf_dir, "documents"))


def op2_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(_table(spark, sf_dir, "documents"), tokenizer_file())


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(_table(spark, sf_dir, "documents"))


def op4_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(_table(spark, sf_dir, "documents"))


def op5_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.classify(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.members(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op7_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.by_field(_table(spark, sf_dir, "documents"), tokenizer_file())


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(_table(spark, sf_dir, "conversations"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.digest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pareto_mix": mixing.ORACLE,
        "op3_substring_dedup": substring.ORACLE,
        "op6_ngram_jaccard_join": ngram_join.ORACLE,
        "op8_chat_format": chat.ORACLE,
        "op9_decontamination": decontam.ORACLE,
        "op10_line_rules": line_rules.ORACLE,
    }
