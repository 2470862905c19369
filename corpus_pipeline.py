"""A training corpus from documents: language, near duplicates, benchmark leaks, mixture, token-id files.

Each stage works on all its predecessor kept and returns the columns of documents; the last one returns one row per
written document, read back from the token files. A stage's table is deleted once its successor's is written.

Defined results: a null text or one without letters has no language and goes in the first stage, and so does nothing else
that is null: a null doc_id, source or lang stays, null sources are one source of the mixture. Rows that repeat a doc_id are
told apart by their texts; of rows that repeat both, the second stage keeps one. Very long texts pass whole. An empty table
gives an empty table at every stage. Columns beside those of documents, whatever their names, are kept until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import decontam, langid, mixing, ngram_join, token_files
from verdigris.llm._work import discard, written
from verdigris.llm.queries import tokenizer_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model recognises."""
    return langid.recognised(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked at 0.8 over five-word shingles."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the mixture, from the written files."""
    return token_files.encode_and_read(docs, tokenizer_file())


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

#: A learned model and a tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:  # its files are written and stay for the result
            discard(*spent)
            return found
        docs = written(found, name)
        discard(*spent)
        spent = [docs]
    raise AssertionError("no stages")
