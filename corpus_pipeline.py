"""Corpus pipeline: documents through five training-data operators, one stage after another.

Every stage takes the rows that the one before it kept. Quality rules drop the documents that they reject, near
dedup all but one of each group of copies, the secret scan masks secrets in place, mixing repeats or drops documents
so that sources reach their shares, and encoding turns the texts into tokens.

Defined results: a null text counts as an empty one for the rules; rows with a null doc_id, and texts that are null
or without a word, belong to no group of copies and pass near dedup, where rows of equal doc_id count as one document
and all go or stay; nothing is masked in null or empty texts; mixing gives rows with a null doc_id no copy, so that
they end there, and rows of equal doc_id the same number each; a null source is a source of its own; a null text has
null tokens. Texts of any length go through whole. Ties of copies go to the smallest doc_id. An empty table of
documents gives an empty result, and without labels no document is rejected. Columns that documents have beyond those
five stay as they are up to encoding, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwell.llm import bpe, mixing, rules, secret_scan, sketch
from tarnwell.llm.common import durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule learned from labels rejects go."""
    return rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return sketch.drop_near_duplicates(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text."""
    return secret_scan.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.mixed(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, tokens, exact)."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
    ("bpe_encoding", bpe_encoding),
]

ORACLE_SQL: str | None = None  # learned rules, sketches, a network and random rounding: not expressible


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
