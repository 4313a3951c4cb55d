"""Queries of the training-data operators and their SQL, for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, mixing, rules, secret_scan, sketch, suffixes, warc, windows, wrapper


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(_table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rules.keep_good(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "lang", "source", "n_chars")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(_table(spark, sf_dir, "documents"))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), every=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_bpe_encoding": op3_bpe_encoding,
    "op4_quality_rules": op4_quality_rules,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_mixing_sources": op7_mixing_sources,
    "op8_secret_scans": op8_secret_scans,
    "op9_warc": op9_warc,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}

#: Words as in common.py; sets of three words; pairs of Jaccard similarity 0.5 and equal word sequences, closed transitively.
_NEAR = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
  s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 2], ' ') END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.5 * (x.n + y.n - c)
    UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.ws = y.ws AND x.doc_id <> y.doc_id AND len(x.ws) > 0),
  r(id, other) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other)
  SELECT id AS doc_id, min(other) AS duplicate_of FROM r GROUP BY id HAVING min(other) < id"""

ORACLE_SQL: dict[str, str] = {
    "op5_minhash_near_dedup": _NEAR,
}
