"""Ingestion: JSON bodies, documents, directories; chunk ids and counts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions.text import chunks as cut
from .store import saved

VECTORS_BODY = "vectors array<struct<id: bigint, data: array<float>>>"
DOCUMENTS_BODY = "documents array<struct<id: string, text: string>>, chunk_size int, chunk_overlap int"


def raw_vectors(bodies: DataFrame, dim: int, body: str = "body") -> DataFrame:
    """(id, embedding) of JSON bodies. A vector of another length is an error before anything is written."""
    rows = bodies.select(F.from_json(body, VECTORS_BODY, {"mode": "FAILFAST"}).alias("b")).select(F.inline(F.coalesce("b.vectors", F.array().cast("array<struct<id: bigint, data: array<float>>>"))))
    ok = F.assert_true(F.size("data") == dim, F.concat(F.lit(f"expected {dim} dimensions, vector "), F.col("id").cast("string")))
    return rows.select("id", F.when(ok.isNull(), F.col("data")).alias("embedding"))


def json_documents(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(doc_id, text, chunk_size, chunk_overlap) of JSON bodies; the sizes are those of the body, null where it has none."""
    empty = F.array().cast("array<struct<id: string, text: string>>")
    b = bodies.select(F.from_json(body, DOCUMENTS_BODY, {"mode": "FAILFAST"}).alias("b"))
    rows = b.select(F.inline(F.coalesce("b.documents", empty)), F.col("b.chunk_size").alias("chunk_size"), F.col("b.chunk_overlap").alias("chunk_overlap"))
    return rows.select(F.col("id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "chunk_size", "chunk_overlap")


def single(spark: SparkSession, doc_id: str | int, text: str) -> DataFrame:
    """(doc_id, text): one document, to go the way of many. An empty text has no chunks, but counts as a document."""
    return spark.createDataFrame([(doc_id, text)], f"doc_id {'long' if isinstance(doc_id, int) else 'string'}, text string")


def index(docs: DataFrame, path: str, embed: Callable[[Column], Column], cfg: ChunkConfig = ChunkConfig(), key: str = "doc_id", start: int = 0) -> DataFrame:
    """Appends the chunks of documents, with their vectors, to the table at path; (documents_indexed, chunks_created, vectors_inserted, time_ms)."""
    began = time.perf_counter()
    done = chunk_table(docs, embed, cfg, key, start)
    done.write.mode("append").parquet(path)
    n = counts(docs, done).first()
    row = (n["documents_indexed"], n["chunks_created"], n["vectors_inserted"], 1000 * (time.perf_counter() - began))
    return docs.sparkSession.createDataFrame([row], "documents_indexed long, chunks_created long, vectors_inserted long, time_ms double")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): every file of a folder is a document, its path the id."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def numbered(chunks: DataFrame, key: str = "doc_id", start: int = 0) -> DataFrame:
    """chunks with chunk_id, from `start` on in order of document and chunk.

    Numbers come from two small sums, over documents in ranges and within a document: no global sort in one task. The
    ranges are saved, so that both sums see the same ones.
    """
    per = saved(chunks.groupBy(key).agg(F.count("*").alias("_n")).repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    part = per.groupBy("_p").agg(F.sum("_n").alias("_pn"))
    part = part.select("_p", F.coalesce(F.sum("_pn").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    first = per.join(F.broadcast(part), "_p").select(key, (F.col("_b") + F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.lit(start)).alias("_first"))
    return chunks.join(first, key).withColumn("chunk_id", F.col("_first") + F.col("chunk_idx")).drop("_first")


def chunk_table(docs: DataFrame, embed: Callable[[Column], Column] | None = None, cfg: ChunkConfig = ChunkConfig(), key: str = "doc_id", start: int = 0) -> DataFrame:
    """(chunk_id, doc_id, chunk_idx, text[, embedding]) of documents, as a saved table: texts are cut and embedded once."""
    out = numbered(saved(cut(docs, cfg, key)), key, start).select("chunk_id", key, "chunk_idx", "text")
    return saved(out.withColumn("embedding", embed(F.col("text"))) if embed else out)


def counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(documents_indexed, chunks_created, vectors_inserted); documents without text count as well."""
    return docs.agg(F.count("*").alias("documents_indexed")).crossJoin(chunks.agg(F.count("*").alias("chunks_created"), F.count("*").alias("vectors_inserted")))


#: Scheme, host, port with its colon, path; the whole string must match.
URL = r"(https?)://([^:/]+)(:[0-9]+)?(/[\s\S]*)?"


def parse_base_url(url: Column) -> Column:
    """struct(scheme, host, port, path) of a base URL: default ports, one slash less at the end; null if it is none."""
    part = lambda i: F.regexp_extract(url, rf"\A{URL}\z", i)
    given = F.substring(part(3), 2, 99)
    port = F.when(given != "", F.expr("null").cast("int")).when(part(1) == "https", 443).otherwise(80)
    port = F.when(F.length(given).between(1, 9), given.try_cast("int")).otherwise(port)
    parts = F.struct(part(1).alias("scheme"), part(2).alias("host"), port.alias("port"), F.regexp_replace(part(4), r"/\z", "").alias("path"))
    return F.when(url.rlike(rf"\A{URL}\z"), parts)
