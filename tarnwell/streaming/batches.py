"""Streams: requests in micro-batches to a language model, documents into an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import BatchConfig, ChunkConfig
from ..functions.text import chunks
from ..operators import batching


def serve(requests: DataFrame, sink: str, checkpoint: str, llm: Callable[[str, str], str], cfg: BatchConfig = BatchConfig(), *, once: bool = False, limited: bool = True) -> StreamingQuery:
    """Answers a stream of (req_id, prompt, system_message): every trigger drains what has come, forms batches by
    system message and calls the model. Answers are written by trigger, under its number: one that runs again
    replaces its own, so that each request is answered once."""

    def drain(df: DataFrame, number: int) -> None:
        done = batching.complete(batching.assign(df, cfg), llm, cfg, limited)
        done.write.mode("overwrite").parquet(f"{sink}/trigger={number}")

    writer = requests.writeStream.foreachBatch(drain).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(1, cfg.max_wait_us // 1000)} milliseconds")).start()


def ingest(docs: DataFrame, path: str, checkpoint: str, embed: Callable[[Column], Column], cfg: ChunkConfig = ChunkConfig(), *, once: bool = False) -> StreamingQuery:
    """Appends the chunks of a stream of (doc_id, text), with their vectors, to a table; readers see whole commits."""
    rows = chunks(docs, cfg).withColumn("chunk_id", F.xxhash64("doc_id", "chunk_idx")).withColumn("embedding", embed(F.col("text")))
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
