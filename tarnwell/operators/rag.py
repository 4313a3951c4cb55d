"""Retrieval and generation over chunk tables: embed, search, rerank, augment, generate."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..functions.text import fill_template, general, keyword_hits
from ..sources.store import saved
from . import knn

Embed = Callable[[Column], Column]


def candidates(queries: DataFrame, chunks: DataFrame, embed: Embed, cfg: PipelineConfig, metric: str = "l2") -> DataFrame:
    """(query_id, query, rank, id, distance, score, text): the top_k chunks of every query.

    queries: (query_id, query); chunks: (chunk_id, text, embedding). A result without a chunk has the text ''.
    """
    asked = queries.where("query <> ''").withColumn("embedding", embed(F.col("query")))
    return _texts(knn.top_k(asked, chunks.select("chunk_id", "embedding"), cfg.top_k, metric, key="chunk_id"), queries, chunks)


def _texts(near: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with the texts of their chunks and queries."""
    texts = chunks.select(F.col("chunk_id").alias("id"), "text")
    found = near.join(texts, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return found.join(queries.select("query_id", "query"), "query_id").select("query_id", "query", "rank", "id", "distance", "score", "text")


def rerank(found: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """The top_n of each query. With enable_rerank, and more candidates than top_n, the score is 0.7 of the old one
    plus 0.3 for each keyword hit; else the order stays."""
    w = Window.partitionBy("query_id")
    if cfg.enable_rerank:
        blended = 0.7 * F.col("score") + 0.3 * keyword_hits(F.col("query"), F.col("text"))
        found = found.withColumn("_n", F.count("*").over(w)).withColumn("score", F.when(F.col("_n") > cfg.top_n, blended).otherwise(F.col("score")))
        order = [F.when(F.col("_n") > cfg.top_n, -F.col("score")).otherwise(F.lit(0.0)), F.col("rank")]
        found = found.withColumn("rank", F.row_number().over(w.orderBy(*order))).drop("_n")
    return found.where(F.col("rank") <= cfg.top_n)


def retrieve(queries: DataFrame, chunks: DataFrame, embed: Embed, cfg: PipelineConfig = PipelineConfig(), metric: str = "l2") -> DataFrame:
    """(query_id, query, rank, id, distance, score, text) of the top_n of every query."""
    return rerank(candidates(queries, chunks, embed, cfg, metric), cfg)


def augment(queries: DataFrame, results: DataFrame, cfg: PipelineConfig = PipelineConfig()) -> DataFrame:
    """(query_id, query, sources, prompt) of every query, also of one without results."""
    listed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "distance", "score", "text"))).alias("sources"))
    df = queries.select("query_id", "query").join(listed, "query_id", "left")
    lines = F.transform(F.coalesce("sources", F.array()), lambda s: F.concat(F.lit("["), s["rank"].cast("string"), F.lit("] "), s["text"], F.lit("\n\n")))
    context = F.array_join(lines, "")
    if cfg.max_context_tokens is not None:
        context = F.substring(context, 1, 4 * cfg.max_context_tokens)
    return df.withColumn("prompt", fill_template(cfg.prompt_template, context, F.col("query")))


def query(queries: DataFrame, chunks: DataFrame, embed: Embed, generate: Callable[[Column], Column], cfg: PipelineConfig = PipelineConfig(), metric: str = "l2") -> DataFrame:
    """(query_id, query, sources, prompt, answer): generate is called for every query, also without sources."""
    return augment(queries, retrieve(queries, chunks, embed, cfg, metric), cfg).withColumn("answer", generate(F.col("prompt")))


def timed_query(queries: DataFrame, chunks: DataFrame, embed: Embed, generate: Callable[[Column], Column] | None = None, cfg: PipelineConfig = PipelineConfig(), metric: str = "l2") -> tuple[DataFrame, DataFrame]:
    """(result, timings): query()'s result, or retrieve()'s without generate, and how long its stages took.

    Timings are one row in microseconds for the whole batch: embed_us, search_us, generate_us, total_us, overhead_us
    (the rest: reranking and prompts), queries. To be timed, each stage is saved before the next begins.
    """
    spark, marks = queries.sparkSession, [time.perf_counter()]

    def stage(df: DataFrame) -> DataFrame:
        df = saved(df)
        marks.append(time.perf_counter())
        return df

    asked = stage(queries.where("query <> ''").withColumn("embedding", embed(F.col("query"))))
    near = stage(_texts(knn.top_k(asked, chunks.select("chunk_id", "embedding"), cfg.top_k, metric, key="chunk_id"), queries, chunks))
    out = stage(rerank(near, cfg) if generate is None else augment(queries, rerank(near, cfg), cfg))
    if generate is not None:
        out = stage(out.withColumn("answer", generate(F.col("prompt"))))
    took = [int(1e6 * (b - a)) for a, b in zip(marks, marks[1:], strict=False)]
    made, total = took[3] if generate is not None else 0, int(1e6 * (marks[-1] - marks[0]))
    row = (took[0], took[1], made, total, total - took[0] - took[1] - made, queries.count())
    return out, spark.createDataFrame([row], "embed_us long, search_us long, generate_us long, total_us long, overhead_us long, queries long")


def tool_output(queries: DataFrame, results: DataFrame, top_k: int = 5) -> DataFrame:
    """(query_id, output): what an agent's search tool shows of the first top_k results; scores with six significant digits."""
    of = results.where(F.col("rank") <= top_k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "text"))).alias("r"))
    df = queries.select("query_id").join(of, "query_id", "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<rank:int,score:double,text:string>>")))
    part = F.transform("r", lambda s: F.concat(F.lit("--- Result "), s["rank"].cast("string"), F.lit(" (score: "), general(s["score"]), F.lit(") ---\n"), s["text"], F.lit("\n\n")))
    return df.select("query_id", F.concat(F.lit("Found "), F.size("r").cast("string"), F.lit(" relevant passages:\n\n"), F.array_join(part, "")).alias("output"))


def response(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, body): the results of every query as JSON, {"results": [{id, score, distance, text}]}."""
    of = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "distance", "text"))).alias("r"))
    df = queries.select("query_id").join(of, "query_id", "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<rank:int,id:bigint,score:double,distance:double,text:string>>")))
    return df.select("query_id", F.to_json(F.struct(F.transform("r", lambda s: s.dropFields("rank")).alias("results"))).alias("body"))


def as_json(df: DataFrame) -> DataFrame:
    """(body): each row as a JSON object of its columns, as a server answers with counts, health or metrics."""
    return df.select(F.to_json(F.struct("*")).alias("body"))


def failure(message: str) -> str:
    """The body of an answer to a request that can't be served."""
    return json.dumps({"error": message}, separators=(",", ":"))


def search_tool(chunks: DataFrame, embed: Embed, cfg: PipelineConfig = PipelineConfig(), metric: str = "l2") -> Callable[..., str]:
    """A function (query, top_k=5) for an agent: the text of tool_output(); ValueError for an empty query."""
    spark = chunks.sparkSession

    def search(query: str, top_k: int = 5) -> str:
        if not query:
            raise ValueError("the query is missing")
        asked = spark.createDataFrame([(0, query)], "query_id long, query string")
        return tool_output(asked, retrieve(asked, chunks, embed, cfg, metric), top_k).first().output

    return search
