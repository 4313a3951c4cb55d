"""Roll-ups of a log of stages: counters, averages, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import saved


def rollup(log: DataFrame, stage: str, micros: str) -> DataFrame:
    """(stage, n, total_us, avg_us): whole averages; 0 where there is nothing."""
    n, total = F.count("*"), F.coalesce(F.sum(micros), F.lit(0)).cast("long")
    return log.groupBy(F.col(stage).alias("stage")).agg(n.alias("n"), total.alias("total_us")).withColumn("avg_us", F.expr("CASE WHEN n = 0 THEN 0 ELSE total_us DIV n END"))


def mixed_averages(searches: Column | str, queries: Column | str, search_us: Column | str, embed_us: Column | str) -> tuple[Column, Column, Column, Column]:
    """(avg_search_us, avg_embed_us, avg_search_us_ref, avg_embed_us_ref): true averages over all calls, and those of
    a server that counts only plain retrievals but adds up the time of both, and embeds only of full queries."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    s, q, t, e = c(searches), c(queries), c(search_us), c(embed_us)
    div = lambda a, b: F.when(b > 0, F.floor(a / b)).otherwise(F.lit(0)).cast("long")
    return div(t, s + q), div(e, s + q), div(t, s), div(e, q)


def latency(log: DataFrame, value: str, concurrent: int = 1) -> DataFrame:
    """(n, mean, median, p99, qps). p99 is the sorted values' element int(n * 0.99); qps is n over the summed time by lane."""
    v = F.col(value)
    ordered = log.where(v.isNotNull()).select(v.alias("v"))
    agg = ordered.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.sum("v").alias("total"))
    # the element of one place, without collecting the column: counts by value, summed up in order
    by = saved(ordered.groupBy("v").agg(F.count("*").alias("c")).repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    part = by.groupBy("part").agg(F.sum("c").alias("pc"))
    before = part.withColumn("before", F.coalesce(F.sum("pc").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    up_to = by.join(F.broadcast(before), "part").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("v")))
    p99 = up_to.crossJoin(F.broadcast(agg.select(F.col("n").alias("total_n")))).where("upto > CAST(total_n * 0.99 AS BIGINT)").agg(F.min("v").alias("p99"))
    return agg.crossJoin(p99).select("n", "mean", "median", "p99", (F.col("n") / (F.col("total") / F.lit(concurrent))).alias("qps"))
