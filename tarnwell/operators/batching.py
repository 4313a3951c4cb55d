"""Request batching: batches by system message, calls with a rate limit, errors apart."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BatchConfig
from ..sources.store import saved


def assign(requests: DataFrame, cfg: BatchConfig = BatchConfig(), group: str = "system_message", order: tuple[str, ...] = ("req_id",)) -> DataFrame:
    """requests with batch_no and pos, from 0, within their group in order of arrival. A null group is one of its own.

    A group may hold all requests, so it isn't numbered in one task: ranges of requests are numbered by themselves, and
    each starts where the earlier ranges with its group end. The ranges are saved, so that both steps see the same.
    """
    part = saved(requests.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    each = part.groupBy(F.col(group).alias("_group"), "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = each.select("_group", F.col("_part").alias("_of"), before.alias("_before"))  # a row for each range and each group's seam
    rows = part.withColumn("_rn", F.row_number().over(Window.partitionBy("_part", group).orderBy(*order)) - 1)
    met = rows.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    rn, size = F.col("_before") + F.col("_rn"), F.lit(cfg.max_batch_size)
    return met.select(*requests.columns, F.floor(rn / size).cast("long").alias("batch_no"), (rn % size).cast("long").alias("pos"))


def stats(assigned: DataFrame, group: str = "system_message") -> DataFrame:
    """(groups, batches, requests, largest) of assign()'s result."""
    each = assigned.groupBy(group, "batch_no").agg(F.count("*").alias("n"))
    return each.agg(F.count_if(F.col("batch_no") == 0).alias("groups"), F.count("*").alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


class TokenBucket:
    """rate tokens a second, burst at most; take() waits for one."""

    def __init__(self, rate: float, burst: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = burst, clock()

    def take(self) -> None:
        while True:
            now = self.clock()
            self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
            if self.tokens >= 1 - 1e-9:
                self.tokens -= 1
                return
            self.sleep((1 - self.tokens) / self.rate)


def complete(requests: DataFrame, llm: Callable[[str, str], str], cfg: BatchConfig = BatchConfig(), limited: bool = True) -> DataFrame:
    """requests with answer and error, one of which is null: a call that fails fails alone.

    The requests are spread over max_concurrent_llm_calls tasks by system message and batch, so that those of a batch
    run one after another on one connection; each task has its share of the rate and of the burst, so that all
    together never exceed either (but a task can always make one call).
    """
    tasks = cfg.max_concurrent_llm_calls
    spread = requests.repartition(tasks, *[c for c in ("system_message", "batch_no") if c in requests.columns])
    schema = T.StructType([*requests.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TokenBucket(cfg.llm_rate_limit / tasks, max(1.0, cfg.llm_rate_burst / tasks))
        for b in batches:
            answers, errors = [], []
            for prompt, system in zip(b.column("prompt").to_pylist(), b.column("system_message").to_pylist(), strict=True):
                if limited:
                    bucket.take()
                try:
                    answers.append(llm(prompt or "", system or ""))
                    errors.append(None)
                except Exception as e:  # of one request only
                    answers.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, "answer", "error"])

    return spread.mapInArrow(run, schema)
