"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be copied w * total / size(source) times on average, so that in expectation source s
fills w of the output's characters. The whole part is given to each document; the fractions are rounded by the
pivotal method: two documents with fractions meet, and mass moves at random from one to the other until one of them
is 0 or 1. Each document's expectation stays what it was, and the number of copies of a source ends within one
of its expectation. Partitions round their own documents in parallel and leave at most one fraction for each source;
those residuals meet in a reduction tree of groups of `fan_in`, level by level, and the last is rounded by itself.

All choices come from hashes of the ids and the seed, over sorted rows: a task that runs again repeats them.

Defined results: rows of equal doc_id are one document (of the smallest source, with their lengths added) with one
number of copies; rows with a null doc_id get none; a null source is a source of its own; null and empty texts have
no characters, but are copied with their source; texts of any length count whole; sources without any characters
get no copies; documents of equal length are told apart by their ids; an empty table gives an empty result; other
columns are not looked at, and mixed() leaves them as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class MixConfig:
    """weights: target share by source (others get none); None: shares in proportion to size ** exponent. total: characters of the output as a multiple of the input's."""

    weights: dict[str | None, float] | None = None
    exponent: float = 0.7
    total: float = 1.0
    fan_in: int = 64
    seed: int = 17


def _uniform(a: int, b: int, seed: int) -> float:
    x = np.array([a & (2**64 - 1), b & (2**64 - 1)], np.uint64)
    with np.errstate(over="ignore"):
        x = C.mix(x + np.uint64(seed))
        return float(C.mix(x[:1] * np.uint64(3) + x[1:])[0] >> np.uint64(11)) / 2.0**53


def uniforms(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each document."""
    return (C.mix(C.mix(ids.view(np.uint64)) + np.uint64(seed)) >> np.uint64(11)).astype(np.float64) / 2.0**53


def pivotal(p: np.ndarray, u: np.ndarray, eps: float = 1e-9) -> tuple[np.ndarray, int]:
    """Rounds the fractions p in their order with the uniform numbers u; (values, position of the one fraction left or -1)."""
    out, at = p.astype(float), -1
    for i in range(len(p)):
        b = out[i]
        if b <= eps or b >= 1 - eps:
            out[i] = round(b)
            continue
        if at < 0:
            at = i
            continue
        a = out[at]
        s = a + b
        if s < 1:
            first = u[i] * s < a  # the mass goes to the one or to the other
            out[at], out[i] = (s, 0.0) if first else (0.0, s)
            at = at if first else i
        else:
            first = u[i] * (2 - s) < 1 - b  # the one becomes 1, the other keeps the rest
            out[at], out[i] = (1.0, s - 1) if first else (s - 1, 1.0)
            at = i if first else at
        if out[at] <= eps or out[at] >= 1 - eps:
            out[at] = round(out[at])
            at = -1
    return out, at


_ROUNDED = "doc_id long, source string, chars long, base long, p double, copies long"


def _round(cfg: MixConfig, level: int, last: bool):
    """mapInArrow: rows sorted by group (g); copies of what is decided, null and p of what isn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # the fraction that a group's rows so far leave

        def emit(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("chars", pa.int64()), ("base", pa.int64()), ("p", pa.float64()), ("copies", pa.int64())]))

        def close(row: dict) -> dict:
            up = last and _uniform(row["doc_id"], level, cfg.seed) < row["p"]
            return row | {"copies": row["base"] + int(up) if last else None}

        g = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            group = np.asarray(b.column("g").to_pylist(), object)
            ids, p = C.ids_of(b.column("doc_id")), np.asarray(b.column("p").to_numpy(zero_copy_only=False), float)
            base, u = C.ids_of(b.column("base")), uniforms(ids, cfg.seed + 1000 * level)
            cut = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [n]])
            copies, open_, extra = base.copy(), np.zeros(n, bool), []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if held is not None and group[s] != g:
                    extra.append(close(held))
                    held = None
                g = group[s]
                first = [held["p"]] if held is not None else []
                q, at = pivotal(np.concatenate([first, p[s:e]]), np.concatenate([[0.0] * len(first), u[s:e]]))
                k = len(first)
                copies[s:e] = base[s:e] + np.rint(q[k:]).astype(np.int64)
                if k and at != 0:
                    extra.append(held | {"copies": held["base"] + round(q[0])})
                    held = None
                elif k:
                    held = held | {"p": float(q[0])}
                if at >= k:
                    i = s + at - k
                    open_[i] = True
                    held = {"doc_id": int(ids[i]), "source": b.column("source")[i].as_py(), "chars": b.column("chars")[i].as_py(), "base": int(base[i]), "p": float(q[at]), "copies": None}
            keep = pa.array(~open_)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("chars"), b.column("base"), b.column("p"), pa.array(copies)], names=["doc_id", "source", "chars", "base", "p", "copies"]).filter(keep)
            if extra:
                yield emit(extra)
        if held is not None:
            yield emit([close(held)])

    return run


def mix(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """(doc_id, source, chars, copies) of every document."""
    spark = docs.sparkSession
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "source", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars"))
    units = C.durable(rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("chars").alias("chars")), "units")
    sizes = units.groupBy("source").agg(F.sum("chars").alias("size"))
    if cfg.weights is None:
        weighted = sizes.withColumn("w", F.pow("size", F.lit(cfg.exponent)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in cfg.weights.items()] or [(None, 0.0)], "ws string, w double")
        weighted = sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("ws")), "left").select("source", "size", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = weighted.agg(F.sum("size").alias("all_size"), F.sum("w").alias("all_w"))
    rates = weighted.crossJoin(sums).select(F.col("source").alias("rs"), F.when((F.col("size") > 0) & (F.col("all_w") > 0), F.col("w") / F.col("all_w") * F.col("all_size") * cfg.total / F.col("size")).otherwise(0.0).alias("rate"))
    rates = C.durable(rates, "rates")  # a row for each source
    few = rates.count() <= 100_000
    start = units.join(F.broadcast(rates) if few else rates, F.col("source").eqNullSafe(F.col("rs")))
    start = start.select("doc_id", "source", "chars", F.floor("rate").alias("base"), (F.col("rate") - F.floor("rate")).alias("p"))
    order = F.xxhash64("doc_id", F.lit(cfg.seed))
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    level = start.withColumn("g", name).withColumn("o", order).sortWithinPartitions("g", "o", "doc_id").drop("o").mapInArrow(_round(cfg, 0, False), _ROUNDED)
    done, depth = [], 0
    while True:
        level = C.durable(level, f"rounded{depth}")
        done.append(level.where("copies IS NOT NULL"))
        left = level.where("copies IS NULL")
        most = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if not most:
            break
        depth += 1
        groups, last = -(-most // cfg.fan_in), most <= cfg.fan_in
        keyed = left.withColumn("g", F.concat(name, F.lit("/"), F.pmod(F.xxhash64("doc_id", F.lit(depth)), F.lit(groups)).cast("string"))).withColumn("o", order)
        level = keyed.repartition("g").sortWithinPartitions("g", "o", "doc_id").drop("o").mapInArrow(_round(cfg, depth, last), _ROUNDED)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "chars", "copies")


def mixed(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """docs with each row as often as mix() says; all columns as they were."""
    copies = mix(docs, cfg).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("copies").alias("_n"))
    met = docs.join(C.growing(copies), docs["doc_id"] == copies["_id"])
    k = C.fresh(docs, "_k")
    return met.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), copies["_n"])).alias(k)).drop(k)
