"""Distances of float arrays, as columns and for NumPy. All arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2_sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def neg_ip(a: Column, b: Column) -> Column:
    """Inner product with its sign turned, so that less is nearer. Never -0.0."""
    return -_sum(a, b, lambda x, y: x * y) + F.lit(0.0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """v with norm 1; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def score(d: Column) -> Column:
    """1 / (1 + d), infinite at d = -1."""
    return F.when(d == -1, F.lit(float("inf"))).otherwise(F.lit(1.0) / F.when(d == -1, F.lit(1.0)).otherwise(F.lit(1.0) + d))


BY_METRIC: dict[str, Callable[[Column, Column], Column]] = {"l2": l2_sq, "ip": neg_ip}


def pairwise(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """All distances of the rows of q and x by one matrix product; rounding may differ from exact()."""
    if metric == "ip":
        return -(q @ x.T) + 0.0
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (q @ x.T), 0)


def exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of corresponding rows."""
    return -(q * x).sum(-1) + 0.0 if metric == "ip" else ((q - x) ** 2).sum(-1)


def random_units(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """(vec_id, embedding): n random unit vectors (test data)."""
    drawn = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.randn(seed + i) for i in range(dim)]).alias("v"))
    return drawn.select("vec_id", normalize(F.col("v")).alias("embedding"))
