"""Approximate search by cells: k-means cells are a partition column, and a query reads the nprobe nearest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from . import knn
from .knn import _matrix


@dataclass(frozen=True)
class Cells:
    """Centres of the cells."""

    centres: np.ndarray

    @classmethod
    def fit(cls, vectors: DataFrame, cells: int | None = None, *, vector: str = "embedding", seed: int = 42, sample: int = 50_000, rounds: int = 15) -> Cells:
        """By k-means on at most `sample` vectors, taken by a hash: of bounded size, so that the driver does it at once.
        cells: None for the square root of the number of vectors, and no more than one for 8 of the sample."""
        some = vectors.where(knn.usable(vector)).select(F.col(vector).cast("array<double>").alias("v"))
        if cells is None:
            n = some.count()
            cells = max(1, min(int(n**0.5), min(n, sample) // 8))
        x = _matrix(some.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(sample).toArrow()["v"].combine_chunks())
        if not len(x):
            raise ValueError("there are no vectors to fit cells on")
        rng = np.random.default_rng(seed)
        c = [x[rng.integers(len(x))]]
        near = D.pairwise(x, c[0][None], "l2")[:, 0]
        while len(c) < cells and near.sum() > 1e-12:  # k-means++
            c.append(x[rng.choice(len(x), p=near / near.sum())])
            near = np.minimum(near, D.pairwise(x, c[-1][None], "l2")[:, 0])
        centres = np.array(c)
        for _ in range(rounds):
            at = cls(centres).nearest(x)
            centres = np.array([x[at == i].mean(0) if (at == i).any() else centres[i] for i in range(len(centres))])
        return cls(centres)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The nearest cell of each row."""
        return np.concatenate([D.pairwise(x[s : s + knn.ROWS], self.centres, "l2").argmin(1) for s in range(0, len(x), knn.ROWS)] or [np.zeros(0, int)])

    def probed(self, x: np.ndarray, n: int) -> np.ndarray:
        """Whether a cell is among the n nearest of each row; of equally near ones the first are."""
        if n >= len(self.centres):
            return np.ones((len(x), len(self.centres)), bool)
        d = D.pairwise(x, self.centres, "l2")
        out = d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n]
        for i in np.flatnonzero(out.sum(1) != n):
            out[i] = False
            out[i, np.argsort(d[i], kind="stable")[:n]] = True
        return out

    def assign(self, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
        """vectors with the column cell; null for a vector that isn't usable."""
        centres = self.centres

        @F.arrow_udf("int")
        def nearest(v: pa.Array) -> pa.Array:
            there = np.asarray(v.is_valid())
            out = np.zeros(len(v), np.int32)
            if there.any():
                x = _matrix(v.filter(pa.array(there)))
                if x.shape[1] != centres.shape[1]:
                    raise ValueError(f"vectors of {x.shape[1]} and {centres.shape[1]} dimensions")
                out[there] = self.nearest(x)
            return pa.array(out, mask=~there)

        return vectors.withColumn("cell", nearest(F.when(knn.usable(vector), F.col(vector).cast("array<double>"))))

    def table(self, spark) -> DataFrame:
        """(cell, centre), to be saved with an index."""
        return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centres)], "cell int, centre array<double>")

    @classmethod
    def of(cls, table: DataFrame) -> Cells:
        """The cells of table()."""
        rows = table.orderBy("cell").toArrow()
        return cls(_matrix(rows["centre"].combine_chunks()))


def search(queries: DataFrame, indexed: DataFrame, cells: Cells, k: int, nprobe: int, metric: str = "l2", *, key: str = "vec_id", vector: str = "embedding", qkey: str = "query_id", qvector: str = "embedding", skip_self: bool = False) -> DataFrame:
    """(query_id, rank, id, distance, score): the k nearest in the nprobe nearest cells. indexed has the column cell.

    Queries and vectors are packed into matrices of a bounded size, with the cells that each query reads and that each
    vector is in; a query goes once to the matrices that have a cell of its own, however many it reads. The cells read
    with a larger nprobe include those of a smaller one, so that more probes never lose a result. Rows with a null id
    or without a usable vector are left out.
    """
    centres, n = cells.centres, min(nprobe, len(cells.centres))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                if x.shape[1] != centres.shape[1]:
                    raise ValueError(f"vectors of {x.shape[1]} and {centres.shape[1]} dimensions")
                order = np.argsort(cells.nearest(x), kind="stable")  # those that read the same cells side by side
                ids = b.column("id").to_numpy(zero_copy_only=False)
                for s in range(0, len(x), knn.ROWS):
                    own = order[s : s + knn.ROWS]
                    probes = cells.probed(x[own], n)
                    cols = [pa.array([ids[own]], pa.list_(pa.int64())), pa.array([x[own].tobytes()], pa.binary()), pa.array([np.packbits(probes, axis=1).tobytes()], pa.binary()), pa.array([np.flatnonzero(probes.any(0))], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["qids", "qdata", "probes", "asked"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, knn.ROWS):
                part = b.slice(s, knn.ROWS)
                at = part.column("cell").to_numpy(zero_copy_only=False)
                cols = [pa.array([part.column("id").to_numpy(zero_copy_only=False)], pa.list_(pa.int64())), pa.array([_matrix(part.column("v")).tobytes()], pa.binary()), pa.array([at], pa.list_(pa.int32())), pa.array([np.unique(at)], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["ids", "data", "cells", "there"])

    some = queries.where(F.col(qkey).isNotNull() & knn.usable(qvector)).select(F.col(qkey).cast("long").alias("id"), F.col(qvector).cast("array<double>").alias("v"))
    q = some.mapInArrow(ask, "qids array<long>, qdata binary, probes binary, asked array<int>").withColumn("block", F.monotonically_increasing_id())
    own = indexed.where(F.col("cell").isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col("cell").cast("int").alias("cell"))
    v = own.repartition("cell").sortWithinPartitions("cell").mapInArrow(pack, "ids array<long>, data binary, cells array<int>, there array<int>")
    met = knn.meet(q, v, queries.count(), indexed.count())
    return knn.nearest(met if n == len(centres) else met.where(F.arrays_overlap("asked", "there")), k, metric, skip_self=skip_self)


def graph(vectors: DataFrame, m: int, cells: Cells, nprobe: int, metric: str = "l2", *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(src, rank, dst, distance): edges to the m nearest others in the nprobe nearest cells; knn.heuristic_graph() and knn.reverse_connect() take them."""
    near = search(vectors, cells.assign(vectors, vector), cells, m, nprobe, metric, key=key, vector=vector, qkey=key, qvector=vector, skip_self=True)
    return near.selectExpr("query_id AS src", "rank", "id AS dst", "distance")
