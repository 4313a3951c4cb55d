"""Exact nearest neighbours: the top-k similarity join, pairs, and the neighbour graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as D


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column without nulls as rows; ValueError if their lengths differ."""
    n = pc.min_max(pc.list_value_length(column)).as_py() if len(column) else {"min": 0, "max": 0}
    if n["min"] != n["max"] or (len(column) and not n["min"]):
        raise ValueError(f"vectors of {n['min']} and {n['max']} dimensions")
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def usable(vector: str) -> Column:
    """Whether a vector can be compared: not null, and without elements that are null or no number. Others are left out of searches."""
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x)), F.lit(False))


def check_dim(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """df; a vector of another length is an error when it is read."""
    ok = F.assert_true(F.size(vector) == dim, F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vector).cast("string")))
    return df.withColumn(vector, F.when(ok.isNull(), F.col(vector)))


#: Rows of a matrix; queries that are compared with a matrix at once; pairs whose exact distances are computed at once; matrices of queries whose neighbours a task holds.
ROWS, STEP, SLICE, HELD = 2048, 512, 1 << 16, 8


def blocks(df: DataFrame, key: str, vector: str, by: str | None = None, rows: int = ROWS) -> DataFrame:
    """Rows packed into matrices: (ids, data, by), one row for each `rows` rows or less of a partition and value of by. No shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column(2).dictionary_encode()
            for k, value in enumerate(of.dictionary):
                own = b.filter(pc.equal(of.indices, k)) if len(of.dictionary) > 1 else b
                for s in range(0, own.num_rows, rows):
                    part = own.slice(s, rows)
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([_matrix(part.column(1)).tobytes()], pa.binary()), pa.array([value.as_py()], pa.string())], names=["ids", "data", "by"])

    whole = F.col(by).cast("string") if by else F.lit("")
    some = df.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), whole.alias("by"))
    return some.where("by IS NOT NULL").mapInArrow(pack, "ids array<long>, data binary, by string")


def meet(q: DataFrame, v: DataFrame, queries: int, vectors: int) -> DataFrame:
    """All pairs of a matrix of q and one of v; of which there are so many rows. Few queries go to all vectors. Else a
    task has some matrices of either side, a bounded number whatever the tables' sizes, and meets those of q one after
    another with its own of v."""
    if queries <= 4 * ROWS:
        return v.crossJoin(F.broadcast(q))
    return q.repartition(-(-queries // (4 * ROWS))).crossJoin(v.repartition(max(1, -(-vectors // (32 * ROWS)))))


def _sides(queries: DataFrame, vectors: DataFrame, key: str, vector: str, qkey: str, qvector: str, by: str | None = None) -> DataFrame:
    q = blocks(queries, qkey, qvector, by).withColumnsRenamed({"ids": "qids", "data": "qdata"}).withColumn("block", F.monotonically_increasing_id())
    v = blocks(vectors, key, vector, by)
    return q.join(v, "by").drop("by") if by else meet(q.drop("by"), v.drop("by"), queries.count(), vectors.count())


def row_ids(b: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return np.asarray(b.column(name)[i].values)


def row_matrix(b: pa.RecordBatch, name: str, i: int, n: int) -> np.ndarray:
    return np.frombuffer(b.column(name)[i].as_buffer()).reshape(n, -1)


class Near:
    """What of many matrices of vectors is near the queries of one matrix.

    A product of matrices in single precision leaves out what can't be near, with a margin for all its rounding
    errors; for the rest distances are exact. probes: which cells each query reads; bound: a distance for each query
    within which its k nearest surely are.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, metric: str, k: int = 0, *, skip_self: bool = False, probes: np.ndarray | None = None, bound: np.ndarray | None = None) -> None:
        self.ids, self.q, self.metric, self.k, self.skip_self, self.probes = np.array(ids), np.array(q), metric, k, skip_self, probes
        self.bound = np.full(len(q), np.inf) if bound is None else np.array(bound)
        self.sq = (self.q * self.q).sum(1)
        self.d, self.at = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        self.factors: dict[type, np.ndarray] = {}

    def _factor(self, kind: type) -> np.ndarray:
        """The queries; for distances with a column for the vectors' norms."""
        if kind not in self.factors:
            self.factors[kind] = np.concatenate([self.q, np.ones((len(self.q), 1))], 1).astype(kind) if self.metric == "l2" else self.q.astype(kind)
        return self.factors[kind]

    def _limit(self, r: np.ndarray) -> np.ndarray:
        return np.minimum(self.d[r, -1], self.bound[r]) if self.k else self.bound[r]

    def pairs(self, ids: np.ndarray, x: np.ndarray, cells: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of the queries, rows of x, exact distances) of all pairs within the limit of their query; those beyond may be among them."""
        if self.q.shape[1] != x.shape[1]:
            raise ValueError(f"vectors of {self.q.shape[1]} and {x.shape[1]} dimensions")
        rows = np.arange(len(self.q)) if cells is None else np.flatnonzero(self.probes[:, np.unique(cells)].any(1))
        high = np.abs(x).max(initial=0), np.abs(self.q).max(initial=0)
        kind = np.float32 if 1e-15 < high[0] < 1e15 and high[1] < 1e15 else np.float64
        factor: dict[type, np.ndarray] = {}
        sq = (x * x).sum(1)
        for s in range(0, len(rows), STEP):
            r = rows[s : s + STEP]
            i, j = self._candidates(r, ids, x, sq, cells, kind, factor)
            if kind is np.float32 and len(i) > len(r) * len(x) // 16:
                i, j = self._candidates(r, ids, x, sq, cells, np.float64, factor)
            for a in range(0, len(i), SLICE):
                ri, rj = r[i[a : a + SLICE]], j[a : a + SLICE]
                if cells is not None:
                    own = self.probes[ri, cells[rj]]
                    ri, rj = ri[own], rj[own]
                if self.skip_self:
                    own = self.ids[ri] != ids[rj]
                    ri, rj = ri[own], rj[own]
                d = D.exact(self.q[ri], x[rj], self.metric)
                own = np.isfinite(d)
                yield ri[own], rj[own], d[own]

    def _candidates(self, r: np.ndarray, ids: np.ndarray, x: np.ndarray, sq: np.ndarray, cells: np.ndarray | None, kind: type, factor: dict[type, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if kind not in factor:
            factor[kind] = np.ascontiguousarray((np.concatenate([x, sq[:, None] / -2], 1) if self.metric == "l2" else x).astype(kind).T)
        with np.errstate(all="ignore"):
            g = self._factor(kind)[r] @ factor[kind]  # the more, the nearer
            margin = 4 * (x.shape[1] + 8) * float(np.finfo(kind).eps) * (self.sq[r] + sq.max(initial=0))
            limit = self._limit(r)
            least = (self.sq[r] - limit - margin) / 2 if self.metric == "l2" else -limit - margin
            if (free := ~np.isfinite(limit)).any():  # as far as there are less than k so far
                h, m = g[free], g.shape[1]
                if self.skip_self:
                    h[self.ids[r[free], None] == ids] = -np.inf
                if cells is not None:
                    h[~self.probes[r[free]][:, cells]] = -np.inf
                h[np.isnan(h)] = -np.inf
                if self.k and self.k < m:
                    least[free] = np.partition(h, m - self.k, axis=1)[:, m - self.k] - 2 * margin[free]
                else:
                    least[free] = -np.inf
                g[free] = h
            least = np.maximum(least, float(np.finfo(kind).min)).astype(kind)
            at = np.flatnonzero(g >= least[:, None])
        return at // g.shape[1], at % g.shape[1]

    def meet(self, ids: np.ndarray, x: np.ndarray, cells: np.ndarray | None = None) -> None:
        """Takes in vectors; the k nearest so far stay, ties by id."""
        for i, j, d in self.pairs(ids, x, cells):
            own = d <= self.d[i, -1]
            if own.any():
                self._add(i[own], ids[j[own]], d[own])

    def _add(self, i: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        rows = np.unique(i)
        row, at, d = np.concatenate([np.repeat(rows, self.k), i]), np.concatenate([self.at[rows].ravel(), ids]), np.concatenate([self.d[rows].ravel(), d])
        o = np.lexsort((at, d, row))
        row, at, d = row[o], at[o], d[o]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        own = place < self.k
        self.d[row[own], place[own]], self.at[row[own], place[own]] = d[own], at[own]

    def found(self) -> pa.RecordBatch:
        i, j = np.nonzero(np.isfinite(self.d))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(self.at[i, j]), pa.array(self.d[i, j])], names=["query_id", "id", "distance"])


def nearest(met: DataFrame, k: int, metric: str, *, skip_self: bool = False) -> DataFrame:
    """top_k() of pairs of matrices (block, qids, qdata, ids, data), with probes and cells if there are cells, and with bound where queries have one. Of each matrix of queries
    a task gives what is nearest among all of its own vectors."""
    probed, bounded = "probes" in met.columns, "bound" in met.columns

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Near] = {}
        for b in batches:
            for i, block in enumerate(b.column("block").to_pylist()):
                if block not in held:
                    if len(held) == HELD:
                        yield held.pop(next(iter(held))).found()
                    qids = row_ids(b, "qids", i)
                    probes = np.unpackbits(np.frombuffer(b.column("probes")[i].as_buffer(), np.uint8).reshape(len(qids), -1), axis=1).astype(bool) if probed else None
                    held[block] = Near(qids, row_matrix(b, "qdata", i, len(qids)), metric, k, skip_self=skip_self, probes=probes, bound=np.asarray(b.column("bound")[i].values) if bounded else None)
                ids = row_ids(b, "ids", i)
                held[block].meet(ids, row_matrix(b, "data", i, len(ids)), row_ids(b, "cells", i) if probed else None)
        for near in held.values():
            yield near.found()

    near = met.mapInArrow(best, "query_id long, id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance", D.score(F.col("distance")).alias("score"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", *, key: str = "vec_id", vector: str = "embedding", qkey: str = "query_id", qvector: str = "embedding", skip_self: bool = False, by: str | None = None) -> DataFrame:
    """(query_id, rank, id, distance, score): the k nearest vectors of every query, ties by id; with by, among those
    of the same value in that column of both sides. Rows with a null id or without a usable() vector are left out;
    vectors of different lengths are an error.

    Matrices of queries meet matrices of vectors; a task keeps the k best of each query, and a window keeps those of
    all tasks.
    """
    return nearest(_sides(queries, vectors, key, vector, qkey, qvector, by), k, metric, skip_self=skip_self)


def pairs(queries: DataFrame, vectors: DataFrame, metric: str, *, key: str = "vec_id", vector: str = "embedding", qkey: str = "query_id", qvector: str = "embedding", most: float | None = None) -> DataFrame:
    """(query_id, id, distance) of all pairs; with most, of those whose distance is no more, others don't leave the product of matrices."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qids, ids = row_ids(b, "qids", i), row_ids(b, "ids", i)
                q, x = row_matrix(b, "qdata", i, len(qids)), row_matrix(b, "data", i, len(ids))
                if q.shape[1] != x.shape[1]:
                    raise ValueError(f"vectors of {q.shape[1]} and {x.shape[1]} dimensions")
                if most is not None:
                    for r, j, d in Near(qids, q, metric, bound=np.full(len(q), most)).pairs(ids, x):
                        own = d <= most
                        if own.any():
                            yield pa.RecordBatch.from_arrays([pa.array(qids[r[own]]), pa.array(ids[j[own]]), pa.array(d[own])], names=["query_id", "id", "distance"])
                    continue
                for s in range(len(qids)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), qids[s])), pa.array(ids), pa.array(D.exact(q[s][None], x, metric))], names=["query_id", "id", "distance"])

    return _sides(queries, vectors, key, vector, qkey, qvector).mapInArrow(every, "query_id long, id long, distance double")


def graph(vectors: DataFrame, m: int, metric: str = "l2", *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(src, rank, dst, distance): edges to the m nearest others, by comparing all pairs; ivf.graph() compares those of near cells."""
    near = top_k(vectors, vectors, m, metric, key=key, vector=vector, qkey=key, qvector=vector, skip_self=True)
    return near.selectExpr("query_id AS src", "rank", "id AS dst", "distance")


def heuristic_graph(vectors: DataFrame, m: int, candidates: int, metric: str = "l2", *, key: str = "vec_id", vector: str = "embedding", near: DataFrame | None = None) -> DataFrame:
    """(src, rank, dst, distance): diverse edges.

    From the nearest on, a candidate stays if no chosen one is nearer to it than the source is; what is left over
    fills up to m. The order matters, so each source's candidates go through one function. near: edges like those of
    graph() or ivf.graph() to choose from; None: the nearest of all pairs.
    """
    near = graph(vectors, candidates, metric, key=key, vector=vector) if near is None else near
    near = near.select(F.col("src").alias("query_id"), "rank", F.col("dst").alias("id"), "distance")
    with_vectors = near.join(vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")), "id")
    lists = with_vectors.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "distance", "v"))).alias("c"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                count, c = part.column("c").value_lengths().to_numpy(zero_copy_only=False), part.column("c").flatten()
                at = np.repeat(np.cumsum(count) - count, count)
                row, place = np.repeat(np.arange(len(count)), count), np.arange(len(c)) - at
                v, own = _matrix(c.field("v")), c.field("distance").to_numpy(zero_copy_only=False)
                x, d = np.zeros((len(count), max(count, default=0), v.shape[1])), np.full((len(count), max(count, default=0)), np.inf)
                x[row, place], d[row, place] = v, own
                chosen = diverse_rows(x, d, count, m, metric)
                src, rank = np.nonzero(chosen >= 0)
                i = pa.array((np.cumsum(count) - count)[src] + chosen[src, rank])
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(src)), pa.array(rank + 1, pa.int32()), c.field("id").take(i), c.field("distance").take(i)], names=["src", "rank", "dst", "distance"])

    return lists.mapInArrow(choose, "src long, rank int, dst long, distance double")


def diverse(x: np.ndarray, d: np.ndarray, m: int, metric: str) -> list[int]:
    """Which of the candidates x, sorted by their distance d, the heuristic chooses."""
    chosen: list[int] = []
    rest: list[int] = []
    for i in range(len(x)):
        if len(chosen) == m:
            break
        (rest if chosen and (D.exact(x[i][None], x[chosen], metric) < d[i]).any() else chosen).append(i)
    return chosen + rest[: m - len(chosen)]


def diverse_rows(x: np.ndarray, d: np.ndarray, count: np.ndarray, m: int, metric: str) -> np.ndarray:
    """diverse() of many sources at once: row r of x has count[r] candidates, and row r of the result what is chosen of them, then -1."""
    n, most = d.shape
    chosen, size = np.full((n, m), -1), np.zeros(n, int)
    near = np.zeros((n, most), bool)  # nearer to a chosen one than the source is
    left = np.zeros((n, most), bool)
    for i in range(most):
        open_ = (i < count) & (size < m)
        left[:, i] = open_ & near[:, i]
        r = np.flatnonzero(open_ & ~near[:, i])
        if len(r):
            chosen[r, size[r]] = i
            size[r] += 1
            near[r, i + 1 :] |= D.exact(x[r, i + 1 :], x[r, i : i + 1], metric) < d[r, i + 1 :]
    for i in range(most):
        r = np.flatnonzero(left[:, i] & (size < m))
        chosen[r, size[r]] = i
        size[r] += 1
    return chosen


def reverse_connect(edges: DataFrame, m_max: int) -> DataFrame:
    """Edges with their reverse, the m_max nearest of each source."""
    both = edges.select("src", "dst", "distance").unionByName(edges.selectExpr("dst AS src", "src AS dst", "distance")).distinct()
    w = Window.partitionBy("src").orderBy("distance", "dst")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m_max).select("src", "rank", "dst", "distance")


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """(recall, queries): share of the true neighbours that were found, over all queries."""
    hits = true.select("query_id", "id").join(found.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("h"))
    each = true.groupBy("query_id").agg(F.count("*").alias("k")).join(hits, "query_id", "left")
    return each.agg(F.avg(F.coalesce("h", F.lit(0)) / F.col("k")).alias("recall"), F.count("*").alias("queries"))
