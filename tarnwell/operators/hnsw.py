"""Layered proximity graphs: one for each shard, built and searched in the shard's task, results merged.

A shard's graph is small enough for one task; more data means more shards, not a larger graph. Graphs are built once
and stand in a table, a row each: build() makes it, store.saved() or a write keeps it, add() extends it by shards of
new vectors, and find() searches it without building anything. Search goes to all shards, so its recall is at least
that of one graph of the same beam. complete() misses nothing: one graph tells each query how far its nearest are at
most, and matrices of all shards' vectors are compared within that distance.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions import distance as D
from ..sources.store import saved
from . import knn
from .knn import blocks, diverse, usable


def level(key: Column | str, m: int, seed: int = 42) -> Column:
    """Level of a node, at most 15; P(level >= l) = m ** -l. From a hash, so that it is the same each time."""
    if m < 2:
        raise ValueError("m must be at least 2")
    digest = F.md5(F.concat((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.least(F.floor(-F.log(u) / F.lit(float(np.log(m)))), F.lit(15)).cast("tinyint")


class Graph:
    """One shard's graph. Positions are rows of x."""

    def __init__(self, cfg: IndexConfig) -> None:
        self.cfg, self.n = cfg, 0
        self.x = np.zeros((64, cfg.dim))
        self.ids: list[int] = []
        self.layers: list[dict[int, list[int]]] = []
        self.entry = -1
        self.rng = np.random.default_rng(cfg.seed)

    def __len__(self) -> int:
        return self.n

    def _to(self, q: np.ndarray, rows: list[int]) -> np.ndarray:
        return D.exact(q[None], self.x[rows], self.cfg.metric)

    def _descend(self, q: np.ndarray, at: int, layer: int) -> int:
        best = self._to(q, [at])[0]
        while True:
            near = self.layers[layer].get(at, [])
            if not near:
                return at
            d = self._to(q, near)
            i = int(d.argmin())
            if d[i] >= best:
                return at
            at, best = near[i], d[i]

    def _beam(self, q: np.ndarray, at: int, ef: int, layer: int) -> list[tuple[float, int]]:
        """Best first; ends when the nearest open node is farther than the worst of ef results."""
        d0 = float(self._to(q, [at])[0])
        seen, todo, out = {at}, [(d0, at)], [(-d0, at)]
        while todo:
            d, node = heapq.heappop(todo)
            if len(out) >= ef and d > -out[0][0]:
                break
            new = [v for v in self.layers[layer].get(node, ()) if v not in seen]
            if new:
                seen.update(new)
                for dv, v in zip(self._to(q, new).tolist(), new, strict=True):
                    if len(out) < ef or dv < -out[0][0]:
                        heapq.heappush(todo, (dv, v))
                        heapq.heappush(out, (-dv, v))
                        if len(out) > ef:
                            heapq.heappop(out)
        return sorted((-d, v) for d, v in out)

    def insert(self, key: int, v: np.ndarray, top: int | None = None) -> None:
        """Adds a vector on the levels up to top (None: at random); equal keys are both kept."""
        if len(v) != self.cfg.dim:
            raise ValueError(f"expected {self.cfg.dim} dimensions, got {len(v)}")
        if self.n == len(self.x):
            self.x = np.concatenate([self.x, np.zeros_like(self.x)])
        at, self.n = self.n, self.n + 1
        self.x[at] = v
        self.ids.append(key)
        top = min(int(-np.log(1 - self.rng.random()) / np.log(self.cfg.m)), 15) if top is None else top
        start, high = self.entry, len(self.layers) - 1
        while len(self.layers) <= top:
            self.layers.append({})
        for layer in range(top + 1):
            self.layers[layer][at] = []
        if start < 0:
            self.entry = at
            return
        for layer in range(high, top, -1):
            start = self._descend(v, start, layer)
        for layer in range(min(top, high), -1, -1):
            most = self.cfg.m_max0 if layer == 0 else self.cfg.m
            near = self._beam(v, start, self.cfg.ef_construct, layer)
            rows = [r for _, r in near]
            chosen = diverse(self.x[rows], np.array([d for d, _ in near]), most, self.cfg.metric)
            for i in chosen:
                d, r = near[i]
                self.layers[layer][at].append(r)
                back = self.layers[layer][r]
                if len(back) < most:
                    back.append(at)
                else:
                    far = self._to(self.x[r], back)
                    w = int(far.argmax())
                    if d < far[w]:
                        back[w] = at
            start = near[0][1]
        if top > high:
            self.entry = at

    def search(self, q: np.ndarray, k: int, ef: int = 0) -> list[tuple[float, int]]:
        """(distance, key) of about the k nearest, in order; ef = 0: the index's."""
        if self.entry < 0:
            return []
        at = self.entry
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self._descend(q, at, layer)
        near = self._beam(q, at, max(ef or self.cfg.ef_search, k), 0)
        return sorted((d, self.ids[r]) for d, r in near)[:k]


    def to_bytes(self) -> bytes:
        """The whole graph, for from_bytes()."""
        parts = {"x": self.x[: self.n], "ids": np.array(self.ids, np.int64), "entry": np.array([self.entry])}
        for i, layer in enumerate(self.layers):
            parts[f"nodes{i}"] = np.fromiter(layer, np.int32, len(layer))
            parts[f"counts{i}"] = np.fromiter(map(len, layer.values()), np.int32, len(layer))
            parts[f"to{i}"] = np.fromiter((r for near in layer.values() for r in near), np.int32)
        out = io.BytesIO()
        np.savez(out, **parts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, cfg: IndexConfig) -> Graph:
        parts = np.load(io.BytesIO(data))
        g = cls(cfg)
        g.x, g.ids, g.n, g.entry = parts["x"], parts["ids"].tolist(), len(parts["ids"]), int(parts["entry"][0])
        while f"nodes{len(g.layers)}" in parts:
            i = len(g.layers)
            ends, to = np.cumsum(parts[f"counts{i}"]).tolist(), parts[f"to{i}"].tolist()
            g.layers.append({n: to[a:b] for n, a, b in zip(parts[f"nodes{i}"].tolist(), [0, *ends], ends, strict=False)})
        return g


def build(vectors: DataFrame, cfg: IndexConfig, *, per_shard: int = 20_000, first: int = 0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(shard, n, graph): a graph for each `per_shard` vectors or less on average, numbered from first. Rows with a null id or without a usable vector are left out."""
    some = vectors.where(F.col(key).isNotNull() & usable(vector))
    shards = max(1, -(-some.count() // per_shard))
    own = some.select((F.pmod(F.xxhash64(key), F.lit(shards)) + first).alias("shard"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), level(F.col(key), cfg.m, cfg.seed).alias("top"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g = Graph(cfg)
        for i, v, top in rows.sort_values("id")[["id", "v", "top"]].itertuples(index=False):
            g.insert(int(i), np.asarray(v, float), int(top))
        return pd.DataFrame({"shard": [key[0]], "n": [len(g)], "graph": [g.to_bytes()]})

    return own.groupBy("shard").applyInPandas(run, "shard long, n long, graph binary")


def add(index: DataFrame, vectors: DataFrame, cfg: IndexConfig, **options) -> DataFrame:
    """The index with shards of further vectors; those it has stay as they are."""
    last = index.agg(F.max("shard")).first()[0]
    return index.unionByName(build(vectors, cfg, first=0 if last is None else last + 1, **options))


def find(queries: DataFrame, index: DataFrame, k: int, cfg: IndexConfig, *, ef: int = 0, qkey: str = "query_id", qvector: str = "embedding", block: int = 2048) -> DataFrame:
    """(query_id, rank, id, distance, score) by the graphs of build()'s table. Queries travel as matrices of at most `block`; a vector of another length than the index's is an error."""
    asked = blocks(queries, qkey, qvector, rows=block).select("ids", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, g = None, None
        for b in batches:
            for i in range(b.num_rows):
                if b.column("shard")[i].as_py() != shard:
                    shard, g = b.column("shard")[i].as_py(), Graph.from_bytes(b.column("graph")[i].as_py(), cfg)
                ids = b.column("ids")[i].as_py()
                q = np.frombuffer(b.column("data")[i].as_py()).reshape(len(ids), -1)
                if q.shape[1] != cfg.dim:
                    raise ValueError(f"expected {cfg.dim} dimensions, got {q.shape[1]}")
                rows = [(n, key, d) for n, v in zip(ids, q, strict=True) for d, key in g.search(v, k, ef)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["query_id", "id", "distance"])

    near = index.select("shard", "graph").crossJoin(asked).mapInArrow(run, "query_id long, id long, distance double")  # every query asks every shard
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance", D.score(F.col("distance")).alias("score"))


def complete(queries: DataFrame, index: DataFrame, k: int, cfg: IndexConfig, *, qkey: str = "query_id", qvector: str = "embedding") -> DataFrame:
    """find() without its misses: (query_id, rank, id, distance, score) of the k nearest of all vectors in build()'s table, ties by id.

    Each matrix of queries goes to one shard's graph, where a small beam finds k vectors: the farthest is a bound of
    the query's. All shards' vectors then meet the queries as matrices, and what is beyond the bound is left out.
    """
    of = [r.shard for r in index.select("shard").collect()]  # a number for each shard

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, g = None, Graph(cfg)
        for b in batches:
            for i in range(b.num_rows):
                if b.column("shard")[i].as_py() != shard:
                    shard, g = b.column("shard")[i].as_py(), Graph.from_bytes(b.column("graph")[i].as_py(), cfg)
                ids = knn.row_ids(b, "ids", i)
                q = knn.row_matrix(b, "data", i, len(ids))
                if q.shape[1] != cfg.dim:
                    raise ValueError(f"expected {cfg.dim} dimensions, got {q.shape[1]}")
                near = [g.search(v, k, k) for v in q]
                bound = [x[-1][0] if len(x) == k else np.inf for x in near]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in ("block", "ids", "data")), pa.array([bound], pa.list_(pa.float64()))], names=["block", "qids", "qdata", "bound"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for graph in b.column("graph"):
                with np.load(io.BytesIO(graph.as_py())) as parts:
                    ids, x = parts["ids"], parts["x"]
                for s in range(0, len(ids), knn.ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[s : s + knn.ROWS]], pa.list_(pa.int64())), pa.array([x[s : s + knn.ROWS].tobytes()], pa.binary())], names=["ids", "data"])

    asked = blocks(queries, qkey, qvector).select("ids", "data").withColumn("block", F.monotonically_increasing_id())
    one = F.element_at(F.array(*map(F.lit, of)) if of else F.array().cast("array<bigint>"), F.pmod(F.xxhash64("ids"), F.lit(max(1, len(of)))).cast("int") + 1)
    bounded = asked.withColumn("shard", one).join(index.select("shard", "graph"), "shard").mapInArrow(bounds, "block long, qids array<long>, qdata binary, bound array<double>")
    vectors = index.select("graph").mapInArrow(unpack, "ids array<long>, data binary")
    return knn.nearest(knn.meet(bounded, vectors, queries.count(), index.agg(F.sum("n")).first()[0] or 0), k, cfg.metric)


def search(queries: DataFrame, vectors: DataFrame, k: int, cfg: IndexConfig, *, per_shard: int = 20_000, ef: int = 0, key: str = "vec_id", vector: str = "embedding", qkey: str = "query_id", qvector: str = "embedding") -> DataFrame:
    """find() on an index that is built, and saved, for it."""
    return find(queries, saved(build(vectors, cfg, per_shard=per_shard, key=key, vector=vector)), k, cfg, ef=ef, qkey=qkey, qvector=qvector)
