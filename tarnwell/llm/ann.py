"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample: k-means with `branch` centres, again within each part, until a leaf stands
for about `leaf` vectors of the whole table, or for `per_leaf` of the sample. Every vector of the table goes down to
the leaf of nearest centres. A query keeps a priority queue of branches by the distance of their centres, opens the
best one next, and so visits leaves from the most to the least promising. How many it visits is calibrated on the
whole table: the true neighbours of some trial queries are found by one pass over all vectors, and the visits widen
until the wanted recall is reached on them. A query goes on beyond that number while its leaves hold fewer than k + 1
vectors. Leaves that follow each other in the tree make cells of a bounded number of vectors; a query travels once to
each cell that has leaves of its, meets the vectors of just those leaves there and keeps its k best. Of equal vectors
those of the k + 1 smallest ids are placed: no other copy can be among any query's k nearest.

The centres, the places of the leaves and the trial queries are sent to all tasks; the sample bounds them
(`sample_bytes` / `per_leaf` for the centres). Where the table asks for more leaves than that, leaves grow instead,
and are met in blocks of at most `block` vectors and `queries` queries.

Defined results: queries are the rows whose id is divisible by `every`. Rows with a null id or vector, with nulls or
NaN in it or another length than most are left out, as query and as neighbour; rows of equal id are one vector (the
smallest); a vector is no neighbour of itself, but its exact copies under other ids are, at distance 0; ties go to
the smaller id; with fewer than k others all are returned; vectors of any length are compared whole; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class AnnConfig:
    """sample_bytes: vectors that the tree is fitted on, at most; leaf: vectors of the table by leaf; per_leaf: vectors of the sample by leaf, at least; trial: queries of the calibration; recall: what they must reach; block, queries: vectors and queries that meet at once."""

    k: int = 10
    branch: int = 8
    leaf: int = 32
    per_leaf: int = 8
    sample_bytes: int = 64 << 20
    trial: int = 256
    recall: float = 0.96
    block: int = 4000
    queries: int = 8192
    rounds: int = 8
    seed: int = 29


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, by a matrix product."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


class Tree:
    """Centres by node; children of a node are consecutive. A node without children is a leaf."""

    def __init__(self, x: np.ndarray, leaves: int, cfg: AnnConfig) -> None:
        rng = np.random.default_rng(cfg.seed)
        self.centre, self.first, self.count = [x.mean(0) if len(x) else np.zeros(0)], [0], [0]
        heap = [(-len(x), 0, np.arange(len(x)))]  # the largest part splits next
        leaf_count = 1
        while heap and leaf_count < leaves:
            n, node, rows = heapq.heappop(heap)
            if -n < 2 * cfg.branch:
                break
            centres, parts = self._kmeans(x[rows], rng, cfg)
            if len(centres) < 2:
                continue
            self.first[node], self.count[node] = len(self.centre), len(centres)
            for c, p in zip(centres, parts, strict=True):
                heapq.heappush(heap, (-len(p), len(self.centre), rows[p]))
                self.centre.append(c)
                self.first.append(0)
                self.count.append(0)
            leaf_count += len(centres) - 1
        self.centre = np.array(self.centre, np.float32)
        self.first, self.count = np.array(self.first), np.array(self.count)
        self.leaves = int((self.count == 0).sum())

    @staticmethod
    def _kmeans(x: np.ndarray, rng: np.random.Generator, cfg: AnnConfig) -> tuple[np.ndarray, list[np.ndarray]]:
        centres = [x[rng.integers(len(x))]]
        near = squared(x, centres[0][None])[:, 0].astype(float)
        while len(centres) < cfg.branch and near.sum() > 1e-9 * len(x):
            centres.append(x[rng.choice(len(x), p=near / near.sum())])
            near = np.minimum(near, squared(x, centres[-1][None])[:, 0])
        c = np.array(centres)
        for _ in range(cfg.rounds):
            at = squared(x, c).argmin(1)
            c = np.array([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))])
        at = squared(x, c).argmin(1)
        parts = [np.flatnonzero(at == i) for i in range(len(c))]
        full = [i for i, p in enumerate(parts) if len(p)]
        return c[full], [parts[i] for i in full]

    def order(self) -> list[int]:
        """The leaves from left to right: neighbours in the tree follow each other."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            if self.count[node]:
                todo += range(self.first[node] + self.count[node] - 1, self.first[node] - 1, -1)
            else:
                out.append(node)
        return out

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child, level by level."""
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.count[node]:
                at[rows] = node
            elif len(rows):
                f, n = self.first[node], self.count[node]
                to = squared(x[rows], self.centre[f : f + n]).argmin(1)
                todo += [(f + i, rows[to == i]) for i in range(n)]
        return at

    def visits(self, x: np.ndarray, most: int, size: np.ndarray | None = None, least: int = 0) -> Iterator[list[int]]:
        """The first `most` leaves of each vector, best bin first; more while they hold fewer than `least` of the vectors, size by node."""
        first, count = self.first.tolist(), self.count.tolist()
        held = size.tolist() if size is not None else [0] * len(first)
        step = max(1, (1 << 22) // len(self.centre))
        for i in range(0, len(x), step):
            for row in squared(x[i : i + step], self.centre):
                row, heap, out, seen = row.tolist(), [(0.0, 0)], [], 0
                while heap and (len(out) < most or seen < least):
                    _, node = heapq.heappop(heap)
                    if count[node]:
                        for c in range(first[node], first[node] + count[node]):
                            heapq.heappush(heap, (row[c], c))
                    else:
                        out.append(node)
                        seen += held[node]
                yield out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(column), -1)


def _best(q: np.ndarray, y: np.ndarray, qid: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in y, exact squared distance) of what can be among each query's k nearest others in y, ties included."""
    d = squared(q, y)
    d[qid[:, None] == ids[None]] = np.inf
    kth = np.partition(d, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1 : min(k, len(ids))]
    i, j = np.nonzero((d <= kth * 1.00001 + 1e-5) & np.isfinite(d))  # beyond the rounding of single precision
    exact = [((q[i[s : s + 65536]].astype(float) - y[j[s : s + 65536]].astype(float)) ** 2).sum(1) for s in range(0, len(i), 65536)]
    return i, j, np.concatenate(exact) if exact else np.zeros(0)  # equal vectors are at 0, not at a rounding error


def _top(q: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best (distance, id) of each q, in order."""
    o = np.lexsort([ids, dist, q])
    rank = np.arange(len(o)) - np.searchsorted(q[o], q[o])
    return o[rank < k]


def true_neighbours(placed: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(t, leaf, id): the k nearest others of the few queries (ids, q), by one pass over all vectors."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                own, leaf = C.ids_of(part.column("id")), C.ids_of(part.column("leaf"))
                i, j, dist = _best(q, _matrix(part.column("v")), ids, own, k)
                held = tuple(np.concatenate(x) for x in zip(held, (i, leaf[j], own[j], dist), strict=True))
                keep = _top(held[0], held[2], held[3], k)
                held = tuple(x[keep] for x in held)
        yield C.batch_of(t=held[0], leaf=held[1], id=held[2], distance=held[3])

    near = placed.mapInArrow(nearest, "t long, leaf long, id long, distance double")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy("distance", "id"))).where(F.col("r") <= k).select("t", "leaf", "id")


def calibrated(tree: Tree, placed: DataFrame, ids: np.ndarray, q: np.ndarray, cfg: AnnConfig) -> int:
    """Leaves to visit so that the trial queries reach the recall among all vectors."""
    if not len(ids) or tree.leaves == 1:
        return tree.leaves
    true = true_neighbours(placed, ids, q, cfg.k).toArrow()  # trial * k rows
    if not true.num_rows:
        return 1
    place = np.full((len(ids), len(tree.centre)), tree.leaves)
    for t, order in enumerate(tree.visits(q, tree.leaves)):
        place[t, order] = np.arange(len(order))
    needed = np.sort(place[C.ids_of(true["t"].combine_chunks()), C.ids_of(true["leaf"].combine_chunks())]) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(cfg.recall * len(needed))))])


def cells(order: list[int], size: np.ndarray, nodes: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell by node, blocks by cell): leaves in their order, together up to `block` vectors; a larger one is alone."""
    cell, blocks, held = np.zeros(nodes, np.int64), [], block + 1
    for leaf in order:
        n = int(size[leaf])
        if held + n > block:
            blocks.append(max(1, -(-n // block)))
            held = 0
        cell[leaf] = len(blocks) - 1
        held += n
    return cell, np.array(blocks, np.int64)


def neighbours(table: DataFrame, cfg: AnnConfig = AnnConfig(), key: str = "vec_id", vector: str = "embedding", every: int = 1) -> DataFrame:
    """(vec_id, neighbour, distance, rank): the k nearest others, by squared distance, of the vectors whose id is divisible by `every`."""
    spark = table.sparkSession
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x))")
    dims = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dims is None:
        return spark.createDataFrame([], "vec_id long, neighbour long, distance double, rank int")
    rows = C.durable(rows.where(F.size("v") == dims["n"]).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    total, dim = rows.count(), dims["n"]
    at, share = F.xxhash64("id", F.lit(cfg.seed)), min(1.0, cfg.sample_bytes / (4 * dim) / total)
    some = rows if share == 1 else rows.where(at <= F.lit(int(-(2**63) + share * 2.0**64)))
    some = some.toArrow()
    x = _matrix(some["v"].combine_chunks())[np.argsort(C.ids_of(some["id"].combine_chunks()))]
    tree = Tree(x, max(1, min(total // cfg.leaf, len(x) // cfg.per_leaf)), cfg)
    del x, some
    sent = spark.sparkContext.broadcast(tree)  # its centres are bounded by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.assign(_matrix(b.column("v")))), b.column("id"), b.column("v")], names=["leaf", "id", "v"])

    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = rows.withColumn("copy", copy).where(F.col("copy") <= cfg.k + 1).select("id", "v")
    placed = C.durable(kept.mapInArrow(place, "leaf long, id long, v array<float>"), "placed")
    size = np.zeros(len(tree.centre), np.int64)
    for r in placed.groupBy("leaf").count().toLocalIterator():  # a row for each leaf
        size[r["leaf"]] = r["count"]
    questions = rows.where(F.col("id") % every == 0)
    trial = questions.orderBy(F.xxhash64("id", F.lit(cfg.seed + 1)), "id").limit(cfg.trial).toArrow()
    visits = 1
    if trial.num_rows:
        visits = calibrated(tree, placed, C.ids_of(trial["id"].combine_chunks()), _matrix(trial["v"].combine_chunks()), cfg)
    cell, blocks = cells(tree.order(), size, len(size), cfg.block)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                to, row, leaves = [], [], []
                for i, found in enumerate(sent.value.visits(_matrix(part.column("v")), visits, size, cfg.k + 1)):
                    by: dict[int, list[int]] = {}
                    for leaf in found:
                        by.setdefault(int(cell[leaf]), []).append(leaf)
                    to += by
                    row += [i] * len(by)
                    leaves += by.values()
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), part.column("id").take(take), part.column("v").take(take), pa.array(leaves, pa.list_(pa.int64()))], names=["cell", "qid", "q", "leaves"])

    def meet(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names, none = ["vec_id", "neighbour", "distance"], pd.DataFrame({"vec_id": pd.Series(dtype="int64"), "neighbour": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return none
        right = right.sort_values(["leaf", "id"])
        ids, leaf, y = right["id"].to_numpy(), right["leaf"].to_numpy(), np.stack(right["v"].to_numpy())
        qid, q = left["qid"].to_numpy(), np.stack(left["q"].to_numpy())
        wanted = left["leaves"].to_numpy()
        which, of = np.concatenate(wanted), np.repeat(np.arange(len(left)), [len(w) for w in wanted])
        o = np.argsort(which, kind="stable")
        which, of = which[o], of[o]
        out = []
        for n in np.unique(which):
            a, b = np.searchsorted(leaf, [n, n + 1])
            c, d = np.searchsorted(which, [n, n + 1])
            for s in range(c, d, 1024) if b > a else ():
                mine = of[s : min(d, s + 1024)]
                i, j, dist = _best(q[mine], y[a:b], qid[mine], ids[a:b], cfg.k)
                out.append((mine[i], ids[a:b][j], dist))
        if not out:
            return none
        i, near, dist = (np.concatenate(c) for c in zip(*out, strict=True))
        keep = _top(i, near, dist, cfg.k)
        return pd.DataFrame(dict(zip(names, (qid[i[keep]], near[keep], dist[keep]), strict=True)))

    asked = C.durable(questions.mapInArrow(ask, "cell long, qid long, q array<float>, leaves array<long>"), "asked")
    # a cell's vectors are met block by block, and about `queries` of the queries that come to it at once
    come = asked.groupBy("cell").count().select("cell", F.ceil(F.col("count") / cfg.queries).cast("int").alias("parts"))
    come = come.join(F.broadcast(spark.createDataFrame(pa.table({"cell": np.arange(len(blocks)), "blocks": blocks}))), "cell")
    order = np.array(tree.order())
    where = spark.createDataFrame(pa.table({"leaf": order, "cell": cell[order]}))
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of).cast("int") - 1))
    one = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    points = placed.join(F.broadcast(where), "leaf").join(F.broadcast(come), "cell").select("cell", one("id", "blocks").alias("block"), each("parts").alias("part"), "leaf", "id", "v")
    asked = asked.join(F.broadcast(come), "cell").select("cell", each("blocks").alias("block"), one("qid", "parts").alias("part"), "qid", "q", "leaves")
    keys = ["cell", "block", "part"]
    met = asked.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInPandas(meet, "vec_id long, neighbour long, distance double")
    w = Window.partitionBy("vec_id").orderBy("distance", "neighbour")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.k)
