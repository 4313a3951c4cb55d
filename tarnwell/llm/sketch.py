"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and verification.

A document is the set of its runs of `shingle` words. Register i of its sketch is floor(1 - log_b(min h_i)), with
h_i exponential of the rate a over the set: an exponentially spaced, truncated minimum. Registers of a union are
the elementwise maximum, so sketches merge; two registers agree about as often as the sets overlap. Bands of
registers give candidates, of which the Jaccard similarity is estimated by maximum likelihood over the counts of
registers that are larger in the one, in the other and equal; what may reach the threshold is verified on the
exact sets. Verified pairs are closed transitively.

Buckets are met in three rounds. First every document meets the first of its bucket and the one before it, which links
groups of copies of any size at a cost in proportion. Then, in buckets that hold more than one of the groups found so
far, all pairs of different groups meet: in buckets of up to `most` documents as they are; larger ones are divided by
one more band, whichever it is that a pair agrees in, again and again until they are small. Last, in the larger buckets
that still hold more than one group, all pairs of different groups meet, divided or not: their registers are compared
block by block. So any two documents that share a bucket meet, unless they are in one group already.

Defined results: rows with a null doc_id and texts that are null or have no word belong to no group; rows with
equal doc_id are one document; documents of equal word sequences are exact copies whatever their length; ties go
to the smallest doc_id; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class SketchConfig:
    """threshold: Jaccard similarity of the verified sets; margin: by how much an estimate may fall short of it; most: documents of a bucket that meet at once; block: documents of a larger one that are compared with as many others in one task."""

    shingle: int = 3
    bands: int = 21
    rows: int = 3
    base: float = 1.001
    rate: float = 20.0
    threshold: float = 0.5
    margin: float = 0.2
    most: int = 128
    block: int = 1024
    seed: int = 11

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def register_values(minima: np.ndarray, cfg: SketchConfig) -> np.ndarray:
    """Registers of minima of uniform 64-bit hashes."""
    u = (minima.astype(np.float64) + 1) / 2.0**64
    e = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / cfg.rate
    return np.clip(np.floor(1 - np.log(e) / np.log(cfg.base)), 0, 65535).astype(np.uint16)


def sketch_arrays(sh: np.ndarray, off: np.ndarray, cfg: SketchConfig) -> np.ndarray:
    """Registers by document of the shingles sh; documents without shingles have zeros."""
    n = len(off) - 1
    out = np.zeros((n, cfg.registers), np.uint16)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        at = off[full]
        rng = np.random.default_rng(cfg.seed)
        keys = rng.integers(1, 1 << 63, (cfg.registers, 2), np.int64).astype(np.uint64)
        for i, (a, b) in enumerate(keys):
            out[full, i] = register_values(np.minimum.reduceat((sh ^ b) * (a | np.uint64(1)), at), cfg)
    return out


def sketch_table(docs: DataFrame, cfg: SketchConfig) -> DataFrame:
    """(doc_id, f1, f2, n, regs): fingerprint of the word sequence, number of shingles and registers of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.table_slices(batches, "text", C.SLICE_BYTES):
            words, off = C.word_hashes(b.column("text"))
            sh, to = C.shingles(words, off, cfg.shingle)
            n = np.diff(off)
            keep = np.flatnonzero(n > 0)
            if not len(keep):
                continue
            place = np.arange(len(words)) - np.repeat(off[:-1], n)
            with np.errstate(over="ignore"):
                f = [np.add.reduceat(C.mix(words + C.mix(place.astype(np.uint64) + np.uint64(s))), off[keep]) for s in (1, 1 << 40)]
            regs = sketch_arrays(sh, to, cfg)[keep]
            yield C.batch_of(doc_id=C.ids_of(b.column("doc_id"))[keep], f1=f[0].view(np.int64), f2=f[1].view(np.int64), n=np.diff(to)[keep].astype(np.int64), regs=C.binaries(regs.ravel(), np.full(len(keep), cfg.registers)))

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "doc_id long, f1 long, f2 long, n long, regs binary")


def jaccard_mle(more: np.ndarray, less: np.ndarray, same: np.ndarray, nu: np.ndarray, nv: np.ndarray, base: float) -> np.ndarray:
    """Jaccard similarity of greatest likelihood, by Newton-free grid refinement.

    more, less, same: registers that are larger in u, larger in v, equal; nu, nv: sizes of the two sets.
    """
    u, v = nu / (nu + nv), nv / (nu + nv)
    most = np.minimum(u / v, v / u)
    lo, hi = np.zeros(len(u)), most.copy()

    def loglik(j: np.ndarray) -> np.ndarray:
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)
        a, b = p(u - v * j), p(v - u * j)
        t = 1e-12
        return more * np.log(np.maximum(a, t)) + less * np.log(np.maximum(b, t)) + same * np.log(np.maximum(1 - a - b, t))

    for _ in range(40):  # the likelihood is concave in j: golden section
        d = (hi - lo) * 0.3819660113
        x, y = lo + d, hi - d
        left = loglik(x) >= loglik(y)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    return (lo + hi) / 2


def reaches(more: np.ndarray, less: np.ndarray, same: np.ndarray, nu: np.ndarray, nv: np.ndarray, base: float, least: float) -> np.ndarray:
    """Whether jaccard_mle() is at least `least`, by the slope of the likelihood there, which is concave."""
    u, v = nu / (nu + nv), nv / (nu + nv)
    c, t = (base - 1) / base, 1e-12
    x, y = np.maximum(u - v * least, 0), np.maximum(v - u * least, 0)
    a, b = (-np.log1p(-z * c) / np.log(base) for z in (x, y))
    da, db = v * c / (1 - x * c) / np.log(base), u * c / (1 - y * c) / np.log(base)
    slope = same * (da + db) / np.maximum(1 - a - b, t) - more * da / np.maximum(a, t) - less * db / np.maximum(b, t)
    return (np.minimum(u / v, v / u) >= least) & (slope >= 0)


def band_table(sketches: DataFrame, cfg: SketchConfig) -> DataFrame:
    """(doc_id, keys): a hash of each band's registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                buf, off = C.raw(b.column("regs").cast(pa.large_binary()))
                r = buf[off[0] : off[-1]].view(np.uint16).reshape(-1, cfg.bands, cfg.rows).astype(np.uint64)
                key = np.zeros(r.shape[:2], np.uint64) + C.mix(np.arange(cfg.bands, dtype=np.uint64) + np.uint64(77))
                for j in range(cfg.rows):
                    key = C.mix(key + r[:, :, j])
                keys = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * cfg.bands), pa.array(key.view(np.int64).ravel()))
                yield C.batch_of(doc_id=b.column("doc_id"), keys=keys)

    return sketches.select("doc_id", "regs").mapInArrow(run, "doc_id long, keys array<long>")


def first_pairs(bands: DataFrame) -> DataFrame:
    """(a, b), a < b: each document with the first of its bucket and the one before it."""
    w = Window.partitionBy("bucket").orderBy("doc_id")
    met = bands.select("doc_id", F.explode("keys").alias("bucket")).select("doc_id", F.first("doc_id").over(w).alias("x"), F.lag("doc_id").over(w).alias("y"))
    return met.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), F.col("doc_id").alias("b")).where("a < b").distinct()


def _rooted(bands: DataFrame, groups: DataFrame) -> DataFrame:
    """bands with the root of each document's group (id, root), itself where it has none."""
    return bands.join(C.growing(groups.withColumnRenamed("id", "doc_id")), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))


def other_pairs(bands: DataFrame, groups: DataFrame, cfg: SketchConfig) -> DataFrame:
    """(a, b), a < b: all pairs of different groups (id, root) that share a bucket of at most `most` documents.

    A bucket is a set of bands (used) in which its documents agree. Larger ones are divided by each band that isn't
    in the set; in one of all bands, where documents are alike throughout, each meets the one before it. What agrees
    in large buckets only is left to block_pairs().
    """
    if cfg.bands > 62:
        raise ValueError("sets of bands are kept in 63 bits")
    rows = _rooted(bands, groups).select("doc_id", "root", F.posexplode("keys").alias("j", "bucket")).selectExpr("doc_id", "root", "bucket", "shiftleft(1L, j) AS used")
    out, level = None, 1
    while True:
        sizes = rows.groupBy("bucket", "used").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket", "used", "n")
        rows = C.durable(rows.join(C.growing(sizes), ["bucket", "used"]), "buckets")
        small = rows.where(f"n <= {cfg.most}")
        x = small.select("bucket", "used", F.col("doc_id").alias("a"), F.col("root").alias("ra"))
        y = small.select("bucket", "used", F.col("doc_id").alias("b"), F.col("root").alias("rb"))
        pairs = x.join(y, ["bucket", "used"]).where("a < b AND ra <> rb").select("a", "b")
        large = rows.where(f"n > {cfg.most}")
        if level == cfg.bands:
            before = F.lag("doc_id").over(Window.partitionBy("bucket").orderBy("doc_id"))
            pairs = pairs.unionByName(large.select(before.alias("a"), F.col("doc_id").alias("b")).where("a IS NOT NULL"))
        out = pairs if out is None else out.unionByName(pairs)
        if level == cfg.bands or large.isEmpty():
            return out.distinct()
        rows = large.drop("n").join(bands, "doc_id").select("doc_id", "root", "bucket", "used", F.posexplode("keys").alias("j", "key")).where("(used & shiftleft(1L, j)) = 0")
        rows = rows.selectExpr("doc_id", "root", "bucket ^ key AS bucket", "used | shiftleft(1L, j) AS used").distinct()
        level += 1


def block_pairs(bands: DataFrame, groups: DataFrame, sketches: DataFrame, cfg: SketchConfig) -> DataFrame | None:
    """(a, b), a < b: all pairs of different groups (id, root) that share a bucket of more than `most` documents and whose
    estimated similarity is at least threshold - margin; None where no such bucket holds more than one group.

    A bucket is cut into blocks, and each pair of blocks is a task's work, so that no bucket is in one place.
    """
    rows = _rooted(bands, groups).select("doc_id", "root", F.explode("keys").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi")).where(f"lo < hi AND k > {cfg.most}")
    rows = C.durable(rows.join(C.growing(sizes.selectExpr("bucket", f"ceil(k / {cfg.block}) AS k")), "bucket"), "buckets")
    if rows.isEmpty():
        C.drop_durable(rows)
        return None

    def compare(t: pa.Table) -> pa.Table:
        i, j, part, doc, root, n = (t.column(c).to_numpy() for c in ("i", "j", "part", "doc_id", "root", "n"))
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, cfg.registers)
        x, y = np.flatnonzero(part == i[0]), np.flatnonzero(part == j[0])
        out = []
        for s in range(0, len(x), 16):
            p, q = (v.ravel() for v in np.meshgrid(x[s : s + 16], y, indexing="ij"))
            wanted = (root[p] != root[q]) & ((i[0] != j[0]) | (doc[p] < doc[q]))
            p, q = p[wanted], q[wanted]
            u, v = regs[p], regs[q]
            more, less = (u > v).sum(1), (u < v).sum(1)
            ok = reaches(more, less, cfg.registers - more - less, n[p], n[q], cfg.base, cfg.threshold - cfg.margin)
            out.append(np.stack([doc[p[ok]], doc[q[ok]]]))
        both = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"a": both.min(0), "b": both.max(0)})

    rows = rows.join(C.growing(sketches), "doc_id").withColumn("part", F.expr("pmod(xxhash64(doc_id), k)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, k - 1)"))).selectExpr("bucket", "least(part, other) AS i", "greatest(part, other) AS j", "part", "doc_id", "root", "n", "regs")
    return rows.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def likely_pairs(pairs: DataFrame, sketches: DataFrame, cfg: SketchConfig) -> DataFrame:
    """(a, b, estimate) of the pairs whose estimated similarity is at least threshold - margin."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, cfg.registers) for c in ("xr", "yr"))
                j = jaccard_mle((x > y).sum(1), (x < y).sum(1), (x == y).sum(1), C.ids_of(b.column("xn")), C.ids_of(b.column("yn")), cfg.base)
                ok = j >= cfg.threshold - cfg.margin
                yield C.batch_of(a=C.ids_of(b.column("a"))[ok], b=C.ids_of(b.column("b"))[ok], estimate=j[ok])

    one = sketches.selectExpr("doc_id AS a", "n AS xn", "regs AS xr")
    two = sketches.selectExpr("doc_id AS b", "n AS yn", "regs AS yr")
    return pairs.join(C.growing(one), "a").join(C.growing(two), "b").mapInArrow(estimate, "a long, b long, estimate double")


def verified_pairs(docs: DataFrame, pairs: DataFrame, cfg: SketchConfig) -> DataFrame:
    """(a, b, jaccard) of the pairs whose sets of shingles have at least the threshold in common."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.table_slices(batches, "text", C.SLICE_BYTES):
            words, off = C.word_hashes(b.column("text"))
            sh, to = C.shingles(words, off, cfg.shingle)
            parts = [np.unique(sh[to[i] : to[i + 1]]) for i in range(len(to) - 1)]
            yield C.batch_of(doc_id=b.column("doc_id"), partners=b.column("partners"), shingles=C.binaries(np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array([len(p) for p in parts], np.int64)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                j = np.empty(b.num_rows)
                for i, (x, y) in enumerate(zip(b.column("s")[0:], b.column("t")[0:], strict=True)):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    j[i] = both / max(1, len(x) + len(y) - both)
                ok = j >= cfg.threshold
                yield C.batch_of(a=C.ids_of(b.column("a"))[ok], b=C.ids_of(b.column("b"))[ok], jaccard=j[ok])

    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("doc_id"), "a", "b"), F.struct(F.col("b").alias("doc_id"), "a", "b"))).alias("e")).select("e.*")
    wanted = C.lists(ends, "doc_id", F.struct("a", "b"), "partners")
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").join(C.growing(wanted), "doc_id")
    of = texts.mapInArrow(sets, "doc_id long, partners array<struct<a: long, b: long>>, shingles binary")
    of = of.select("doc_id", "shingles", F.explode("partners").alias("p")).select("p.a", "p.b", "doc_id", "shingles")
    one = F.min(F.when(F.col("doc_id") == F.col("a"), F.col("shingles")))
    two = F.min(F.when(F.col("doc_id") == F.col("b"), F.col("shingles")))
    return of.groupBy("a", "b").agg(one.alias("s"), two.alias("t")).where("s IS NOT NULL AND t IS NOT NULL").mapInArrow(compare, "a long, b long, jaccard double")


def _holding(docs: DataFrame, pairs: DataFrame, slots: int = 1 << 19) -> DataFrame:
    """(doc_id, text) of the documents in the slots that those of the pairs are in: all of theirs and some more, so that texts of few pairs are shuffled alone."""
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(slots))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).select(slot.alias("_slot")).distinct()
    return docs.select("doc_id", "text").withColumn("_slot", slot).join(F.broadcast(wanted), "_slot", "left_semi")


def near_duplicates(docs: DataFrame, cfg: SketchConfig = SketchConfig()) -> DataFrame:
    """(doc_id, duplicate_of): each document that has an exact or near copy of a smaller doc_id, and the smallest of its group."""
    s = C.durable(sketch_table(docs, cfg), "sketches")
    same = s.groupBy("f1", "f2").agg(F.min("doc_id").alias("first"))
    exact = s.join(same, ["f1", "f2"]).selectExpr("first AS a", "doc_id AS b").where("a < b").distinct()
    firsts = s.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "n", "regs")).alias("x")).select("x.*").groupBy("doc_id").agg(F.min(F.struct("n", "regs")).alias("x")).select("doc_id", "x.*")
    firsts = C.durable(firsts, "firsts")
    bands = C.durable(band_table(firsts, cfg), "bands")

    def verified(likely: DataFrame, few: bool = False) -> DataFrame:
        likely = C.durable(likely, "pairs")
        near = C.durable(verified_pairs(_holding(docs, likely) if few else docs, likely, cfg).select("a", "b"), "near")
        C.drop_durable(likely)
        return near

    groups = C.components(exact.unionByName(verified(likely_pairs(first_pairs(bands), firsts, cfg))))
    groups = C.durable(_joined(groups, verified(likely_pairs(other_pairs(bands, groups, cfg), firsts, cfg))), "groups")
    rest = block_pairs(bands, groups, firsts, cfg)
    if rest is not None:
        groups = _joined(groups, verified(rest, few=True))
    C.drop_durable(s, firsts, bands)
    return groups.where("id <> root").selectExpr("id AS doc_id", "root AS duplicate_of")


def _joined(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """groups (id, root) with those united that the pairs (a, b) link."""
    # what joins groups is little, so the second closure is one of their smallest members
    of = lambda c: groups.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    ends = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = C.components(ends).select(F.col("id").alias("root"), F.col("root").alias("top"))
    every = groups.join(joined, "root", "full")  # a document that was alone has no row in groups, but one in joined
    return every.select(F.coalesce("id", "root").alias("id"), F.coalesce("top", "root").alias("root"))


def drop_near_duplicates(docs: DataFrame, cfg: SketchConfig = SketchConfig()) -> DataFrame:
    """docs without those of near_duplicates(): one document of each group stays. All columns as they were."""
    gone = near_duplicates(docs, cfg).select(F.col("doc_id").alias("_gone"))
    return docs.join(C.growing(gone), docs["doc_id"] == gone["_gone"], "left_anti")
