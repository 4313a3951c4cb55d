"""Shared pieces of the training-data operators: text kernels over Arrow buffers and durable tables.

Text is handled as the UTF-8 bytes of Arrow string columns. A word is a maximal run of ASCII letters and
digits and of bytes of other scripts, in lower case; everything else separates words. Words get 64-bit
polynomial hashes, computed for a whole batch at once with no Python loop over words.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a kernel holds at once (its temporary arrays take about 30 times as much).
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of our own only where that is unset and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tarnwell-")
        spark.conf.set("spark.checkpoint.dir", path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)  # with its scheme, so that other readers find the same place
    return re.sub("^file:/*", "file:///", hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()).rstrip("/")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: lineage ends there and lost executors lose nothing.

    The shuffle files of the job that writes it are removed when it ends; nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_durable(*tables: DataFrame) -> None:
    """Removes the files of tables from `durable` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            with contextlib.suppress(Exception):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["p"]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for name, base in (("p", _BASE), ("i", _BASE_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


def utf8(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """One large_string array without nulls ('' in their place)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, and offsets into them (the first may be above 0)."""
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of the bytes in table; a run ends with its document."""
    lo, hi = int(off[0]), int(off[-1])
    inside = table[buf[lo:hi]]
    at = np.zeros(hi - lo + 1, np.int8)
    if hi > lo:
        at[0] = inside[0]
        at[1:-1] = inside[1:].view(np.int8) - inside[:-1].view(np.int8)
        at[-1] = -int(inside[-1])
    starts, ends = np.flatnonzero(at == 1), np.flatnonzero(at == -1)
    cut = off[1:-1] - lo  # where two documents meet inside a run
    cut = cut[(cut > 0) & (cut < hi - lo)]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]]) if len(cut) else cut
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts + lo, ends + lo


def word_hashes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, offsets of the documents in them). Null texts have no words."""
    low = pc.utf8_lower(utf8(texts))
    buf, off = raw(low)
    parts, counts = [], np.zeros(len(low), np.int64)
    for a, b in _slices(off):
        sub = off[a : b + 1]
        s, e = spans(buf, sub)
        if len(s):
            counts[a:b] = np.bincount(np.searchsorted(sub[1:], s, "right"), minlength=b - a)
            parts.append(_hash_runs(buf, s, e))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def _slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes; a longer document is alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b
        a = b


def _hash_runs(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs [s, e), which are in order; piece by piece, so that one huge text needs little memory."""
    out, i = np.empty(len(s), np.uint64), 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + SLICE_BYTES, "right")))
        lo, hi = int(s[i]), int(e[j - 1])
        p, inv = powers(hi - lo + 1)
        c = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * p[: hi - lo], out=c[1:])
        out[i:j] = mix((c[e[i:j] - lo] - c[s[i:j] - lo]) * inv[s[i:j] - lo])
        i = j
    return out


def shingles(h: np.ndarray, off: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of q words in a row, by document; a document of 1 to q-1 words has one shingle of all of them."""
    n = np.diff(off)
    counts = np.where(n >= q, n - q + 1, (n > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(counts)])
    if not len(h):
        return np.zeros(0, np.uint64), to
    k = [np.uint64(pow(0xD1342543DE82EF95, j, 1 << 64)) for j in range(q)]
    full = np.zeros(len(h), np.uint64)
    for j in range(q):
        full[: len(h) - j] += h[j:] * k[j]
    out = np.empty(to[-1], np.uint64)
    doc = np.repeat(np.arange(len(n)), counts)
    out[:] = full[off[doc] + np.arange(to[-1]) - to[doc]]
    for d in np.flatnonzero((n > 0) & (n < q)):
        w = h[off[d] : off[d + 1]]
        out[to[d]] = (w * np.array(k[: len(w)], np.uint64)).sum() + np.uint64(len(w))
    return mix(out), to


def table_slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has about `most` bytes of text."""
    for batch in batches:
        if batch.num_rows:
            column = utf8(batch.column(text))
            _, off = raw(column)
            for a, b in _slices(off, most):
                yield batch.slice(a, b - a)


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then the same for each other range."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first, counts) + np.arange(total)


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow binary array of the rows of data (counts[i] items each), without copying them one by one."""
    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * data.dtype.itemsize
    if off[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def batch_of(**columns) -> pa.RecordBatch:
    """A record batch of NumPy or Arrow columns."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def ids_of(column: pa.Array) -> np.ndarray:
    """A column of integers without nulls, as int64."""
    return np.asarray(column.cast(pa.int64()).to_numpy(zero_copy_only=False), np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(id, root): of every id of the edges (a, b), the smallest id connected with it.

    Alternating large-star and small-star steps; each is one shuffle and its result a durable table. Hubs are
    windows, which spill, never lists. Nulls must be gone before; self edges are dropped.
    """
    e = durable(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "edges")
    seen = None
    w = Window.partitionBy("u")
    while True:
        both = e.unionByName(e.selectExpr("v AS u", "u AS v")).withColumn("m", F.least(F.min("v").over(w), "u"))
        large = both.where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        small = large.withColumn("m", F.min("v").over(w))
        small = small.selectExpr("v AS u", "m AS v").unionByName(small.selectExpr("u", "m AS v")).where("u <> v").distinct()
        new = durable(small, "edges")
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        drop_durable(e)
        e = new
        if now == seen:
            break
        seen = now
    return e.selectExpr("u AS id", "v AS root").unionByName(e.selectExpr("v AS id", "v AS root")).distinct()


def growing(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the corpus: sorted and merged, which spills, and which adaptive execution
    splits where a key is hot. At every size, so that a small run does what a large one will."""
    return df.hint("merge")


def lists(df: DataFrame, key: str, value: Column, name: str, most: int = 2048) -> DataFrame:
    """(key, name): the values of each key in lists of about `most` at the most, so that no key has a list without a bound."""
    n = F.count("*").over(Window.partitionBy(key))
    parts = df.select(key, value.alias(name), F.ceil(n / most).cast("int").alias("_of"))
    return parts.groupBy(key, F.pmod(F.xxhash64(name), F.col("_of")).alias("_part")).agg(F.collect_list(name).alias(name)).select(key, name)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
