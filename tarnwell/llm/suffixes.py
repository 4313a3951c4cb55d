"""Passages that repeat in other documents word for word, by suffix arrays over shards of the corpus.

Equal passages must meet in one shard although they stand in different files. So each document is cut into segments
around anchors: the least hash of each window of passage length. Equal passages have the same anchor, and the segment
around it, at least a passage long on either side as far as the anchor is the least, holds them whole. Passages that
begin at about the same distance from the anchor are a segment of their own, and segments go to shards by all the words
that their passages have in common, so that a phrase of many documents doesn't bring what stands around it together.
Such keys of a single document can't be part of a repeat and stay behind; equal segments of a key are one string, of
which the first holder stands for all (the others repeat it as they are).

Of each shard's segments the suffix array with common prefixes is built by induced sorting: in memory where the shard
fits (induced.py), else with all that is as long as the text in files of the shared folder (external.py); a single
anchor, which can't be divided, may be many times as large as memory. Suffixes in a row that have a passage's words in
common are occurrences of one passage; the one in the smallest document is the source of the others. At the end
occurrences that go on along a diagonal are joined.

Words are compared by 64-bit hashes when segments are equal, and by 32 bits of each word in the suffix arrays (two
different passages would have to agree in all of them).

Defined results: rows with a null doc_id or text have no passages, and texts of fewer words neither; texts of any
length are cut whole; rows of equal doc_id are one document (repeats within one document are not reported); the source is always of a smaller doc_id;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import external as X
from .induced import suffix_array

#: Bytes that sorting in memory takes by word (53 measured).
_WORD_BYTES = 64
from .windows import WindowConfig, compact_windows


@dataclass(frozen=True)
class SuffixConfig:
    """min_words: shortest passage (at most 254); starts: places at which the passages of a segment begin; shard_words: words of a shard, about; memory: bytes that a shard's sorting holds before it uses disk."""

    min_words: int = 50
    shingle: int = 6
    starts: int = 12
    shard_words: int = 2_000_000
    memory: int = 256 << 20
    seed: int = 31

    def __post_init__(self) -> None:
        if not self.shingle < self.min_words <= 254:
            raise ValueError("min_words must be above shingle and at most 254")

    @property
    def windows(self) -> WindowConfig:
        return WindowConfig(min_words=self.min_words, shingle=self.shingle, functions=1, seed=self.seed)


def segments(words: np.ndarray, off: np.ndarray, cfg: SuffixConfig) -> tuple[np.ndarray, ...]:
    """(document, start, end, key) of the segments; places within words.

    Passages around an anchor begin from width - 1 words before it up to the anchor itself. Those that begin within the
    same `starts` of these places are a segment, whose key is the hash of the words that all of them hold.
    """
    sh, to = C.shingles(words, off, cfg.shingle)
    _, d, left, c, right = compact_windows(sh, to, cfg.windows)
    reach = cfg.windows.width - 1
    shift = off[d] - to[d]
    base = c - reach
    first, last = np.maximum(left, base), np.minimum(right, c + reach) + cfg.shingle - cfg.min_words  # beginnings of passages
    part = (first - base) // cfg.starts
    count = (last - base) // cfg.starts - part + 1
    of = np.repeat(np.arange(len(d)), count)
    part = C.expand(part, count)
    low = base[of] + part * cfg.starts
    high = np.minimum(low + cfg.starts - 1, c[of])
    s, e = np.maximum(first[of], low), np.minimum(last[of], high) + cfg.min_words
    d, shift = d[of], shift[of]
    key = segment_hashes(words, high + shift, low + cfg.min_words + shift) + part.astype(np.uint64) if len(d) else np.zeros(0, np.uint64)
    return d, s + shift, e + shift, C.mix(key)


def segment_hashes(words: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    p, inv = C.powers(len(words) + 1)
    c = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[: len(words)], out=c[1:])
    return C.mix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64))


def segment_table(docs: DataFrame, cfg: SuffixConfig) -> DataFrame:
    """(key, seg, doc_id, place): hash of the words that its passages have in common, hash of its words, and start and length of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.table_slices(batches, "text", C.SLICE_BYTES):
            words, off = C.word_hashes(b.column("text"))
            d, s, e, key = segments(words, off, cfg)
            if len(d):
                yield C.batch_of(key=C.mix(key).view(np.int64), seg=segment_hashes(words, s, e).view(np.int64), doc_id=C.ids_of(b.column("doc_id"))[d], place=((s - off[d]) << 16) | (e - s))

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "key long, seg long, doc_id long, place long")


def shard_repeats(doc: np.ndarray, start: np.ndarray, words: np.ndarray, count: np.ndarray, cfg: SuffixConfig) -> tuple[np.ndarray, ...]:
    """(document, place, source, place in it) of all passages of min_words in one shard that a smaller document has.

    words: 32-bit words of the segments, one after another; count: words of each; start: its place in its document.
    """
    n = len(doc)
    first = np.cumsum(count + 1) - count - 1
    kinds, ranks = np.unique(words, return_inverse=True)  # their order is all that matters, and fits in 32 bits
    text = np.empty(int(count.sum()) + n, np.int32 if len(kinds) + n < 1 << 31 else np.int64)
    of = np.repeat(np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64), count + 1)
    end = first + count
    body = np.ones(len(text), bool)
    body[end] = False
    text[body] = ranks
    del words, ranks
    text[body] += n
    text[end] = np.arange(n)  # separators differ, so that no common prefix goes beyond a segment
    sa, lcp = suffix_array(text)
    linked = lcp >= cfg.min_words
    head = np.flatnonzero(linked & ~np.concatenate([[False], linked[:-1]])) - 1  # a group starts one before its first link
    inside = linked.copy()
    inside[head] = True
    sa = sa[inside]
    group_start = np.flatnonzero(~linked[inside])
    if not len(sa):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    k = of[sa]
    place = start[k] + sa - first[k]
    d = doc[k]
    group = np.cumsum(~linked[inside]) - 1
    o = np.lexsort([place, d, group])
    least = o[group_start]  # groups keep their sizes
    src, at = d[least][group], place[least][group]
    ok = d != src
    return d[ok], place[ok], src[ok], at[ok]


def large_repeats(doc: np.ndarray, start: np.ndarray, path: str, count: np.ndarray, cfg: SuffixConfig, folder: X.Folder) -> Iterator[tuple[np.ndarray, ...]]:
    """shard_repeats() of words in a file, some at a time. Documents, places and sizes of segments are in memory, and a source for each repeated passage."""
    edge = np.concatenate([[0], np.cumsum(count)])

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        with folder.fs.open_input_stream(path, compression=None) as f:
            for a, b in C._slices(edge, 1 << 15):
                yield np.frombuffer(f.read(4 * int(edge[b] - edge[a])), np.uint32).astype(np.int64), np.arange(a, b), count[a:b]

    level = X.Level(blocks, len(doc), folder, cfg.memory)
    kind = np.dtype([("doc", "<i8"), ("place", "<i8"), ("group", "<i8")])
    stored, least, group, known, before = [], [], -1, -1, None  # least: (document, place) of each group's source; before: the suffix that a group may start with
    for r, _, lcp in X.suffixes_down(level, True):
        seg, at = r["id"] >> X._BITS, r["id"] & ((1 << X._BITS) - 1)
        d, p, linked = doc[seg], start[seg] + at, lcp >= cfg.min_words
        if before is not None:
            d, p, linked = np.append(before[0], d), np.append(before[1], p), np.append(before[2], linked)
        before = (d[-1], p[-1], linked[-1])
        d, p, inside, nxt = d[:-1], p[:-1], linked[:-1], linked[1:]  # of the last it isn't known yet whether it starts a group
        opens = ~inside & nxt
        keep = inside | nxt
        if keep.any():
            g = group + np.cumsum(opens)
            group = int(g[-1])
            out = np.zeros(int(keep.sum()), kind)
            out["doc"], out["place"], out["group"] = d[keep], p[keep], g[keep]
            o = np.lexsort([out["place"], out["doc"], out["group"]])
            x = out[o[np.concatenate([[True], np.diff(out["group"][o]) > 0])]]
            own = np.stack([x["doc"], x["place"]], 1)
            if least and x["group"][0] == known:  # the last group goes on
                least[-1][-1] = min(least[-1][-1].tolist(), own[0].tolist())
                own = own[1:]
            if len(own):
                least.append(own)
            known = group
            stored.append((folder.write(out), len(out)))
    if before is not None and before[2]:
        x = (int(before[0]), int(before[1]))
        least[-1][-1] = min(least[-1][-1].tolist(), list(x))
        stored.append((folder.write(np.array([(*x, group)], kind)), 1))
    source = np.concatenate(least) if least else np.zeros((0, 2), np.int64)
    for name, n in stored:
        with folder.fs.open_input_stream(name, compression=None) as f:
            x = np.frombuffer(f.read(n * kind.itemsize), kind)
        d, p, src, at = x["doc"], x["place"], *source[x["group"]].T
        ok = d != src
        yield d[ok], p[ok], src[ok], at[ok]


def _repeats(cfg: SuffixConfig, folder: str):
    """mapInArrow: a partition of (key, doc_id, start, words) is a shard."""

    def joined(d: np.ndarray, p: np.ndarray, s: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(d):
            o = np.lexsort([p, p - q, s, d])  # join what goes on along a diagonal, as far as this shard has it
            d, p, s, q = d[o], p[o], s[o], q[o]
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | ((p - q)[1:] != (p - q)[:-1]) | (p[1:] > p[:-1] + cfg.min_words)])
            i = np.flatnonzero(new)
            last = np.concatenate([i[1:], [len(d)]]) - 1
            for a in range(0, len(i), 1 << 16):
                x, y = i[a : a + (1 << 16)], last[a : a + (1 << 16)]
                yield C.batch_of(doc_id=d[x], start_word=p[x], end_word=p[y] + cfg.min_words, source_doc=s[x], source_start=q[x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, start, words, count, total = [], [], [], [], 0
        own, path, file = None, "", None
        try:
            for b in batches:
                if b.num_rows:
                    buf, off = C.raw(b.column("words").cast(pa.large_binary()))
                    words.append(buf[off[0] : off[-1]].view(np.uint32).copy())
                    count.append(np.diff(off) // 4)
                    doc.append(C.ids_of(b.column("doc_id")))
                    start.append(C.ids_of(b.column("start")))
                    total += len(words[-1])
                    if total * _WORD_BYTES > cfg.memory:
                        if file is None:
                            uri = f"{folder}/{uuid.uuid4().hex}"
                            fs, base = pafs.FileSystem.from_uri(uri)
                            fs.create_dir(base, recursive=True)
                            own = X.Folder(uri)
                            path = own.new()
                            file = own.fs.open_output_stream(path, compression=None)
                        for w in words:
                            file.write(w.tobytes())
                        words = []
            if not doc:
                return
            doc, start, count = (np.concatenate(x) for x in (doc, start, count))
            if file is None:
                yield from joined(*shard_repeats(doc, start, np.concatenate(words), count, cfg))
            else:
                file.close()
                for part in large_repeats(doc, start, path, count, cfg, own):
                    yield from joined(*part)
        finally:
            if own is not None:
                with contextlib.suppress(OSError):
                    own.fs.delete_dir(own.base)

    return run


def repeated_passages(docs: DataFrame, cfg: SuffixConfig = SuffixConfig()) -> DataFrame:
    """(doc_id, start_word, end_word, source_doc, source_start): passages of at least min_words words that a document
    of smaller doc_id has too, word for word. Places count words from 0, ends are exclusive."""
    spark = docs.sparkSession
    by_key = Window.partitionBy("key")
    by_seg = Window.partitionBy("key", "seg")
    t = segment_table(docs, cfg)
    t = t.withColumn("many", F.min("doc_id").over(by_key) < F.max("doc_id").over(by_key)).withColumn("kinds", F.min("seg").over(by_key) < F.max("seg").over(by_key)).where("many")
    t = C.durable(t.withColumn("lead", F.min(F.struct("doc_id", "place")).over(by_seg)).drop("many"), "segments")
    start, length = F.shiftright("place", 16), F.col("place").bitwiseAND(65535)
    same = t.where("doc_id <> lead.doc_id").select("doc_id", start.alias("start_word"), (start + length).alias("end_word"), F.col("lead.doc_id").alias("source_doc"), F.shiftright("lead.place", 16).alias("source_start"))
    leads = t.where("kinds AND doc_id = lead.doc_id AND place = lead.place").select("key", "seg", "doc_id", "place").distinct()
    leads = C.durable(leads, "leads")
    total = leads.agg(F.sum(length)).first()[0] or 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.table_slices(batches, "text", C.SLICE_BYTES):
            words, off = C.word_hashes(b.column("text"))
            short = (words >> np.uint64(32)).astype(np.uint32)
            per = b.column("parts")
            n = per.value_lengths().to_numpy(zero_copy_only=False)
            flat = per.flatten()
            place, row = C.ids_of(flat.field("place")), np.repeat(np.arange(b.num_rows), n)
            s, c = place >> 16, place & 65535
            fits = s + c <= np.diff(off)[row]  # rows of equal doc_id may have other texts
            row, s, c = row[fits], s[fits], c[fits]
            yield C.batch_of(key=C.ids_of(flat.field("key"))[fits], doc_id=C.ids_of(b.column("doc_id"))[row], start=s, words=C.binaries(short[C.expand(off[row] + s, c)], c))

    parts = C.lists(leads, "doc_id", F.struct("key", "place"), "parts")
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").join(C.growing(parts), "doc_id")
    pieces = texts.mapInArrow(cut, "key long, doc_id long, start long, words binary")
    shards = max(1, -(-total // cfg.shard_words))
    found = pieces.repartition(int(shards), "key").mapInArrow(_repeats(cfg, f"{C.scratch_dir(spark)}/runs-{uuid.uuid4().hex}"), "doc_id long, start_word long, end_word long, source_doc long, source_start long")
    every = C.durable(found, "found").unionByName(same).withColumn("d", F.col("start_word") - F.col("source_start"))
    line = Window.partitionBy("doc_id", "source_doc", "d").orderBy("start_word", "end_word")
    so_far = F.max("end_word").over(line.rowsBetween(Window.unboundedPreceding, -1))
    every = every.withColumn("new", F.when(F.col("start_word") <= so_far, 0).otherwise(1)).withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return every.groupBy("doc_id", "source_doc", "d", "run").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("source_start").alias("source_start")).select("doc_id", "start_word", "end_word", "source_doc", "source_start")
