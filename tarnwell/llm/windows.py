"""Passages that repeat in other documents, exactly or nearly, by compact windows of min-hashes.

The tokens of a document are its runs of `shingle` words. For each hash function, the node of the Cartesian tree
over the tokens' hash values that spans tokens l..r and has its root at c stands for all subsequences within l..r
that hold c: they share the minimum, so one compact window (l, c, r) stands for all of them. Only nodes that span
at least as many tokens as a passage has, `width`, are kept. A longer passage is a union of passages of just that
width, so that a window is cut at width - 1 tokens on either side of c; what is left are the runs of equal minima of
a sliding window of that width. They come out of a handful of vector operations, without a recursion
(cartesian_windows() builds the tree itself, for the tests). Windows of one value are joined by interval: those of
other documents that overlap along a diagonal. Diagonals on which `enough` of the hash functions agree are verified
word by word.

Windows of one value that are equal in all their words are one: the document that has it first stands for all, so
that a passage in n documents costs n rows. Of what differs, each window meets the first and the `partners` before it
at once. Where a value has more windows, other_lines() lets all the rest meet by their words: pairs with as many equal
words around the minimum as a near repeat of min_words has are candidates, and of windows that nearly repeat one and
the same earlier one, each is linked with that one instead of with each other.
Exact repeats are found by exact_lines() besides, whatever phrases they hold: the first function's windows of a value
are grouped by all their words, each meets the first of its group, and of the first ones every passage of min_words
words meets the first document that has it.

Defined results: rows with a null doc_id or text have no passages, and texts shorter than a passage neither; texts of
any length are cut whole; rows of equal doc_id count as one document (repeats within one document are not reported);
of equal passages the source is the smallest doc_id; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class WindowConfig:
    """min_words: shortest passage; functions: hash functions, of which `enough` must agree; partners: windows of a value that one meets besides the first; similarity: equal words of a near repeat."""

    min_words: int = 50
    shingle: int = 3
    functions: int = 10
    enough: int = 2
    partners: int = 3
    similarity: float = 0.8
    max_gap: int = 5
    seed: int = 5

    def __post_init__(self) -> None:
        if not (self.shingle <= self.min_words <= 254 and 0 < self.functions <= 62):
            raise ValueError("min_words must be from shingle to 254, functions from 1 to 62")

    @property
    def width(self) -> int:
        return self.min_words - self.shingle + 1


def _keys(cfg: WindowConfig) -> np.ndarray:
    return np.random.default_rng(cfg.seed).integers(1, 1 << 63, (cfg.functions, 2), np.int64).astype(np.uint64)


def order_values(sh: np.ndarray, f: int, cfg: WindowConfig) -> np.ndarray:
    """32 bits of hash function f above the position, so that equal hashes are ordered from the left."""
    a, b = _keys(cfg)[f]
    return (((sh ^ b) * (a | np.uint64(1))) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(sh), dtype=np.uint64)


def sliding_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Minima of v[i : i + width], by doubling."""
    m, have = v, 1
    while 2 * have <= width:
        m, have = np.minimum(m[:-have], m[have:]), 2 * have
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def compact_windows(sh: np.ndarray, to: np.ndarray, cfg: WindowConfig, functions: Iterable[int] | None = None) -> tuple[np.ndarray, ...]:
    """(function, document, l, c, r) of all compact windows of at least width tokens, cut around c; positions within sh."""
    t = cfg.width
    if len(sh) < t:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    doc = np.repeat(np.arange(len(to) - 1), np.diff(to))
    inside = doc[: len(sh) - t + 1] == doc[t - 1 :]
    out = []
    for f in range(cfg.functions) if functions is None else functions:
        m = sliding_minimum(order_values(sh, f, cfg), t)[inside]
        start = np.flatnonzero(inside)
        if not len(m):
            continue
        new = np.concatenate([[True], (m[1:] != m[:-1])])  # positions are part of m, so documents never run together
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(m)]]) - 1
        left = start[first]
        out.append((np.full(len(first), f), doc[left], left, (m[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), start[last] + t - 1))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def cartesian_windows(values: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(l, c, r) of the nodes of the Cartesian tree that span at least width tokens, by its definition."""
    left, right, stack = [0] * len(values), [len(values) - 1] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = i - 1
        left[i] = stack[-1] + 1 if stack else 0
        stack.append(i)
    return [(a, c, b) for c, (a, b) in enumerate(zip(left, right, strict=True)) if b - a + 1 >= width]


def window_table(docs: DataFrame, cfg: WindowConfig) -> DataFrame:
    """(key, whole, doc_id, at): value of the minimum, 32 bits of a hash of all the window's words (of those with one value), and c, c - l, r - c and the function packed in one integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.table_slices(batches, "text", C.SLICE_BYTES):
            words, off = C.word_hashes(b.column("text"))
            sh, to = C.shingles(words, off, cfg.shingle)
            ids = C.ids_of(b.column("doc_id"))
            for f in range(cfg.functions):
                _, d, left, c, right = compact_windows(sh, to, cfg, (f,))
                if len(d):
                    key = C.mix(sh[c] + C.mix(np.full(1, f + 1 + cfg.seed, np.uint64)))
                    shift = off[d] - to[d]
                    whole = _run_hashes(words, left + shift, right + shift + cfg.shingle)
                    row = {"key": key.view(np.int64), "whole": (whole >> np.uint64(32)).astype(np.uint32).view(np.int32), "doc_id": ids[d], "at": ((c - to[d]) << 24) | ((c - left) << 16) | ((right - c) << 8) | f}
                    o, first = _first_of_equal(row["key"], row["whole"], row["doc_id"], row["at"])
                    keep = np.sort(o[first])  # documents stay in their order, which a shuffle compresses
                    yield C.batch_of(**{k: v[keep] for k, v in row.items()})  # the same before the shuffle that candidate_lines() does after it

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "key long, whole int, doc_id long, at long")


def _first_of_equal(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by the columns, flags in that order of the first of each pair of the first two)."""
    o = np.lexsort(columns[::-1])
    a, b = columns[0][o], columns[1][o]
    return o, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(o) else np.zeros(0, bool)


def _met_here(group: np.ndarray, within: np.ndarray, doc: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(group, od, ol): rows whose (group, within) a smaller document of the same slice has meet that one, od at ol, and leave the group, so that hot ones become small."""
    o, first = _first_of_equal(group, within, doc, left)
    head = o[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(o) else o
    of = np.empty(len(o), np.int64)
    of[o] = head
    met = doc[of] < doc
    own = C.mix(doc.view(np.uint64) + C.mix(left.view(np.uint64) + C.mix(group.view(np.uint64)))).view(np.int64)
    return np.where(met, own, group), pa.array(doc[of], mask=~met), pa.array(left[of], mask=~met)


def _run_hashes(words: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the words s..e-1 of each run."""
    p, inv = C.powers(len(words) + 1)
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * p[: len(words)], dtype=np.uint64)])
    return C.mix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64))


def exact_lines(docs: DataFrame, cfg: WindowConfig) -> DataFrame:
    """(a, b, d, lo, hi, f): a line, with all functions set, for every passage of min_words words that is in an earlier document.

    Equal passages have the same minimum of the first function. Windows of a value that are equal as a whole meet the
    first of them; only that document's are cut into passages.
    """
    one, every = replace(cfg, functions=1), (1 << cfg.functions) - 1

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.table_slices(batches, "text", C.SLICE_BYTES):
            words, off = C.word_hashes(b.column("text"))
            sh, to = C.shingles(words, off, cfg.shingle)
            _, d, left, c, right = compact_windows(sh, to, one)
            if len(d):
                shift = off[d] - to[d]
                h = _run_hashes(words, left + shift, right + shift + cfg.shingle).view(np.int64)
                ids, at = C.ids_of(b.column("doc_id"))[d], left - to[d]
                key, od, ol = _met_here(C.mix(sh[c]).view(np.int64), h, ids, at)
                yield C.batch_of(key=key, whole=h, doc_id=ids, l=at, r=right - to[d], od=od, ol=ol)

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.table_slices(batches, "text", C.SLICE_BYTES):
            words, off = C.word_hashes(b.column("text"))
            per = b.column("parts")
            flat = per.flatten()
            row = np.repeat(np.arange(b.num_rows), per.value_lengths().to_numpy(zero_copy_only=False))
            left, right = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("l", "r"))
            count = np.maximum(np.minimum(right - cfg.width + 1, np.diff(off)[row] - cfg.min_words) - left + 1, 0)
            at = np.unique(C.expand(off[row] + left, count))
            doc = np.searchsorted(off[1:], at, "right")
            h = _run_hashes(words, at, at + cfg.min_words).view(np.int64)
            ids, at = C.ids_of(b.column("doc_id"))[doc], at - off[doc]
            key, od, ol = _met_here(h, h, ids, at)
            for i in range(0, len(at), 1 << 18):
                j = slice(i, i + (1 << 18))
                yield C.batch_of(h=key[j], doc_id=ids[j], l=at[j], od=od.slice(i, 1 << 18), ol=ol.slice(i, 1 << 18))

    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    value, group = Window.partitionBy("key"), Window.partitionBy("key", "whole")
    here = F.when(F.col("od").isNotNull(), F.struct(F.col("od").alias("doc_id"), F.col("ol").alias("l")))
    t = texts.mapInArrow(whole, "key long, whole long, doc_id long, l long, r long, od long, ol long").repartition("key")
    t = t.withColumn("o", F.coalesce(here, F.min(F.struct("doc_id", "l")).over(group)))
    t = t.withColumns({"few": F.min("doc_id").over(value) == F.max("doc_id").over(value), "alike": F.min("whole").over(value) == F.max("whole").over(value)})
    shared = C.durable(t.where("od IS NOT NULL OR (NOT few AND (doc_id <> o.doc_id OR NOT alike))").select("doc_id", "l", "r", "o"), "shared")
    firsts = C.lists(shared.where("doc_id = o.doc_id"), "doc_id", F.struct("l", "r"), "parts")
    p = texts.join(C.growing(firsts), "doc_id").mapInArrow(passages, "h long, doc_id long, l long, od long, ol long")
    p = p.withColumn("o", F.coalesce(here, F.min(F.struct("doc_id", "l")).over(Window.partitionBy("h")))).withColumn("r", F.expr(f"l + {cfg.width - 1}"))
    met = shared.unionByName(p.select("doc_id", "l", "r", "o")).where("doc_id > o.doc_id")
    lines = met.groupBy(F.col("o.doc_id").alias("a"), F.col("doc_id").alias("b"), F.expr("l - o.l").alias("d")).agg(F.min("l").alias("lo"), F.max("r").alias("hi"), F.lit(every).cast("long").alias("f"))
    exact = C.durable(lines, "exact")
    C.drop_durable(shared)
    return exact


def candidate_lines(windows: DataFrame, cfg: WindowConfig, exact: DataFrame | None = None) -> DataFrame:
    """(a, b, d, lo, hi): diagonals d of pairs a < b on which enough functions agree, with the tokens lo..hi in b; those of exact_lines() among them."""
    same = Window.partitionBy("key", "whole").orderBy("doc_id", "at")
    before = Window.partitionBy("key").orderBy("doc_id", "at")
    one = F.struct("doc_id", "at")
    met = windows.repartition("key").withColumn("copy", F.lag("doc_id").over(same)).where("copy IS NULL")  # of windows that are equal as a whole the first
    met = met.withColumns({"x": F.first(one).over(before), "y": F.collect_list(one).over(before.rowsBetween(-cfg.partners, -1))})
    met = met.where("size(y) > 0").select("doc_id", "at", F.explode(F.array_distinct(F.array_append("y", F.col("x")))).alias("o"))
    place, left, right, function = (lambda c, k=k: F.shiftright(c, k).bitwiseAND(255) if k < 24 else F.shiftright(c, k) for k in (24, 16, 8, 0))
    met = met.where("doc_id > o.doc_id").select(F.col("o.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("at"), F.col("o.at").alias("other"))
    met = met.select("a", "b", (place("at") - place("other")).alias("d"), (place("at") - F.least(left("at"), left("other"))).alias("lo"), (place("at") + F.least(right("at"), right("other"))).alias("hi"), F.expr("shiftleft(1L, cast(at & 255 AS int))").alias("f"))
    met = met.where(f"hi - lo + 1 >= {cfg.width // 2}")  # the roots are on the diagonal, so that what both windows hold is around them
    met = met if exact is None else met.unionByName(exact)
    lines = met.groupBy("a", "b", "d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("f").alias("f"))
    return lines.where(f"bit_count(f) >= {cfg.enough}").select("a", "b", "d", "lo", "hi")


def hot_windows(windows: DataFrame, cfg: WindowConfig) -> DataFrame:
    """(key, n, doc_id, at): the different windows of the values that have more of them than all meet in candidate_lines()."""
    same, value = Window.partitionBy("key", "whole").orderBy("doc_id", "at"), Window.partitionBy("key")
    t = windows.repartition("key").withColumn("copy", F.lag("doc_id").over(same)).where("copy IS NULL")
    t = t.withColumns({"n": F.count("*").over(value), "few": F.min("doc_id").over(value) == F.max("doc_id").over(value)})
    return t.where(f"n > {cfg.partners + 2} AND NOT few").select("key", "n", "doc_id", "at")


def _pairs(start: np.ndarray, count: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): each i with start[i], start[i] + 1, ... count[i] of them, about `most` pairs at once."""
    total, i = np.concatenate([[0], np.cumsum(count)]), 0
    while i < len(count):
        e = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        if total[e] > total[i]:
            yield np.repeat(np.arange(i, e), count[i:e]), C.expand(start[i:e], count[i:e])
        i = e


def _runs_around(x: np.ndarray, y: np.ndarray, cfg: WindowConfig) -> np.ndarray:
    """Flags of the rows of bytes, 0 being none, that have a passage in common."""
    out, same = np.zeros(len(x), bool), (x == y) & (x > 0)
    out[matching_runs(same.ravel(), np.arange(len(x) + 1) * x.shape[1], cfg)[0]] = True
    return out


def _met_around(x: np.ndarray, y: np.ndarray, cfg: WindowConfig) -> tuple[np.ndarray, np.ndarray]:
    """(near, sure): flags of the rows of bytes, 0 being none, that may have a passage in common, and of those that have; x may be one row.

    May have: a run of min_words with no gap above max_gap that holds similarity * min_words equal bytes. A passage
    spans the middle byte, so that both sides of it are integers of one bit a byte, where these are few enough.
    """
    need, same = int(np.ceil(cfg.similarity * cfg.min_words)), x == y
    same &= x > 0
    mid = x.shape[1] // 2
    near, sure = np.zeros(len(same), bool), np.zeros(len(same), bool)
    bits = same[:, mid] if 2 * cfg.min_words >= x.shape[1] and mid < 52 and mid + cfg.max_gap < 63 else np.zeros(len(same), bool)
    plain = np.flatnonzero(~bits)
    plain = plain[same[plain].sum(1) >= need]
    if len(plain):
        x, y = np.broadcast_arrays(x, y)
        x, y = x[plain], y[plain]
        near[plain] = _runs_around(x, y, replace(cfg, similarity=0.0))
        sure[plain] = _runs_around(x, y, cfg)
    at = np.flatnonzero(bits)
    length, count, whole = (np.full(len(at), -1, np.int64) for _ in range(3))
    one = np.uint64(1)
    for side in (same[:, mid:], same[:, mid::-1]):
        packed = np.zeros((len(at), 8), np.uint8)
        packed[:, : mid // 8 + 1] = np.packbits(side if len(at) == len(same) else side[at], axis=1, bitorder="little")[:, : mid // 8 + 1]
        r = packed.view(np.uint64).ravel()
        gap = ~r
        for k in range(1, cfg.max_gap + 1):
            gap = gap & (~r >> np.uint64(k))
        held = r & ((gap & (~gap + one)) - one)
        length += np.frexp(held.astype(np.float64))[1]
        count += np.bitwise_count(held)
        whole += np.bitwise_count(r & ~(r + one))
    near[at] = (length >= cfg.min_words) & (count >= need)
    sure[at] = near[at] & ((count >= cfg.similarity * length) | (whole >= cfg.min_words))
    return near, sure


def word_runs(words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the run of equal words that each word is in; the documents begin at off, where runs end."""
    head = np.ones(len(words), bool)
    head[1:] = words[1:] != words[:-1]
    head[off[:-1][np.diff(off) > 0]] = True
    start = np.flatnonzero(head)
    end = np.append(start, len(words))[1:]
    return np.repeat(start, end - start), np.repeat(end, end - start)


def inner_rows(new: np.ndarray, c: np.ndarray, cfg: WindowConfig) -> np.ndarray:
    """Flags of the rows but for the first and the last of those of one document at places c in a row, in pieces of up to width; new: where another document or group begins.

    Windows of one value at places in a row are in a run of one word. Where such pieces of two documents meet along a
    diagonal, all words between the first pair of places and the last are equal, and one of each of these pairs is
    the first or last row of its piece. A passage of min_words on that diagonal that holds the minimum at any place
    is within the words around the first or around the last. So all is found if one row of a pair isn't inner.
    """
    head = new | np.concatenate([[True], c[1:] != c[:-1] + 1])
    at = np.arange(len(c)) - np.flatnonzero(head)[np.cumsum(head) - 1]
    head |= at % cfg.width == 0
    return ~head & ~np.append(head[1:], True)


def run_sides(around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes right and left of the middle one are equal to it without another in between."""
    mid = around.shape[1] // 2
    same, other = around == around[:, mid : mid + 1], np.zeros((len(around), 1), bool)
    right, left = (np.argmin(np.concatenate([x, other], 1), 1) - 1 for x in (same[:, mid:], same[:, mid::-1]))
    return right, left


def _beyond_runs(around: np.ndarray, sides: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray, cfg: WindowConfig) -> np.ndarray:
    """Flags of the pairs of rows in runs of one word that have more in common than the run: an equal byte within max_gap of where one of the runs ends."""
    mid, found = around.shape[1] // 2, np.zeros(len(i), bool)
    for side, step in zip(sides, (1, -1), strict=True):
        for k in range(1, cfg.max_gap + 2):
            at = mid + step * (np.minimum(side[i], side[j]) + k)
            ok = (at >= 0) & (at < around.shape[1])
            x = around[i, np.where(ok, at, mid)]
            found |= ok & (x > 0) & (x == around[j, np.where(ok, at, mid)])
    return found


def _meet_beyond_runs(at: int, around: np.ndarray, doc: np.ndarray, run: np.ndarray, second: np.ndarray, inner: np.ndarray, cfg: WindowConfig, meet: Callable, tile: int = 64) -> None:
    """Lets the pairs of rows in runs meet that _beyond_runs() flags, from the row that isn't inner and whose run ends first."""
    r, mid, span = np.flatnonzero(run), around.shape[1] // 2, around.shape[1]
    y, docs, kind, ends = np.ascontiguousarray(around[r].T), doc[r], second[r], ~inner[r]
    for side, step in zip(run_sides(around[r]), (1, -1), strict=True):
        beyond = mid + step * (side + 1)
        for first in np.unique(beyond[ends & (beyond >= 0) & (beyond < span)]):
            p = np.flatnonzero(ends & (beyond == first))
            for t in range(0, len(p), tile):
                i = p[t : t + tile]
                open_ = np.zeros((len(i), len(r)), bool)
                for k in range(first, first + step * (cfg.max_gap + 1), step):
                    if 0 <= k < span:
                        open_ |= (y[k][i, None] == y[k]) & (y[k][i, None] > 0)
                open_ &= (docs[i, None] != docs) & (side[i, None] <= side)
                if kind.any():
                    open_ &= kind[i, None] != kind
                a, b = np.nonzero(open_)
                meet(at + r[np.minimum(i[a], b)], at + r[np.maximum(i[a], b)])


def alike_around(group: np.ndarray, around: np.ndarray, doc: np.ndarray, cfg: WindowConfig, small: int = 48, classes: bool = True, run: np.ndarray | None = None, second: np.ndarray | None = None, inner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(p, q): rows of one group (these are in order) and different documents that are alike in around, bytes of which 0 is none.

    Alike: equal bytes over min_words without a gap above max_gap, similarity * min_words of them at least, as any near
    repeat there has. In groups above `small` pairs are counted by matrices: of three bits a byte at least as many are
    equal as of the bytes, so that nothing is lost, and what has enough of them is compared. classes: rows that nearly
    repeat one and the same earlier row are linked with that one alone. run: rows in a run of one word that is a
    passage by itself; these have it in common and meet each other only where more than the run is alike. second: where a group has rows of both
    kinds, those of one kind (which come first) meet those of the other only. inner: rows that lie between others in
    a run of one word, as inner_rows() has them; in large groups they meet what isn't inner only.
    """
    n, found, held = len(group), [np.zeros(0, np.int64)], 0
    run, second, inner = (np.zeros(n, bool) if x is None else x for x in (run, second, inner))
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.concatenate([head, [n]]))
    first, end, size = np.repeat(head, count), np.repeat(head + count, count), np.repeat(count, count)
    leader = np.arange(n)
    two = np.maximum.reduceat(second, head) if n else np.zeros(1, bool)
    few, sides = (size <= small) & ~np.repeat(two, count), run_sides(around)

    def meet(i: np.ndarray, j: np.ndarray, keep: bool = True) -> np.ndarray:
        nonlocal found, held
        sure = np.zeros(len(j), bool)
        for s in range(0, len(j), 1 << 15):
            x, y = i if len(i) == 1 else i[s : s + (1 << 15)], j[s : s + (1 << 15)]  # one row with many, or pair by pair
            near, sure[s : s + (1 << 15)] = _met_around(around[x], around[y], cfg)
            if keep:
                found.append(((x if len(i) == 1 else x[near]) << 32) | y[near])
                held += len(found[-1])
        if held > 1 << 21:
            found, held = [np.unique(np.concatenate(found))], 0
        return sure

    if classes:
        j = np.flatnonzero((first < np.arange(n)) & few & (doc != doc[first]) & ~(run & run[first]))
        sure = meet(first[j], j)
        leader[j[sure]] = first[j[sure]]
    for i, j in _pairs(np.arange(n) + 1, np.where(few, end - np.arange(n) - 1, 0)):
        ok = (doc[i] != doc[j]) & (leader[i] != leader[j])
        both = np.flatnonzero(ok & run[i] & run[j])
        ok[both] = _beyond_runs(around, sides, i[both], j[both], cfg)
        meet(i[ok], j[ok])
    for s, k, both in zip(head, count, two, strict=True):
        if both or k > small:
            _meet_by_counts(int(s), around[s : s + k], doc[s : s + k], run[s : s + k], second[s : s + k], inner[s : s + k], cfg, meet, classes)
    both = np.unique(np.concatenate(found))
    return both >> 32, both & 0xFFFFFFFF


def _meet_by_counts(at: int, around: np.ndarray, doc: np.ndarray, run: np.ndarray, second: np.ndarray, inner: np.ndarray, cfg: WindowConfig, meet: Callable, classes: bool) -> None:
    """Lets all pairs of the rows, which begin at `at`, meet that may have enough equal bytes, but for those that earlier rows link, or nothing but a run of one word."""
    n, width = len(around), around.shape[1]
    x = np.zeros((n, width, 8), np.float32)
    np.put_along_axis(x, (around & 7).astype(np.int64)[:, :, None], (around > 0)[:, :, None].astype(np.float32), 2)
    x = x.reshape(n, -1)
    rows = lambda *of: np.concatenate([np.flatnonzero(f) for f in of])
    free, ends = ~run, ~inner
    if second.any():
        pairs = [(~second & free & ends, second), (second & ends, ~second & free & inner), (~second & run & ends, second & free), (second & free & ends, ~second & run & inner)]
        pairs = [(rows(p), rows(q)) for p, q in pairs]
    else:
        pairs = [(rows(free & ends), rows(free & ends, free & inner, run)), (rows(run & ends), rows(free & inner))]
    for p, q in pairs:
        _meet_others(at, x, doc, p, q, cfg, meet, classes)
    _meet_beyond_runs(at, around, doc, run, second, inner, cfg, meet)


def _meet_others(at: int, x: np.ndarray, doc: np.ndarray, p: np.ndarray, q: np.ndarray, cfg: WindowConfig, meet: Callable, classes: bool, tile: int = 512, many: int = 32) -> None:
    """The rows p of _meet_by_counts() with the rows q; where q begins with the rows p, each pair once."""
    need, one, apart = int(np.ceil(cfg.similarity * cfg.min_words)), len(p) > 0 and len(q) > 0 and p[0] == q[0], len(p)
    if not len(p) or not len(q):
        return
    order = q if one else np.concatenate([p, q])  # leaders link rows of both
    y, docs = x[q], doc[order]
    led, leaders = np.zeros((len(order), 64), np.float32), 0  # rows by the leaders they nearly repeat
    for t in range(0, len(p), tile):
        rows, u = min(tile, len(p) - t), t if one else 0  # row k of the tile is order[t + k], column j is order[b + j]
        b = t if one else apart
        open_ = (y[t : t + rows] if one else x[p[t : t + rows]]) @ y[u:].T >= need
        open_ &= docs[t : t + rows, None] != docs[None, b:]
        if one:
            open_[:, :rows] &= np.triu(np.ones((rows, rows), bool), 1)
        if leaders:
            open_ &= led[t : t + rows, :leaders] @ led[b:, :leaders].T == 0
        for k in np.flatnonzero(open_.sum(1) >= many) if classes else ():
            j = np.flatnonzero(open_[k])
            if len(j) < many:
                continue
            own = b + j[meet(at + order[t + k : t + k + 1], at + order[b + j])]
            open_[k] = False
            if not one and len(own):  # which of its own kind it links is known, or known of an earlier one
                i = np.arange(t + k + 1, apart)
                i = i[docs[i] != docs[t + k]]
                own = np.concatenate([i[meet(at + order[t + k : t + k + 1], at + order[i], False)], own])
            own = own[docs[own] > docs[t + k]]
            if len(own) > 1:
                if leaders == led.shape[1]:
                    led = np.concatenate([led, np.zeros_like(led)], 1)
                led[own, leaders] = 1
                leaders += 1
                rest = np.ones(len(order) - b, bool)
                rest[own[own >= b] - b] = False
                open_[own[(own >= t) & (own < t + rows)] - t] &= rest
        i, j = np.nonzero(open_)
        meet(at + order[t + i], at + order[b + j])


def other_lines(docs: DataFrame, hot: DataFrame, cfg: WindowConfig, block: int = 4096) -> DataFrame:
    """(a, b, d, lo, hi, f): lines, with all functions set, for pairs of hot_windows() of one value that are alike around the minimum.

    A byte of each word's hash travels. A value's windows are cut into blocks, all pairs of which meet. Two windows in
    runs of min_words or more of the value's one word don't if nothing beyond the shorter run is alike near it: exact_lines()
    links both with the first document of such a run.
    """
    reach, every = cfg.width - 1, (1 << cfg.functions) - 1
    span = 2 * reach + cfg.shingle

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.table_slices(batches, "text", C.SLICE_BYTES):
            words, off = C.word_hashes(b.column("text"))
            short = np.concatenate([((words >> np.uint64(48)) % np.uint64(255) + np.uint64(1)).astype(np.uint8), np.zeros(1, np.uint8)])
            start, end = word_runs(words, off)
            per = b.column("parts")
            flat = per.flatten()
            key, n, at = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "at"))
            row = np.repeat(np.arange(b.num_rows), per.value_lengths().to_numpy(zero_copy_only=False))
            ids, c = C.ids_of(b.column("doc_id"))[row], at >> 24
            for i in range(0, len(row), 4096):
                j = slice(i, i + 4096)
                w = c[j, None] - reach + np.arange(span)
                inside = (w >= 0) & (w < np.diff(off)[row[j], None])
                around = short[np.where(inside, w + off[row[j], None], len(words))]
                first = c[j] + off[row[j]]
                run = (end[first] >= first + cfg.shingle) & (end[first] - start[first] >= cfg.min_words)  # all words of the minimum are in it
                yield C.batch_of(key=key[j], n=n[j], doc_id=ids[j], c=c[j], run=run, around=C.binaries(around.ravel(), np.full(len(around), span)))

    def lines_of(t: pa.Table) -> pa.RecordBatch:
        key, i, j, doc, c, run, second = (t.column(k).to_numpy() for k in ("key", "i", "j", "doc_id", "c", "run", "second"))
        around = np.frombuffer(b"".join(t.column("around").to_pylist()), np.uint8).reshape(-1, span)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        group, new[1:] = np.cumsum(new), new[1:] | (doc[1:] != doc[:-1]) | (second[1:] != second[:-1])
        p, q = alike_around(group, around, doc, cfg, run=run, second=second, inner=inner_rows(new, c, cfg))
        a, b = np.where(doc[p] < doc[q], p, q), np.where(doc[p] < doc[q], q, p)
        d, lo = c[b] - c[a], c[b] - np.minimum(reach, np.minimum(c[a], c[b]))
        o = np.lexsort([d, doc[b], doc[a]])  # windows along a run meet on few diagonals
        a, b, d, lo = a[o], b[o], d[o], lo[o]
        new = np.flatnonzero(np.concatenate([[True], (doc[a[1:]] != doc[a[:-1]]) | (doc[b[1:]] != doc[b[:-1]]) | (d[1:] != d[:-1])])) if len(o) else o
        least, most = (np.minimum.reduceat(lo, new), np.maximum.reduceat(c[b], new) + reach) if len(o) else (lo, lo)
        return C.batch_of(a=doc[a[new]], b=doc[b[new]], d=d[new], lo=least, hi=most, f=np.full(len(new), every, np.int64))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # whole groups are compared, many at once
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size >= block:
                t = pa.Table.from_batches(held).combine_chunks()
                g = np.stack([t.column(k).to_numpy() for k in ("key", "i", "j")])
                cut = np.flatnonzero((g[:, 1:] != g[:, :-1]).any(0))
                if len(cut):
                    yield lines_of(t.slice(0, int(cut[-1]) + 1))
                    t = t.slice(int(cut[-1]) + 1)
                held, size = t.to_batches(), t.num_rows
        if size:
            yield lines_of(pa.Table.from_batches(held).combine_chunks())

    wanted = C.lists(hot, "doc_id", F.struct("key", "n", "at"), "parts")
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").join(C.growing(wanted), "doc_id")
    t = texts.mapInArrow(slices, "key long, n long, doc_id long, c long, run boolean, around binary")
    t = t.withColumn("k", F.ceil(F.col("n") / block)).withColumn("part", F.expr("pmod(xxhash64(doc_id, shiftright(c, 12)), k)")).withColumn("other", F.explode(F.expr("sequence(0L, k - 1)")))
    t = t.selectExpr("key", "least(part, other) AS i", "greatest(part, other) AS j", "part > other AS second", "doc_id", "c", "run", "around")
    return t.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "second", "doc_id", "c").mapInArrow(compare, "a long, b long, d long, lo long, hi long, f long")


def matching_runs(same: np.ndarray, off: np.ndarray, cfg: WindowConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, start, end) of the passages along lines of compared words, line i being same[off[i]:off[i + 1]].

    A passage is a run of equal words with gaps of at most max_gap, long and similar enough; of a run that isn't
    similar enough, its parts without gaps are.
    """
    head = np.zeros(len(same) + 1, bool)
    head[off] = True
    equal = np.concatenate([[False], same, [False]])
    s = np.flatnonzero(same & (~equal[:-2] | head[:-1]))
    e = np.flatnonzero(same & (~equal[2:] | head[1:])) + 1
    if not len(s):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    line = np.searchsorted(off, s, "right") - 1
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (s[1:] - e[:-1] > cfg.max_gap)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(s)]]) - 1
    total = np.concatenate([[0], np.cumsum(e - s)])
    n = e[last] - s[first]
    near = (n >= cfg.min_words) & (total[last + 1] - total[first] >= cfg.similarity * n)
    part = np.flatnonzero((e - s >= cfg.min_words) & ~near[np.cumsum(new) - 1])
    line, s, e = np.concatenate([line[first[near]], line[part]]), np.concatenate([s[first[near]], s[part]]), np.concatenate([e[last[near]], e[part]])
    o = np.lexsort([s, line])
    return line[o], s[o] - off[line[o]], e[o] - off[line[o]]


def verified_passages(docs: DataFrame, lines: DataFrame, cfg: WindowConfig) -> DataFrame:
    """The passages of candidate_lines(), compared word by word (16 bits of each word's hash travel)."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.table_slices(batches, "text", C.SLICE_BYTES):
            words, off = C.word_hashes(b.column("text"))
            short = (words >> np.uint64(48)).astype(np.uint16)
            per = b.column("parts")
            flat = per.flatten()
            col = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "second", "d", "lo", "hi")}
            row = np.repeat(np.arange(b.num_rows), per.value_lengths().to_numpy(zero_copy_only=False))
            shift = np.where(col["second"], 0, col["d"])
            start = np.maximum(col["lo"] - shift, 0)
            end = np.minimum(col["hi"] - shift + cfg.shingle, np.diff(off)[row])
            count = np.maximum(end - start, 0)
            take = C.expand(off[row] + start, count)
            for i in range(0, len(row), 2048):  # one passage may be in many pairs
                j = slice(i, i + 2048)
                lo = int(count[:i].sum())
                yield C.batch_of(a=col["a"][j], b=col["b"][j], second=col["second"][j], d=col["d"][j], lo=col["lo"][j], words=C.binaries(short[take[lo : lo + int(count[j].sum())]], count[j]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                (x, xo), (y, yo) = (C.raw(part.column(c).cast(pa.large_binary())) for c in ("x", "y"))
                n = np.minimum(np.diff(xo), np.diff(yo)) // 2
                x, y = (np.frombuffer(v[o[0] : o[-1]].tobytes(), np.uint16)[C.expand((o[:-1] - o[0]) // 2, n)] for v, o in ((x, xo), (y, yo)))
                same, off = x == y, np.concatenate([[0], np.cumsum(n)])
                line, s, e = matching_runs(same, off, cfg)
                if len(line):
                    equal = np.concatenate([[0], np.cumsum(same)])
                    a, c, d, lo = (C.ids_of(part.column(k))[line] for k in ("a", "b", "d", "lo"))
                    yield C.batch_of(doc_id=c, start_word=lo + s, end_word=lo + e, source_doc=a, source_start=lo - d + s, source_end=lo - d + e, similarity=(equal[off[line] + e] - equal[off[line] + s]) / (e - s))

    part = lambda doc, second: F.struct(F.col(doc).alias("doc_id"), F.struct("a", "b", F.lit(second).alias("second"), "d", "lo", "hi").alias("p"))
    ends = C.lists(lines.select(F.explode(F.array(part("a", False), part("b", True))).alias("e")).select("e.*"), "doc_id", F.col("p"), "parts")
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").join(C.growing(ends), "doc_id")
    cut = texts.mapInArrow(slices, "a long, b long, second boolean, d long, lo long, words binary")
    of = lambda second: F.min(F.when(F.col("second") == second, F.col("words")))
    both = cut.groupBy("a", "b", "d", "lo").agg(of(False).alias("x"), of(True).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return both.mapInArrow(compare, "doc_id long, start_word long, end_word long, source_doc long, source_start long, source_end long, similarity double")


def repeated_passages(docs: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """(doc_id, start_word, end_word, source_doc, source_start, source_end, similarity): passages of at least
    min_words words that are in an earlier document too, with their place there. Places count words from 0."""
    exact = exact_lines(docs, cfg)
    hot = C.durable(hot_windows(window_table(docs, cfg), cfg), "hot")
    others = C.durable(other_lines(docs, hot, cfg), "others")
    C.drop_durable(hot)
    lines = C.durable(candidate_lines(window_table(docs, cfg), cfg, exact.unionByName(others)), "lines")
    C.drop_durable(exact, others)
    return verified_passages(docs, lines, cfg).distinct()
