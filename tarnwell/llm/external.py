"""Induced sorting of segments that are larger than memory: everything that is as long as the text lies in files.

The text is a set of segments, each of which ends with a separator of its own, smaller than all other symbols. What is
sorted are records. A suffix that ends a run (an LMS suffix, or a separator) has a record that carries the symbols
before it, down to the LMS suffix before; a disk-backed priority queue passes the records on, one symbol further to the
left each time, first through all L suffixes and then, in the other direction, through all S suffixes. So nothing is
ever looked up by position. The order of the LMS suffixes comes from recursion: a first induction sorts the LMS
substrings, which are named and sorted back into the order of the text, and the segments of names, at most half as
long, are sorted in the same way, until what is left fits in memory.

Common prefixes are carried along: of two neighbours that were induced it is 1 more than the least of those between
the records that induced them; where L and S meet, the shorter run of the first symbol. Those of the LMS suffixes are
found as their records, with the words after them, come out of the sort by rank.

In memory are: a queue's or sorter's records up to `memory` bytes, a block of each run of a merge, and five bytes for
each suffix of the pass at hand, for minima of ranges of common prefixes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow.fs as pafs

from .induced import RangeMin, suffix_array

#: Bits of a place in its segment.
_BITS = 10
_BLOCK = 1 << 14
Blocks = Callable[[], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


class Folder:
    """Files of records in a folder of the shared file system."""

    def __init__(self, uri: str) -> None:
        self.fs, self.base = pafs.FileSystem.from_uri(uri)
        self.written = 0

    def new(self) -> str:
        return f"{self.base}/{uuid.uuid4().hex}"

    def write(self, records: np.ndarray) -> str:
        name = self.new()
        with self.fs.open_output_stream(name, compression=None) as f:
            f.write(np.ascontiguousarray(records).view(np.uint8).tobytes())
        self.written += len(records)
        return name


class _Run:
    """A sorted run: records in memory, and those that are still in a file."""

    def __init__(self, records: np.ndarray, folder: Folder | None = None, name: str = "", rest: int = 0) -> None:
        self.records, self.at, self.rest, self.folder, self.name = records, 0, rest, folder, name
        self.file: Any = folder.fs.open_input_stream(name, compression=None) if folder else None

    def __len__(self) -> int:
        return len(self.records) - self.at + self.rest

    def head(self, n: int) -> np.ndarray:
        while self.rest and len(self.records) - self.at < n:
            k = min(self.rest, n)
            new = np.frombuffer(self.file.read(k * self.records.dtype.itemsize), self.records.dtype)
            self.records, self.at, self.rest = np.concatenate([self.records[self.at :], new]), 0, self.rest - k
            if not self.rest:
                self.file.close()
                self.folder.fs.delete_file(self.name)
        return self.records[self.at : self.at + n]


class Queue:
    """Records taken by their key and, among equal keys, in the order they came. Beyond `memory` bytes they are in files."""

    def __init__(self, dtype: np.dtype, folder: Folder, memory: int) -> None:
        self.dtype, self.folder, self.most = dtype, folder, max(1024, memory // dtype.itemsize)
        self.disk: list[_Run] = []
        self.runs: list[_Run] = []

    def push(self, records: np.ndarray) -> None:
        if not len(records):
            return
        self.runs.append(_Run(records[np.argsort(records["key"], kind="stable")]))
        while len(self.runs) > 1 and 2 * len(self.runs[-1]) >= len(self.runs[-2]) and 8 * (len(self.runs[-1]) + len(self.runs[-2])) <= self.most:
            both = np.concatenate([r.head(len(r)) for r in self.runs[-2:]])
            self.runs[-2:] = [_Run(both[np.argsort(both["key"], kind="stable")])]
        if sum(map(len, self.runs)) > self.most:
            self.disk.append(self._joined(self.runs))  # block by block, so that nothing is in memory twice
            self.runs = []
            if len(self.disk) >= 24:  # so that a merge never has many blocks in memory
                self.disk = [self._joined(self.disk)]

    def _joined(self, runs: list[_Run]) -> _Run:
        total, name = sum(map(len, runs)), self.folder.new()
        with self.folder.fs.open_output_stream(name, compression=None) as f:
            for block in _merged(runs, self.most):
                f.write(block.view(np.uint8).tobytes())
        self.folder.written += total
        return _Run(np.zeros(0, self.dtype), self.folder, name, total)

    def peek(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(the first n records, the run of each)."""
        runs = self.disk + self.runs
        parts = [r.head(n) for r in runs]
        if not parts:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        records, which = np.concatenate(parts), np.repeat(np.arange(len(runs)), [len(p) for p in parts])
        o = np.argsort(records["key"], kind="stable")[:n]
        return records[o], which[o]

    def take(self, which: np.ndarray) -> None:
        runs = self.disk + self.runs
        for r, k in zip(runs, np.bincount(which, minlength=len(runs)), strict=True):
            r.at += int(k)
        self.disk, self.runs = [r for r in self.disk if len(r)], [r for r in self.runs if len(r)]

    def blocks(self) -> Iterator[np.ndarray]:
        """All records in their order; nothing is pushed any more."""
        yield from _merged(self.disk + self.runs, self.most)


def _merged(runs: list[_Run], most: int) -> Iterator[np.ndarray]:
    """The records of the runs in order; of those in files about an eighth of `most` is in memory at once."""
    while runs := [r for r in runs if len(r)]:
        heads = [r.head(max(64, min(_BLOCK, most // (8 * len(runs))))) for r in runs]
        # what is surely before all that isn't in memory yet; ties beyond a block belong to the earlier run
        last = min((h["key"][-1], i) for i, (h, r) in enumerate(zip(heads, runs, strict=True)) if len(h) < len(r)) if any(len(h) < len(r) for h, r in zip(heads, runs, strict=True)) else None
        cut = [len(h) if last is None else int(np.searchsorted(h["key"], last[0], "right" if i <= last[1] else "left")) for i, h in enumerate(heads)]
        both = np.concatenate([h[:n] for h, n in zip(heads, cut, strict=True)])
        yield both[np.argsort(both["key"], kind="stable")]
        for r, n in zip(runs, cut, strict=True):
            r.at += n


def _dtype(width: int, after: int = 0) -> np.dtype:
    """id: segment and place; rank: of the record that induced it; run: of its first symbol; left: symbols that this phase still induces; more: all that it carries; lcp: with the record before; h: of its LMS substring; after: the `words` symbols from it on. Symbols are carried without the separators' share, in 32 bits."""
    fields = [("key", "<i8"), ("id", "<i8"), ("rank", "<i8"), ("h", "<u8"), ("run", "<u2"), ("left", "<u2"), ("more", "<u2"), ("lcp", "<u2"), ("carry", "<u4", (width,))]
    return np.dtype(fields + ([("words", "<u2"), ("after", "<u4", (after,))] if after else []))


def _parts(symbols: np.ndarray, seg: np.ndarray, length: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(symbols with separators, start of each segment, flags of S, places of LMS suffixes and separators, symbols before each of them down to the LMS suffix before, how many of those are L)."""
    start = np.cumsum(length + 1) - length - 1
    end = start + length
    x = np.empty(int(length.sum()) + len(seg), np.int64)
    body = np.ones(len(x), bool)
    body[end] = False
    x[body], x[end] = symbols + k, seg
    y = np.append(x, np.iinfo(np.int64).max)
    differs = np.append(y[:-1] != y[1:], True)
    nxt = np.minimum.accumulate(np.where(differs, np.arange(len(y)), len(y) - 1)[::-1])[::-1]
    small = np.append(y[:-1] < y[1:], False)[nxt][:-1]
    seed = np.zeros(len(x), bool)
    seed[1:] = small[1:] & ~small[:-1]
    seed[start] = False
    seed[end] = True
    at = np.flatnonzero(seed)
    of = np.searchsorted(start, at, "right") - 1
    before = np.concatenate([[-1], at[:-1]]) if len(at) else at
    down = np.maximum(before, start[of]) if len(at) else at
    large = np.concatenate([[0], np.cumsum(~small)])
    return x, start, small, at, of, at - down, large[at] - large[down]


class Level:
    """Segments of symbols, as blocks of whole ones that can be read again and again."""

    def __init__(self, blocks: Blocks, k: int, folder: Folder, memory: int) -> None:
        self.blocks, self.k, self.folder, self.memory = blocks, k, folder, memory
        self.width = self.after = 1
        self.top = self.count = self.suffixes = 0
        for symbols, seg, length in blocks():
            _, _, _, at, _, more, _ = _parts(symbols, seg, length, k)
            self.width = max(self.width, int(more.max(initial=0)))
            self.after = max(self.after, int(length.max(initial=0)))
            self.top = max(self.top, int(symbols.max(initial=0)) + k)
            self.count += len(at)
            self.suffixes += len(symbols) + len(seg)

    def seeds(self, after: bool) -> Iterator[np.ndarray]:
        """Records of the LMS suffixes and separators in the order of the text, key the symbol."""
        dtype = _dtype(self.width, self.after if after else 0)
        for symbols, seg, length in self.blocks():
            x, start, _, at, of, more, left = _parts(symbols, seg, length, self.k)
            r = np.zeros(len(at), dtype)
            r["key"], r["id"] = 2 * x[at] + 1, (seg[of] << _BITS) | (at - start[of])
            end = (start + length)[of]
            r["left"], r["more"] = left, more
            place = at[:, None] - 1 - np.arange(self.width)
            r["carry"] = np.where(np.arange(self.width) < more[:, None], x[np.maximum(place, 0)] - self.k, 0)
            if after:
                place = at[:, None] + np.arange(self.after)
                inside, symbol = place < end[:, None], x[np.minimum(place, len(x) - 1)]
                r["after"], r["words"] = np.where(inside, symbol - self.k, 0), end - at
                run = np.cumprod(inside & (symbol == x[at][:, None]), 1, np.uint8).sum(1)
            else:  # hashes of the LMS substrings that end here
                c = np.where(np.arange(self.width) < more[:, None], r["carry"].astype(np.int64), -1).astype(np.uint64)
                m = np.array([pow(0xD1342543DE82EF95, j + 1, 1 << 64) for j in range(self.width)], np.uint64)
                h = (c * m).sum(1, dtype=np.uint64) + x[at].astype(np.uint64) + (more.astype(np.uint64) << np.uint64(57))
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                r["h"] = h ^ (h >> np.uint64(29))
                run = np.ones(len(at), np.int64)
            r["run"] = run
            yield r


def _scan(level: Level, seeds: Iterator[np.ndarray], dtype: np.dtype, up: bool, with_lcp: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(records, whether each was induced, common prefix with the one before) of the seeds and all that they induce, in order of their key.

    Among equal symbols the induced come before the seeds. up: from the least symbol on, else from the largest.
    """
    queue = Queue(dtype, level.folder, level.memory)
    least = RangeMin(level.suffixes + 64) if with_lcp else None
    pending, over = np.zeros(0, dtype), False
    done, size = 0, 512
    last = np.zeros(1, dtype)
    last["key"], none = -9, np.int64(1) << 62
    while True:
        size = max(64, min(size, queue.most // (2 * (1 + len(queue.disk) + len(queue.runs)))))
        while len(pending) < size and not over:
            block = next(seeds, None)
            over = block is None
            if not over:
                pending = np.concatenate([pending, block[list(dtype.names)].astype(dtype)])
        first, which = queue.peek(size)
        if not len(first) and not len(pending):
            return
        some = pending[:size]
        both = np.concatenate([first, some])
        o = np.argsort(both["key"], kind="stable")[:size]
        r = both[o]
        gives = r["left"] > 0
        symbol = r["carry"][:, 0].astype(np.int64) + level.k
        new_key = np.where(gives, 2 * (symbol if up else level.top - symbol), none)
        ahead = np.minimum.accumulate(new_key)
        bad = np.flatnonzero(r["key"][1:] > ahead[:-1])
        n = int(bad[0]) + 1 if len(bad) else len(r)
        size = int(min(max(256, 2 * n), 1 << 15))
        r, o, gives, symbol, new_key = r[:n], o[:n], gives[:n], symbol[:n], new_key[:n]
        induced = o < len(first)
        lcp = np.zeros(n, np.int64)
        if least is not None:
            before = np.concatenate([last, r[:-1]])
            same = np.flatnonzero(induced & (before["key"] == r["key"]))
            if len(same):
                lcp[same] = np.minimum(least.query(before["rank"][same] + 1, r["rank"][same]), 254).astype(np.int64) + 1
            seam = np.flatnonzero(~induced & (before["key"] == r["key"] - 1))
            lcp[seam] = np.minimum(before["run"][seam], r["run"][seam])
            two = np.flatnonzero(~induced & (before["key"] == r["key"]))
            lcp[two] = r["lcp"][two]
            least.append(np.minimum(lcp, 255).astype(np.uint8))
            last = r[-1:].copy()
        used = int((~induced).sum())
        pending = pending[used:]
        queue.take(which[o[induced]])
        g = np.flatnonzero(gives)
        child = r[g].copy()
        own = child["key"] >> 1
        child["key"], child["id"], child["rank"] = new_key[g], r["id"][g] - 1, done + g
        child["run"] = np.where(own == new_key[g] >> 1, np.minimum(r["run"][g] + 1, 60000), 1)
        child["left"], child["more"] = r["left"][g] - 1, r["more"][g] - 1
        child["carry"][:, :-1] = r["carry"][g][:, 1:]
        queue.push(child)
        yield r, induced, lcp
        done += n


def _backwards(folder: Folder, names: list[tuple[str, int]], dtype: np.dtype) -> Iterator[np.ndarray]:
    for name, n in reversed(names):
        with folder.fs.open_input_stream(name, compression=None) as f:
            yield np.frombuffer(f.read(n * dtype.itemsize), dtype)[::-1]
        folder.fs.delete_file(name)


def _induce(level: Level, seeds: Iterator[np.ndarray], with_lcp: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(records, whether each is an S suffix, common prefix with the one before) of all suffixes but separators, from the largest down."""
    dtype, names, least = _dtype(level.width), [], 1 << 15
    for r, induced, lcp in _scan(level, seeds, dtype, True, with_lcp):
        # an L suffix's common prefix with the L suffix before: the least since then
        i = np.flatnonzero(induced)
        if len(i):
            cut = np.concatenate([[0], i[:-1] + 1])
            between = np.minimum.reduceat(lcp[: i[-1] + 1], cut)
            between[0] = min(int(between[0]), least)
            out = r[i].copy()
            out["lcp"], out["left"] = np.minimum(between, 255), np.where(out["left"] == 0, out["more"], 0)
            out["key"] = 2 * (level.top - (out["key"] >> 1)) + 1
            names.append((level.folder.write(out), len(out)))
            least = int(lcp[i[-1] + 1 :].min(initial=1 << 15))
        else:
            least = min(least, int(lcp.min(initial=1 << 15)))

    def down() -> Iterator[np.ndarray]:
        carried = 0
        for block in _backwards(level.folder, names, dtype):
            block = block.copy()
            own = block["lcp"].copy()
            block["lcp"] = np.concatenate([[carried], own[:-1]])
            carried = int(own[-1])
            yield block

    yield from _scan(level, down(), dtype, False, with_lcp)


def _ranks(level: Level) -> Iterator[np.ndarray]:
    """Ranks of the LMS suffixes and separators, in the order of the text."""
    names = Queue(np.dtype([("key", "<i8"), ("name", "<i8")]), level.folder, level.memory)
    order = Queue(_dtype(level.width), level.folder, level.memory)
    for block in level.seeds(False):
        order.push(block)
    last, number, found = None, -1, 0
    for r, induced, _ in _induce(level, order.blocks(), False):
        i = np.flatnonzero(induced & (r["more"] == 0) & (r["id"] & ((1 << _BITS) - 1) > 0))
        if len(i):
            h = r["h"][i]
            new = np.concatenate([[last is None or h[0] != last], h[1:] != h[:-1]])
            out = np.zeros(len(i), names.dtype)
            out["key"], out["name"] = r["id"][i], number + np.cumsum(new)  # the largest has the number 0
            number, last, found = int(out["name"][-1]), h[-1], found + len(i)
            names.push(out)
    stored = []
    for block in names.blocks():
        stored.append((level.folder.write(block), len(block)))

    def text() -> Iterator[np.ndarray]:
        for name, n in stored:
            with level.folder.fs.open_input_stream(name, compression=None) as f:
                yield np.frombuffer(f.read(n * names.dtype.itemsize), names.dtype)

    def segments() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rest = np.zeros(0, names.dtype)
        for block in _with_end(text()):
            both = rest if block is None else np.concatenate([rest, block])
            seg = both["key"] >> _BITS
            n = len(both) if block is None else int(np.searchsorted(seg, seg[-1], "left"))  # the last may go on
            rest = both[n:]
            if n:
                s, count = np.unique(seg[:n], return_counts=True)
                yield number - both["name"][:n], s, count

    if number + 1 == found:  # all differ, so that names are ranks
        rank = (number - block["name"] for block in text())
    else:
        rank = _ordered(Level(segments, level.k, level.folder, level.memory))
    have = np.zeros(0, np.int64)
    for block in level.seeds(False):
        sep = (block["key"] >> 1) < level.k
        while len(have) < int((~sep).sum()):
            have = np.concatenate([have, next(rank)])
        out = np.empty(len(block), np.int64)
        out[sep], n = block["key"][sep] >> 1, int((~sep).sum())  # separators are the least, in the order of segments
        out[~sep], have = level.k + have[:n], have[n:]
        yield out


def _with_end(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray | None]:
    """The blocks, and None after the last."""
    yield from blocks
    yield None


def _ordered(level: Level) -> Iterator[np.ndarray]:
    """Ranks of all suffixes but separators, in the order of the text."""
    if level.suffixes * 120 <= level.memory:
        parts = list(level.blocks())
        symbols, seg, length = (np.concatenate(c) for c in zip(*parts, strict=True))
        x, start, *_ = _parts(symbols, seg, length, level.k)
        sa, _ = suffix_array(x, False)
        rank = np.empty(len(x), np.int64)
        rank[sa] = np.arange(len(x))
        body = np.ones(len(x), bool)
        body[start + length] = False
        yield rank[body]
        return
    back, at = Queue(np.dtype([("key", "<i8"), ("rank", "<i8")]), level.folder, level.memory), 0
    for r, _, _ in suffixes_down(level, False):
        out = np.zeros(len(r), back.dtype)
        out["key"], out["rank"] = r["id"], (1 << 60) - at - np.arange(len(r))
        at += len(r)
        back.push(out)
    for block in back.blocks():
        yield block["rank"].copy()


def suffixes_down(level: Level, with_lcp: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(records, whether S, common prefix with the one before) of all suffixes but separators, from the largest down."""
    dtype = _dtype(level.width, level.after if with_lcp else 0)
    order = Queue(dtype, level.folder, level.memory)
    for block, rank in zip(level.seeds(with_lcp), _ranks(level), strict=False):
        block = block.copy()
        block["rank"], block["key"] = block["key"], rank
        order.push(block)

    def seeds() -> Iterator[np.ndarray]:
        last = None
        for block in order.blocks():
            block = block.copy()
            block["key"], block["rank"] = block["rank"], 0
            if with_lcp:
                a, w = (block[c] if last is None else np.concatenate([last[c], block[c]]) for c in ("after", "words"))
                same = np.minimum(np.cumprod(a[1:] == a[:-1], 1, np.uint8).sum(1), np.minimum(w[1:], w[:-1]))
                block["lcp"] = np.minimum(np.concatenate([[0], same]) if last is None else same, 255)
                last = block[-1:].copy()
            yield block

    yield from _induce(level, seeds(), with_lcp)
