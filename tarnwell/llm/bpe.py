"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of adjacent bytes that is inside no token of the vocabulary can never be merged across: between the two is a
certain cut, whatever stands around. A table of the 65,536 pairs is built from the vocabulary. The pattern that is
published with the vocabulary, which cuts a text into pieces before any merge, forbids merges as well: its boundaries
follow from the classes of neighbouring characters. The text is cut at every boundary of either kind, in vector
operations over whole batches. The fragments recur all the time: each distinct one of a batch is encoded once,
independently of its neighbours, and the tokens of a text are those of its fragments one after another.

Distinct fragments are merged together: those of about the same length are rows of a matrix of tokens, and in each
round every row makes its merge of least rank, from the left. Pairs that merge are found in a hash table over arrays.

Defined results: a null text has null tokens, an empty one none; any other text, of any length, decodes to itself
byte by byte; special tokens' names in a text are ordinary text; each row is encoded by itself, repeated rows alike; a
null doc_id stays null; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: How the vocabularies' texts are cut into pieces before merging (published with the vocabularies); Bpe.pieces() follows it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: Most bytes of a matrix row; longer fragments are merged with a heap each, whose time is n log n.
_WIDEST = 64


@dataclass(frozen=True)
class BpeConfig:
    """vocabulary: a file of base64 tokens and ranks, one a line, that every executor can read."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@functools.cache
def character_classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, what in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(what, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind  # surrogates within a run are in no text
    return out


class Pairs:
    """Token that two neighbouring tokens merge to: a hash table over arrays, with open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(len(left)).bit_length() + 3)
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        key, rest = (left.astype(np.int64) << 32) | right, np.arange(len(left))
        at = self._hash(key)
        while len(rest):
            _, i = np.unique(at[rest], return_index=True)
            i = rest[i]
            i = i[self.key[at[i]] == -1]
            self.key[at[i]], self.to[at[i]] = key[i], merged[i]
            rest = rest[self.key[at[rest]] != key[rest]]
            at[rest] = (at[rest] + 1) & (len(self.key) - 1)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = self._hash(key)
        there = self.key[at]
        out = np.where(there == key, self.to[at], np.int32(none))
        left_over = np.flatnonzero((there != key) & (there != -1))
        while len(left_over):
            at[left_over] = (at[left_over] + 1) & (len(self.key) - 1)
            there = self.key[at[left_over]]
            hit = there == key[left_over]
            out[left_over[hit]] = self.to[at[left_over[hit]]]
            left_over = left_over[~hit & (there != -1)]
        return out


class Bpe:
    """A vocabulary with its table of forced boundaries."""

    def __init__(self, cfg: BpeConfig) -> None:
        with open(cfg.vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.forced = np.ones((256, 256), bool)
        left, right, merged = [], [], []
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                self.forced[t[i - 1], t[i]] = False
                if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(r)
        self.pairs = Pairs(*(np.array(x, np.int64) for x in (left, right, merged)))
        self.none = max(self.ranks.values()) + 1
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        by = sorted((r, t) for t, r in self.ranks.items())
        size = np.zeros(self.none, np.int64)
        size[[r for r, _ in by]] = [len(t) for _, t in by]
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.bytes = np.frombuffer(b"".join(t for _, t in by), np.uint8)
        ids, n = self.merge(self.bytes, self.at[[r for r, _ in by]], np.array([len(t) for _, t in by]))
        start = np.cumsum(n) - n
        #: Tokens that merges don't reach: only a piece that is one as a whole is encoded so.
        self.odd = {t: r for (r, t), k, i in zip(by, n, ids[start], strict=True) if k != 1 or i != r}

    def merge(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, number of them by fragment) of the fragments at start, of at least one byte each."""
        size, done, low = np.zeros(len(start), np.int64), [], 0
        for high in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, _WIDEST):
            i = np.flatnonzero((length > low) & (length <= high))
            low = high
            for s in range(0, len(i), 1 << 15):
                j = i[s : s + (1 << 15)]
                ids, size[j] = self._rows(buf, start[j], length[j], high)
                done.append((j, ids))
        for j in np.flatnonzero(length > _WIDEST):
            ids = self._heap(buf[start[j] : start[j] + length[j]].tobytes())
            size[j] = len(ids)
            done.append((np.array([j]), np.array([ids], np.int32)))
        out, at = np.empty(int(size.sum()), np.int32), np.cumsum(size) - size
        for j, ids in done:
            inside = np.arange(ids.shape[1])[None] < size[j][:, None]
            out[(at[j][:, None] + np.arange(ids.shape[1])[None])[inside]] = ids[inside]
        return out, size

    def _rows(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of fragments of at most width bytes, a row each, and their numbers: the merge of least rank of every row, round by round."""
        column = np.arange(width)
        inside = column[None] < length[:, None]
        ids = np.where(inside, self.byte[buf[np.minimum(start[:, None] + column[None], len(buf) - 1)]], -1)
        size, rows = length.copy(), np.arange(len(start))
        if width == 1:
            return ids, size
        rank = np.full((len(start), width), self.none, np.int32)
        both = inside[:, 1:]
        rank[:, :-1][both] = self.pairs.find(ids[:, :-1][both], ids[:, 1:][both], self.none)
        own = ids
        while len(rows):
            p = rank.argmin(1)
            best = rank[np.arange(len(rows)), p]
            more = best < self.none
            if not more.all():
                ids[rows] = own
                rows, own, rank, p, best = rows[more], own[more], rank[more], p[more], best[more]
                if not len(rows):
                    break
            elif own is ids:
                own = ids.copy()
            k = np.arange(len(rows))
            n = size[rows] = size[rows] - 1
            shift = column[None, :-1] > p[:, None]
            own[:, :-1] = np.where(shift, own[:, 1:], own[:, :-1])
            rank[:, :-1] = np.where(shift, rank[:, 1:], rank[:, :-1])
            own[k, p] = best
            after, before = np.flatnonzero(p + 1 < n), np.flatnonzero(p > 0)
            rank[k, p] = self.none
            rank[after, p[after]] = self.pairs.find(own[after, p[after]], own[after, p[after] + 1], self.none)
            rank[before, p[before] - 1] = self.pairs.find(own[before, p[before] - 1], own[before, p[before]], self.none)
        return ids, size

    def _heap(self, piece: bytes) -> list[int]:
        """The same for one long fragment, with a heap over a linked list."""
        n = len(piece)
        end, nxt, prv, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != e:
                continue
            alive[j] = False
            end[i], nxt[i] = e, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for a in (prv[i], i):
                if a >= 0 and nxt[a] < n and (t := piece[a : end[nxt[a]]]) in self.ranks:
                    heapq.heappush(heap, (self.ranks[t], a, end[nxt[a]]))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    @staticmethod
    def pieces(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Flags of the bytes of x, UTF-8 texts that begin at starts, at which a piece of the pattern begins."""
        table = character_classes()
        lead = np.flatnonzero((x & 0xC0) != 0x80)
        b = x[lead].astype(np.int32)
        wide = np.flatnonzero(b >= 0x80)
        if len(wide):
            w, at = b[wide], lead[wide]
            y = [(x[np.minimum(at + k, len(x) - 1)] & 0x3F).astype(np.int32) for k in (1, 2, 3)]
            two, three = ((w & 0x1F) << 6) | y[0], ((w & 0x0F) << 12) | (y[0] << 6) | y[1]
            b[wide] = np.where(w < 0xE0, two, np.where(w < 0xF0, three, ((w & 0x07) << 18) | (y[0] << 12) | (y[1] << 6) | y[2]))
        kind = table[b]
        first = np.zeros(len(b) + 1, bool)
        first[np.searchsorted(lead, starts)] = True
        first[-1] = True
        begin = np.ones(len(b) + 1, bool)
        begin[1:-1] = kind[1:] != kind[:-1]
        begin |= first
        word = np.flatnonzero((kind[1:] != _SPACE) & (kind[:-1] == _SPACE) & ~first[1:-1]) + 1  # after white space, in the same text
        begin[word - 1] = True
        begin[word] = b[word - 1] != 32
        quote = np.flatnonzero((b == 39) & begin[:-1])
        if len(quote):
            near = np.concatenate([b, np.zeros(3, np.int32)])
            ends = np.concatenate([first, np.ones(3, bool)])
            one = quote[~ends[quote + 1] & np.isin(near[quote + 1], [ord(c) for c in "stmd"])]
            two = quote[~ends[quote + 1] & ~ends[quote + 2] & np.isin(near[quote + 1] * 256 + near[quote + 2], [ord(a) * 256 + ord(c) for a, c in ("re", "ve", "ll")])]
            begin[one + 1], begin[one + 2] = False, True
            begin[two + 1], begin[np.minimum(two + 3, len(b))] = False, True
        out = np.zeros(len(x), bool)
        out[lead] = begin[:-1]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, offsets of the texts in them); '' for null."""
        col = C.utf8(texts)
        buf, off = C.raw(col)
        ids, counts = [], np.zeros(len(col), np.int64)
        for a, b in C._slices(off, C.SLICE_BYTES):
            sub = off[a : b + 1]
            if sub[-1] > sub[0]:
                found, size, which, at = self._fragments(buf, sub)
                start = np.cumsum(size) - size
                ids.append(found[C.expand(start[which], size[which])])
                counts[a:b] = np.bincount(np.searchsorted(sub[1:], at[:-1], "right"), weights=size[which], minlength=b - a).astype(np.int64)
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(counts)])

    def cuts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in buf where a fragment begins, with the end of the last; of each, whether a piece begins there."""
        lo, hi = int(off[0]), int(off[-1])
        x = buf[lo:hi]
        begins = off[:-1][np.diff(off) > 0] - lo
        piece = self.pieces(x, begins)
        cut = piece.copy()
        cut[1:] |= self.forced[x[:-1], x[1:]]
        at = np.flatnonzero(cut)
        return np.concatenate([at, [hi - lo]]) + lo, np.concatenate([piece[at], [True]])

    def _fragments(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tokens and their numbers by distinct fragment, the distinct one of each fragment, places)."""
        at, piece = self.cuts(buf, off)
        frags = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(buf)])
        d = pc.dictionary_encode(frags)
        which, (data, to) = np.asarray(d.indices), C.raw(d.dictionary.cast(pa.large_binary()))
        found, size = self.merge(data, to[:-1], np.diff(to))
        if self.odd:
            values = d.dictionary.to_pylist()
            for k in [k for k, v in enumerate(values) if v in self.odd]:
                which = np.where((which == k) & piece[:-1] & piece[1:], len(size), which)
                found, size = np.concatenate([found, np.array([self.odd[values[k]]], np.int32)]), np.concatenate([size, [1]])
        return found, size, which, at

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets of the texts in them)."""
        size = self.at[ids + 1] - self.at[ids]
        data = self.bytes[C.expand(self.at[ids], size)]
        return data, np.concatenate([[0], np.cumsum(size)])[off]


@functools.lru_cache(maxsize=2)
def _load(cfg: BpeConfig) -> Bpe:
    return Bpe(cfg)


def encode(docs: DataFrame, cfg: BpeConfig = BpeConfig()) -> DataFrame:
    """(doc_id, n_tokens, tokens, exact): the tokens of every text; exact: they decode to its very bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(cfg)
        for b in C.table_slices(batches, "text", C.SLICE_BYTES):
            raw = b.column("text")
            col = C.utf8(raw)
            ids, off = bpe.encode(col)
            data, to = bpe.decode(ids, off)
            buf, start = C.raw(col)
            n = np.diff(off)
            exact = np.diff(to) == np.diff(start)
            if exact.all():
                wrong = np.flatnonzero(data != buf[start[0] : start[-1]])
                exact[np.searchsorted(to[1:], wrong, "right")] = False
            else:
                exact = np.array([data[to[i] : to[i + 1]].tobytes() == buf[start[i] : start[i + 1]].tobytes() for i in range(len(n))])
            null = np.asarray(raw.is_null())
            tokens = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, mask=null), tokens, pa.array(exact, mask=null)], names=["doc_id", "n_tokens", "tokens", "exact"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, tokens array<int>, exact boolean")


def decode(encoded: DataFrame, cfg: BpeConfig = BpeConfig()) -> DataFrame:
    """(doc_id, text) of (doc_id, tokens). Bytes that aren't UTF-8 (of cut token lists) become U+FFFD; elements that are null or no token are skipped."""

    @F.arrow_udf("string")
    def text(tokens: pa.Array) -> pa.Array:
        bpe = _load(cfg)
        null = np.asarray(tokens.is_null())
        n = np.where(null, 0, np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)))
        flat = tokens.flatten()  # without what null rows may hold
        ids = np.asarray(pc.fill_null(flat, -1)).astype(np.int64)
        known = (ids >= 0) & (ids < bpe.none)
        off = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(n)])]
        data, to = bpe.decode(ids[known], off)
        out = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.ascontiguousarray(to, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        try:
            out = out.cast(pa.large_string())
        except pa.ArrowInvalid:
            out = pa.array([v.decode("utf-8", "replace") for v in out.to_pylist()], pa.large_string())
        return pc.if_else(pa.array(null), pa.scalar(None, pa.large_string()), out).cast(pa.string())

    return encoded.select("doc_id", text("tokens").alias("text"))
