"""Suffix arrays with common-prefix values by induced sorting in memory, in batches of vector operations.

The text is a sequence of integers. Suffixes are of type S (smaller than the next) or L; an S after an L is an LMS
suffix. LMS substrings are named in their order, the sequence of names is sorted by recursion, and from the sorted LMS
suffixes first all L and then all S suffixes are induced: a priority queue holds tuples (first character, position,
rank of the suffix that induced it); what is taken from it in order of character and arrival is in suffix order. The
queue is emptied in batches: as many tuples as can't be overtaken by what they induce themselves, some thousands at
once. external.py does the same where the text doesn't fit in memory.

Common prefixes are carried along: of two neighbours that were induced, it is 1 more than the least of those between
the suffixes that induced them (a range minimum over what has been scanned); where L and S meet in a bucket it is
the shorter run of the first character; between buckets it is 0. For the LMS suffixes themselves, the recursion's
order gives the neighbours and their prefixes are compared directly.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 32


class RangeMin:
    """Minima of ranges of a growing sequence of small numbers."""

    def __init__(self, most: int) -> None:
        blocks = most // _BLOCK + 2
        self.n, self.whole = 0, 0
        self.a = np.full(blocks * _BLOCK, 255, np.uint8)
        self.pre, self.suf = self.a.copy(), self.a.copy()
        self.table = [np.full(blocks, 255, np.uint8)]
        while 1 << len(self.table) <= blocks:
            self.table.append(np.full(blocks, 255, np.uint8))

    def append(self, values: np.ndarray) -> None:
        lo, hi = self.n, self.n + len(values)
        self.a[lo:hi] = values
        self.n = hi
        b0, b1 = lo // _BLOCK, -(-hi // _BLOCK)
        v = self.a[b0 * _BLOCK : b1 * _BLOCK].reshape(-1, _BLOCK)
        self.pre[b0 * _BLOCK : b1 * _BLOCK] = np.minimum.accumulate(v, 1).ravel()
        self.suf[b0 * _BLOCK : b1 * _BLOCK] = np.minimum.accumulate(v[:, ::-1], 1)[:, ::-1].ravel()
        done = hi // _BLOCK
        if done > self.whole:
            self.table[0][self.whole : done] = self.suf[self.whole * _BLOCK : done * _BLOCK : _BLOCK]
            for k in range(1, len(self.table)):
                s, e, h = max(0, self.whole - (1 << k) + 1), done - (1 << k) + 1, 1 << (k - 1)
                if e <= 0:
                    break
                self.table[k][s:e] = np.minimum(self.table[k - 1][s:e], self.table[k - 1][s + h : e + h])
            self.whole = done

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of [lo, hi], all of it appended before, lo <= hi."""
        b, c = lo // _BLOCK, hi // _BLOCK
        out = np.minimum(self.suf[lo], self.pre[hi])
        mid = np.flatnonzero(c - b > 1)
        if len(mid):
            s, e = b[mid] + 1, c[mid]
            k = np.frexp((e - s).astype(float))[1] - 1
            for level in np.unique(k):
                m = k == level
                t = self.table[level]
                out[mid[m]] = np.minimum(out[mid[m]], np.minimum(t[s[m]], t[e[m] - (1 << level)]))
        same = np.flatnonzero(b == c)
        if len(same):
            at, end = lo[same], hi[same]
            least = self.a[at].copy()
            left = np.arange(len(same))
            while len(left):
                at = at + 1
                ok = at <= end
                left, at, end = left[ok], at[ok], end[ok]
                least[left] = np.minimum(least[left], self.a[at])
            out[same] = least
        return out


class Queue:
    """Tuples (key, position, rank), taken by key and, among equal keys, in the order they came."""

    def __init__(self) -> None:
        self.runs: list[list[np.ndarray]] = []
        self.at: list[int] = []

    def _rest(self, k: int) -> int:
        return len(self.runs[k][0]) - self.at[k]

    def push(self, key: np.ndarray, pos: np.ndarray, rank: np.ndarray) -> None:
        if not len(key):
            return
        o = np.argsort(key, kind="stable")
        self.runs.append([key[o], pos[o], rank[o]])
        self.at.append(0)
        while len(self.runs) > 1 and 2 * self._rest(-1) >= self._rest(-2):
            columns = [np.concatenate([c[self.at[-2] :], d[self.at[-1] :]]) for c, d in zip(self.runs[-2], self.runs[-1], strict=True)]
            o = np.argsort(columns[0], kind="stable")
            self.runs[-2:], self.at[-2:] = [[c[o] for c in columns]], [0]

    def peek(self, n: int) -> tuple[np.ndarray, ...]:
        """The first n tuples and the run of each."""
        if not self.runs:
            z = np.zeros(0, np.int32)
            return z, z, z, z
        parts = [[c[a : a + n] for c in r] for r, a in zip(self.runs, self.at, strict=True)]
        key, pos, rank = (np.concatenate(c) for c in zip(*parts, strict=True))
        which = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        o = np.argsort(key, kind="stable")[:n]
        return key[o], pos[o], rank[o], which[o]

    def take(self, which: np.ndarray) -> None:
        for r, k in enumerate(np.bincount(which, minlength=len(self.runs))):
            self.at[r] += int(k)
        left = [r for r in range(len(self.runs)) if self._rest(r)]
        self.runs, self.at = [self.runs[r] for r in left], [self.at[r] for r in left]


def _scan(value: np.ndarray, wanted: np.ndarray, run: np.ndarray | None, seeds: np.ndarray, seed_lcp: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Seeds and all that they induce, in order of value: (positions, prefix in common with the one before).

    wanted[i]: suffix i is of the type to be induced. Among equal first values the induced come before the seeds.
    """
    total = len(seeds) + int(wanted.sum())
    out = np.empty(total, value.dtype)
    lcp = np.zeros(total, np.uint8) if run is not None else None
    least = RangeMin(total) if run is not None else None
    queue = Queue()
    seed_key = 2 * value[seeds] + 1
    done, used, size = 0, 0, 512
    last_key, last_rank, last_pos = -5, 0, 0
    none = value.dtype.type(np.iinfo(value.dtype).max)
    while done < total:
        key, pos, rank, which = queue.peek(size)
        s_key, s_pos = seed_key[used : used + size], seeds[used : used + size]
        nq = len(key)
        k = np.concatenate([key, s_key])
        o = np.argsort(k, kind="stable")[:size]
        k, p = k[o], np.concatenate([pos, s_pos])[o]
        before = np.maximum(p - 1, 0)
        gives = (p > 0) & wanted[before]
        new_key = np.where(gives, 2 * value[before], none)
        ahead = np.minimum.accumulate(new_key)
        bad = np.flatnonzero(k[1:] > ahead[:-1])
        n = int(bad[0]) + 1 if len(bad) else len(k)
        size = int(min(max(256, 2 * n), 1 << 16))
        k, p, o, gives, new_key, before = k[:n], p[:n], o[:n], gives[:n], new_key[:n], before[:n]
        from_queue = o < nq
        out[done : done + n] = p
        if run is not None:
            r = np.where(from_queue, np.concatenate([rank, np.zeros(len(s_key), rank.dtype)])[o], -1)
            pk, pr, pp = np.concatenate([[last_key], k[:-1]]), np.concatenate([[last_rank], r[:-1]]), np.concatenate([[last_pos], p[:-1]])
            c = np.zeros(n, np.uint8)
            both = np.flatnonzero(from_queue & (pk == k))
            if len(both):
                c[both] = np.minimum(least.query(pr[both] + 1, r[both]), 254) + 1
            seam = np.flatnonzero(~from_queue & (pk == k - 1))
            c[seam] = np.minimum(np.minimum(run[p[seam]], run[pp[seam]]), 255)
            two = np.flatnonzero(~from_queue & (pk == k))
            c[two] = seed_lcp[used + (o[two] - nq)]
            lcp[done : done + n] = c
            least.append(c)
            last_key, last_rank, last_pos = int(k[-1]), int(r[-1]), int(p[-1])
        used += int((~from_queue).sum())
        queue.take(which[o[from_queue]])
        g = np.flatnonzero(gives)
        queue.push(new_key[g], before[g], (done + g).astype(value.dtype))
        done += n
    return out, lcp


def _names(t: np.ndarray, kind: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings, equal for equal ones and in their order; by refinement, a character at a time."""
    n = len(lms)
    length = np.diff(np.concatenate([lms, [len(t) - 1]])) + 1
    rank = np.zeros(n, t.dtype)
    active = np.arange(n, dtype=t.dtype)
    d = 0
    while len(active):
        at = lms[active] + d
        key = 2 * t[at] + kind[at]
        o = np.lexsort([key, rank[active]])
        a, k, r = active[o], key[o], rank[active[o]]
        new_group = np.concatenate([[True], r[1:] != r[:-1]])
        new_part = new_group | np.concatenate([[True], k[1:] != k[:-1]])
        start = np.flatnonzero(new_group)
        group = np.cumsum(new_group) - 1
        part_start = np.flatnonzero(new_part)
        part = np.cumsum(new_part) - 1
        rank[a] = r + part_start[part] - start[group]
        size = np.diff(np.concatenate([part_start, [len(a)]]))[part]
        d += 1
        active = a[(size > 1) & (length[a] > d)]
    return rank


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of the suffixes a and b, at most 255."""
    out = np.zeros(len(a), np.uint8)
    left = np.arange(len(a))
    d = 0
    while len(left) and d < 255:
        x, y = a[left] + d, b[left] + d
        ok = (x < len(t)) & (y < len(t))
        ok[ok] = t[x[ok]] == t[y[ok]]
        left = left[ok]
        d += 1
        out[left] = d
    return out


def suffix_array(text: np.ndarray, with_lcp: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(suffixes in order, prefix that each has in common with the one before, at most 255). text: integers from 0."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    kind = np.int32 if max(n, int(text.max())) < 1 << 29 else np.int64
    t = np.zeros(n + 1, kind)  # 0 ends the text
    t[:n] = text
    t[:n] += 1
    differs = np.concatenate([t[:-1] != t[1:], [True]])
    nxt = np.where(differs, np.arange(n + 1, dtype=kind), kind(n))
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]  # last place of the run that i is in
    small = np.concatenate([t[:-1] < t[1:], [True]])[nxt]
    run = np.minimum(nxt - np.arange(n + 1, dtype=kind) + 1, 255).astype(np.uint8)
    del differs, nxt
    lms = (np.flatnonzero(small[1:-1] & ~small[:-2]) + 1).astype(kind)
    if len(lms) > 1:
        name = _names(t, small.view(np.int8), lms)
        order = np.argsort(name, kind="stable")
        if len(lms) > 1 and (np.diff(name[order]) == 0).any():
            order, _ = suffix_array(name, False)
        lms = lms[order]
        del name, order
    seeds = np.concatenate([np.array([n], kind), lms])
    seed_lcp = None
    if with_lcp:
        seed_lcp = np.concatenate([[0], _common(t, seeds[:-1], seeds[1:])]).astype(np.uint8)
    large, l_lcp = _scan(t, ~small, run if with_lcp else None, seeds, seed_lcp)
    at = np.flatnonzero(~small[large])
    down = large[at][::-1]
    if with_lcp:
        between = np.minimum.reduceat(l_lcp, at[:-1] + 1)[: len(at) - 1] if len(at) > 1 else np.zeros(0, np.uint8)
        if len(at) > 1 and at[-1] + 1 < len(l_lcp):
            between[-1] = l_lcp[at[-2] + 1 : at[-1] + 1].min()
        seed_lcp = np.concatenate([[0], between[::-1]]).astype(np.uint8)
    top = int(t.max())
    wanted = small.copy()
    wanted[n] = False
    del large, l_lcp, at, seeds, lms
    out, lcp = _scan(kind(top) - t, wanted, run if with_lcp else None, down, seed_lcp)
    if lcp is not None:
        lcp = np.concatenate([[0], lcp[1:][::-1]]).astype(np.uint8)
    return out[::-1], lcp
