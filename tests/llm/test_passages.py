"""Compact windows and suffix arrays: the repeats that brute force finds."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tarnwell.llm import common as C
from tarnwell.llm import external, suffixes, windows
from tarnwell.llm.induced import RangeMin, suffix_array

from .helpers import awkward, empty, table, words


def corpus(edits=0):
    r, rows = random.Random(9), []
    passages = [words(r.randrange(51, 160), 500 + k) for k in range(12)]
    for k in range(60):
        w = words(r.randrange(0, 300), k)
        for _ in range(r.randrange(0, 3)):
            p = list(r.choice(passages))
            for _ in range(edits):
                p[r.randrange(len(p))] = f"e{r.randrange(10**6)}"
            at = r.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((3 * k + 1, " ".join(w)))
    r.shuffle(rows)
    return rows


def uncovered(rows, found, n=50):
    """Runs of n words that an earlier document has and that no row of found covers; and how many there are."""
    hashes = {d: C.word_hashes(pa.array([t]))[0].tolist() for d, t in rows}
    cover, first, missed, total = {}, {}, 0, 0
    for f in found:
        cover.setdefault(f.doc_id, set()).update(range(f.start_word, f.end_word))
    for d in sorted(hashes):
        own = {}
        for i in range(len(hashes[d]) - n + 1):
            g = tuple(hashes[d][i : i + n])
            own.setdefault(g, i)
            if g in first:
                total += 1
                missed += not set(range(i, i + n)) <= cover.get(d, set())
        for g in own:
            first.setdefault(g, d)
    for f in found:
        assert f.source_doc < f.doc_id
        m = f.end_word - f.start_word
        x, y = hashes[f.doc_id][f.start_word : f.end_word], hashes[f.source_doc][f.source_start : f.source_start + m]
        assert len(x) == len(y) == m >= n and sum(a == b for a, b in zip(x, y, strict=True)) >= (0.8 if hasattr(f, "similarity") else 1) * m
    return missed, total


@pytest.mark.parametrize("operator", [windows.repeated_passages, suffixes.repeated_passages])
def test_every_repeat_is_found(spark, operator):
    rows = corpus()
    missed, total = uncovered(rows, operator(table(spark, rows)).collect())
    assert total > 500 and missed == 0


def test_exact_repeats_around_a_hot_phrase(spark):
    hot, r, rows = words(40, 900), random.Random(3), []
    for k in range(120):
        w = words(60, 2000 + k) + hot + words(60, 3000 + k)
        rows.append((k, " ".join(w if k % 3 else w + words(70, 4000 + k) + hot[:30])))
    for k in range(50):  # rare passages that hold most of the phrase, in documents with other holders before, between and after
        at = r.randrange(0, 16)
        p = words(at, 5000 + k) + hot[:35] + words(15 - at, 6000 + k)
        for i in (k + 5, k + 65):
            rows[i] = (i, rows[i][1] + " " + " ".join(words(30, 7000 + i) + p + words(30, 8000 + i)))
    missed, total = uncovered(rows, windows.repeated_passages(table(spark, rows)).collect())
    assert total >= 50 and missed == 0


def test_near_repeats_around_a_hot_phrase(spark):
    """Rare near repeats that hold a phrase of all documents, with many other holders between the two."""
    hot, rows, want = words(24, 900), [], set()
    for k in range(200):
        rows.append((k, " ".join(words(60, 2000 + k, 10**6) + hot + words(60, 3000 + k, 10**6))))
    for k in range(40):
        p = words(13, 5000 + k, 10**6) + hot + words(13, 6000 + k, 10**6)
        q = [*p[:3], "x1", *p[4:9], "x2", *p[10:40], "x3", *p[41:46], "x4", *p[47:]]
        rows[k + 20] = (k + 20, rows[k + 20][1] + " " + " ".join(words(60, 7000 + k, 10**6) + p + words(60, 8000 + k, 10**6)))
        rows[k + 120] = (k + 120, rows[k + 120][1] + " " + " ".join(words(60, 7500 + k, 10**6) + q + words(60, 8500 + k, 10**6)))
        want.add((k + 120, k + 20))
    got = {(r.doc_id, r.source_doc) for r in windows.repeated_passages(table(spark, rows)).collect()}
    print(len(want - got), len(got - want))
    assert len(want - got) <= 2


@pytest.mark.parametrize("small", [512, 3])  # all pairs, and by prefixes
def test_words_around_by_brute_force(small):
    r, cfg = np.random.default_rng(8), windows.WindowConfig()
    around = r.integers(1, 200, (300, 97)).astype(np.uint8)
    around[:, 38:58] = around[0, 38:58]  # a hot phrase
    for k in range(0, 300, 3):
        s, o = r.integers(0, 47), r.integers(300)
        around[k, s : s + 50] = np.where(r.random(50) < 0.9, around[o, s : s + 50], around[k, s : s + 50])
    around[5, :30], around[7, 60:] = 0, 0
    group, doc = np.sort(r.integers(0, 5, 300)), r.integers(0, 200, 300)
    equal = lambda i, j: int(((around[i] == around[j]) & (around[i] > 0)).sum())
    runs = lambda i, j: len(windows.matching_runs((around[i] == around[j]) & (around[i] > 0), np.array([0, 97]), cfg)[0]) > 0
    pairs = {(i, j) for i in range(300) for j in range(i + 1, 300) if group[i] == group[j] and doc[i] != doc[j] and equal(i, j) >= 40}
    near = {(i, j) for i, j in pairs if runs(i, j)}
    got, linked = (set(zip(*(x.tolist() for x in windows.alike_around(group, around, doc, cfg, small, c)), strict=True)) for c in (False, True))
    assert near <= got <= pairs and len(near) > 10
    rest = {(i, j) for i, j in near - linked if not any((k, i) in linked & near and (k, j) in linked & near for k in range(i))}
    assert linked <= got and not rest  # what isn't linked has one row in common


def test_runs_of_one_word_meet_on_few_lines(spark):
    """Many documents with long runs of one word: windows along the runs, all of one value, of which nearly each two are alike."""
    rows = [(k, " ".join(words(20, 2000 + k, 10**6) + ["the"] * (60 + k) + words(20, 3000 + k, 10**6))) for k in range(60)]
    docs, cfg = table(spark, rows), windows.WindowConfig()
    hot = windows.hot_windows(windows.window_table(docs, cfg), cfg)
    lines = windows.other_lines(docs, hot, cfg).collect()
    assert len(lines) < 5 * hot.count()  # of some 75,000 pairs of documents and diagonals
    got = windows.repeated_passages(docs).collect()
    missed, total = uncovered(rows, got)
    assert total > 500 and missed == 0 and {r.doc_id for r in got} == set(range(1, 60))


def test_many_alike_rows_by_brute_force():
    """Groups above `small`, several leaders, more rows than a tile: what isn't linked has an earlier row in common."""
    r, cfg = np.random.default_rng(4), windows.WindowConfig()
    around = r.integers(1, 250, (700, 97)).astype(np.uint8)
    for k in range(700):
        lo, hi = r.integers(0, 49), r.integers(48, 98)
        around[k, lo:hi] = 7  # runs of one word around the minimum
    around[:, 47:50] = 7
    doc = np.sort(r.integers(0, 150, 700))
    i, j = np.triu_indices(700, 1)
    i, j = i[doc[i] != doc[j]], j[doc[i] != doc[j]]
    sure = windows._runs_around(around[i], around[j], cfg)
    near = np.zeros((700, 700), bool)
    near[i[sure], j[sure]] = True
    got, every = np.zeros((700, 700), bool), np.zeros((700, 700), bool)
    got[windows.alike_around(np.zeros(700, int), around, doc, cfg)] = True
    every[windows.alike_around(np.zeros(700, int), around, doc, cfg, classes=False)] = True
    linked = (got & near).astype(np.float32)
    assert not (near & ~every).any() and not (got & ~every).any()
    assert not (near & ~got & (linked.T @ linked == 0)).any() and got.sum() < near.sum() / 10 and near.sum() > 20_000


def test_long_runs_of_one_word_do_not_meet_each_other(spark):
    """Two windows in runs that are passages by themselves: exact_lines() has them; a run with another word in it meets one, and all lines are found."""
    the = lambda n: ["the"] * n
    rows = [(k, " ".join(words(60, 2000 + k, 10**6) + the(60 + k) + words(60, 3000 + k, 10**6))) for k in range(1, 80)]
    rows += [(k, " ".join(words(60, 2000 + k, 10**6) + the(24) + ["x"] + the(25) + words(60, 3000 + k, 10**6))) for k in (0, 80)]
    docs, cfg = table(spark, rows), windows.WindowConfig()
    hot = windows.hot_windows(windows.window_table(docs, cfg), cfg)
    lines = {(x.a, x.b) for x in windows.other_lines(docs, hot, cfg).collect()}
    others = sum(a > 0 and b < 80 for a, b in lines)  # equal bytes of different words past the runs' ends
    assert len(lines) - others > 100 and others < 79 * 78 / 2 / 5
    got = windows.repeated_passages(docs).collect()
    missed, total = uncovered(rows, got)
    assert missed == 0 and total > 500 and {r.doc_id for r in got} == set(range(1, 81))


@pytest.mark.parametrize("count", [20, 200])
def test_near_repeats_go_on_past_long_runs(spark, count):
    """Two documents that have words past the ends of a run in common besides it, no 3 of them in a row: what is covered goes on there."""
    rows, common = [], words(8, 77, 10**6)
    for k in range(count):
        own = words(140, 5000 + k, 10**6)
        rows.append((k, " ".join(own[:60] + ["the"] * (70 + k % 3) + own[60:])))
    for k in (count // 2, count - 1):  # ends alike: every second word on either side of the run
        own = words(140, 9000 + k, 10**6)
        before, after = own[:60], own[60:]
        before[44::2], after[:16:2] = common, common
        rows[k] = (k, " ".join(before + ["the"] * 70 + after))
    got = windows.repeated_passages(table(spark, rows)).collect()
    cover = {i for r in got if r.doc_id == count - 1 for i in range(r.start_word, r.end_word)}
    assert set(range(60, 130)) <= cover and len(cover) > 80


@pytest.mark.parametrize("parts", [1, 2])
def test_inner_rows_of_runs_are_not_needed(parts):
    """Rows along runs: the same lines whether all rows meet or the first and last ones with all, in one block or between two."""
    r, cfg = np.random.default_rng(7), windows.WindowConfig()
    tail = r.integers(8, 250, (6, 60))
    rows = []
    for d in range(90):
        run = int(r.integers(5, 90))
        text = np.concatenate([r.integers(8, 250, 60), np.full(run, 7), tail[r.integers(6)], r.integers(8, 250, 60)])
        text[60 + run + r.integers(0, 60, 4)] = 5
        rows += [(d, c, run >= 50, text[c - 47 : c + 50]) for c in range(60, 60 + run - 2)]
    doc, c, run = (np.array([x[k] for x in rows]) for k in range(3))
    around, second = np.array([x[3] for x in rows], np.uint8), doc % parts > 0
    o = np.lexsort([c, doc, second])
    doc, c, run, around, second = (x[o] for x in (doc, c, run, around, second))
    inner = windows.inner_rows(np.concatenate([[True], doc[1:] != doc[:-1]]), c, cfg)
    found = []
    for flags in (np.zeros(len(doc), bool), inner):
        p, q = windows.alike_around(np.zeros(len(doc), int), around, doc, cfg, classes=False, run=run, second=second, inner=flags)
        assert (parts == 1 or (second[p] != second[q]).all())
        a, b = np.where(doc[p] < doc[q], p, q), np.where(doc[p] < doc[q], q, p)
        found.append(set(zip(doc[a].tolist(), doc[b].tolist(), (c[b] - c[a]).tolist(), strict=True)))
    assert found[0] == found[1] and len(found[0]) > 100 and inner.mean() > 0.8


def test_exact_run_beside_scattered_equal_words():
    same = np.concatenate([np.ones(50, bool), np.tile(np.array([False] * 5 + [True]), 20)])
    assert [x.tolist() for x in windows.matching_runs(same, np.array([0, len(same)]), windows.WindowConfig())] == [[0], [0], [50]]


def test_near_repeats_are_found_by_windows(spark):
    base = words(200, 77)
    near = list(base)
    for i in range(15, 200, 30):
        near[i] = f"changed{i}"
    rows = [(1, " ".join(words(50, 1) + base)), (2, " ".join(near + words(40, 2))), (3, " ".join(words(300, 3)))]
    got = windows.repeated_passages(table(spark, rows)).collect()
    assert {r.doc_id for r in got} == {2} and max(r.end_word - r.start_word for r in got) >= 150 and all(r.similarity >= 0.8 for r in got)


def edited(rate, n, seed):
    """Pairs of documents that share a passage of n words, of which the second has a share of rate substituted."""
    r, rows = random.Random(seed), []
    for k in range(150):
        p = words(n, 10_000 + k, 50_000)
        q = list(p)
        for i in r.sample(range(n), round(rate * n)):
            q[i] = f"e{r.randrange(10**9)}"
        rows += [(2 * k, " ".join(words(80, 20_000 + k, 50_000) + p + words(80, 30_000 + k, 50_000))), (2 * k + 1, " ".join(words(80, 40_000 + k, 50_000) + q + words(80, 50_000 + k, 50_000)))]
    return rows


@pytest.mark.parametrize(("rate", "n", "least"), [(0.1, 60, 0.95), (0.1, 100, 0.98), (0.19, 60, 0.85), (0.19, 100, 0.95)])
def test_recall_of_candidates(spark, rate, n, least):
    rows = edited(rate, n, 3)
    lines = windows.candidate_lines(windows.window_table(table(spark, rows), windows.WindowConfig()), windows.WindowConfig()).collect()
    found = {(x.a, x.b) for x in lines if x.d == 0}
    print(rate, n, len(found) / 150, len(lines))
    assert found <= {(2 * k, 2 * k + 1) for k in range(150)} and len(found) >= least * 150


def test_runs_along_many_lines():
    r, cfg = np.random.default_rng(2), windows.WindowConfig()
    lines = [np.concatenate([np.ones(r.integers(0, 70), bool) if r.random() < 0.3 else r.random(r.integers(1, 80)) < 0.9 for _ in range(4)]) for _ in range(60)]
    off = np.cumsum([0, *map(len, lines)])
    got = list(zip(*(x.tolist() for x in windows.matching_runs(np.concatenate(lines), off, cfg))))
    want = []
    for i, same in enumerate(lines):  # by definition
        runs, at = [], 0
        while at < len(same):
            if same[at]:
                e = at
                while e < len(same) and same[e]:
                    e += 1
                runs.append((at, e))
                at = e
            at += 1
        groups = []
        for s, e in runs:
            if groups and s - groups[-1][-1][1] <= cfg.max_gap:
                groups[-1].append((s, e))
            else:
                groups.append([(s, e)])
        for g in groups:
            s, e = g[0][0], g[-1][1]
            if e - s >= cfg.min_words and sum(y - x for x, y in g) >= cfg.similarity * (e - s):
                want.append((i, s, e))
            else:
                want += [(i, x, y) for x, y in g if y - x >= cfg.min_words]
    assert got == want and len(want) > 30


def test_compact_windows_are_the_nodes_of_the_cartesian_tree():
    cfg = windows.WindowConfig(min_words=12, shingle=3, functions=2)
    h, off = C.word_hashes(pa.array([" ".join(words(n, n, 6)) for n in (3, 11, 12, 40, 200)]))
    sh, to = C.shingles(h, off, cfg.shingle)
    got = {tuple(int(v) for v in x) for x in zip(*windows.compact_windows(sh, to, cfg), strict=True)}
    want = set()
    for f in range(2):
        v = windows.order_values(sh, f, cfg)
        for d in range(len(to) - 1):
            nodes = windows.cartesian_windows(v[to[d] : to[d + 1]].tolist(), cfg.width)
            reach = cfg.width - 1
            want |= {(f, d, max(a, c - reach) + int(to[d]), c + int(to[d]), min(b, c + reach) + int(to[d])) for a, c, b in nodes}
    assert got == want and len(got) > 20


def test_passage_of_many_documents_costs_in_proportion(spark):
    p = " ".join(words(60, 5))
    rows = [(i, f"{' '.join(words(30, 1000 + i))} {p}") for i in range(400)]
    assert {r.doc_id for r in windows.repeated_passages(table(spark, rows)).collect()} == set(range(1, 400))
    got = suffixes.repeated_passages(table(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(1, 400)) and all(r.source_doc < r.doc_id for r in got)  # equal segments have their first holder as source
    assert len(got) < 1200


@pytest.mark.parametrize("operator", [windows.repeated_passages, suffixes.repeated_passages])
def test_awkward_rows(spark, operator):
    got = operator(awkward(spark)).collect()
    assert {(r.doc_id, r.source_doc) for r in got} == {(2, 1), (9, 5)}
    assert max(r.end_word - r.start_word for r in got if r.doc_id == 9) == 60_000
    assert operator(empty(spark)).collect() == []


def brute_suffixes(t):
    t = list(t)
    sa, lcp = sorted(range(len(t)), key=lambda i: t[i:]), [0]
    for a, b in zip(sa, sa[1:], strict=False):
        k = 0
        while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(min(k, 255))
    return sa, lcp[: len(t)]


def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(1)
    for n in [*range(0, 30), 100, 300, 600]:
        for k in (1, 2, 4, 40):
            t = r.integers(0, k, n)
            if n % 3 == 0:
                t = np.tile(t[: max(1, n // 6)], 6)[:n]
            sa, lcp = suffix_array(t)
            want = brute_suffixes(t)
            assert sa.tolist() == want[0] and lcp.tolist() == want[1]


def level_of(segs, folder, memory):
    count, cut = np.array([len(x) for x in segs]), max(1, len(segs) // 2)

    def blocks():
        for a, b in ((0, cut), (cut, len(segs))):
            if b > a:
                yield np.concatenate(segs[a:b]), np.arange(a, b), count[a:b]

    return external.Level(blocks, len(segs), folder, memory)


@pytest.mark.parametrize("memory", [1, 40_000])  # all through files, and the deeper levels in memory
def test_external_sorting_by_brute_force(tmp_path, memory):
    r, folder = np.random.default_rng(4), external.Folder(f"file://{tmp_path}")
    for trial in range(40):
        segs = [r.integers(0, int(r.integers(1, 8)), int(r.integers(1, 30))) for _ in range(int(r.integers(1, 12)))]
        if trial % 3 == 0:
            segs = [segs[int(r.integers(len(segs)))] for _ in segs]
        want = sorted(((10**6 + x[o:]).tolist() + [s - 10**9], s, o) for s, x in enumerate(segs) for o in range(len(x)))
        got = []
        for rec, _, lcp in external.suffixes_down(level_of(segs, folder, memory), True):
            got += zip((rec["id"] >> external._BITS).tolist(), (rec["id"] & 1023).tolist(), lcp.tolist(), strict=True)
        assert [(s, o) for s, o, _ in got[::-1]] == [(s, o) for _, s, o in want]
        common = lambda a, b: next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)
        assert [n for _, _, n in got[1:]] == [common(want[i][0], want[i - 1][0]) for i in range(len(want) - 1, 0, -1)]


def test_queues_use_files_and_keep_the_order(tmp_path):
    r, dtype = np.random.default_rng(6), np.dtype([("key", "<i8"), ("n", "<i8")])
    folder = external.Folder(f"file://{tmp_path}")
    q, every, n = external.Queue(dtype, folder, 1), [], 0
    for _ in range(90):
        x = np.zeros(int(r.integers(0, 900)), dtype)
        x["key"], x["n"] = r.integers(0, 60, len(x)), np.arange(n, n + len(x))
        n += len(x)
        every.append(x)
        q.push(x)
    every = np.concatenate(every)
    assert folder.written > 30_000
    got = np.concatenate(list(q.blocks()))
    assert got["n"].tolist() == every["n"][np.argsort(every["key"], kind="stable")].tolist() and not list(tmp_path.iterdir())


def test_a_shard_larger_than_memory(spark):
    """All words in one shard of more than ten times the memory: the same passages as in memory."""
    rows = corpus()
    total = sum(len(t.split()) for _, t in rows)
    big = suffixes.repeated_passages(table(spark, rows)).collect()
    small = suffixes.repeated_passages(table(spark, rows), suffixes.SuffixConfig(memory=total)).collect()  # where 120 bytes a word are needed
    assert sorted(map(tuple, big)) == sorted(map(tuple, small)) and len(big) > 20
    missed, found = uncovered(rows, small)
    assert found > 500 and missed == 0


def test_range_minima():
    r = np.random.default_rng(2)
    a = r.integers(0, 255, 3000).astype(np.uint8)
    m, at = RangeMin(3000), 0
    while at < 3000:
        k = int(r.integers(1, 200))
        m.append(a[at : at + k])
        at = min(3000, at + k)
        lo = r.integers(0, at, 200)
        hi = np.minimum(at - 1, lo + r.integers(0, 400, 200))
        assert m.query(lo, hi).tolist() == [a[x : y + 1].min() for x, y in zip(lo, hi, strict=True)]


def test_a_phrase_of_all_documents_brings_no_segments_together(spark):
    """Unless a whole passage repeats: what the segments of a key have in common is nearly a passage."""
    phrase = " ".join(words(30, 7))
    rows = [(k, f"{' '.join(words(90, 1000 + k))} {phrase} {' '.join(words(90, 5000 + k))}") for k in range(300)]
    keys = suffixes.segment_table(table(spark, rows), suffixes.SuffixConfig()).select("key", "doc_id").distinct().groupBy("key").count()
    assert keys.count() > 3000 and keys.where("count > 1").count() == 0
    assert suffixes.repeated_passages(table(spark, rows)).count() == 0
    rows += [(900 + k, f"{' '.join(words(9, 20_000 + k))} {' '.join(words(90, 1003)[-25:])} {phrase} x{k}") for k in range(2)]
    missed, total = uncovered(rows, suffixes.repeated_passages(table(spark, rows)).collect())
    assert total > 0 and missed == 0
