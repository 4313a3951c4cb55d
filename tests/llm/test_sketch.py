import random

import numpy as np
import pyarrow as pa

from tarnwell.llm import common as C
from tarnwell.llm import sketch as S

from .helpers import awkward, empty, table, words


def sets(texts, q=3):
    h, off = C.word_hashes(pa.array(texts))
    s, to = C.shingles(h, off, q)
    return [set(s[to[i] : to[i + 1]].tolist()) for i in range(len(texts))]


def brute(rows, threshold=0.5):
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    ss, root = sets(texts), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            n = len(ss[i] & ss[j])
            if n and n / (len(ss[i]) + len(ss[j]) - n) >= threshold:
                x, y = sorted((find(a), find(ids[j])))
                root[y] = x
    return {(i, find(i)) for i in ids if find(i) != i}


def corpus():
    r, rows = random.Random(4), []
    for k in range(40):
        base = words(r.randrange(30, 400), 100 + k)
        for _ in range(r.randrange(1, 6)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 25)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    return rows


def test_same_groups_as_brute_force(spark):
    rows = corpus()
    got = {(r.doc_id, r.duplicate_of) for r in S.near_duplicates(table(spark, rows)).collect()}
    want = brute(rows)
    assert len(want) > 30 and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_registers_merge_and_estimate():
    cfg = S.SketchConfig(bands=200, rows=3)
    r = np.random.default_rng(0)
    sh = r.integers(0, 1 << 62, 3000).astype(np.uint64)
    a, b = sh[:2000], sh[1000:]
    x, y, both = (S.sketch_arrays(v, np.array([0, len(v)]), cfg)[0] for v in (a, b, sh))
    assert (np.maximum(x, y) == both).all()
    j = S.jaccard_mle(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([(x == y).sum()]), np.array([2000]), np.array([2000]), cfg.base)
    assert abs(j[0] - 1 / 3) < 0.07


def test_large_group_of_copies(spark):
    text = " ".join(words(80, 7))
    rows = [(i, text) for i in range(500)] + [(1000 + i, text + f" end{i}") for i in range(300)] + [(5000, " ".join(words(80, 8)))]
    got = S.near_duplicates(table(spark, rows)).collect()
    assert len(got) == 799 and {r.duplicate_of for r in got} == {0}


def test_partners_within_boilerplate(spark):
    """All documents share a third of their words; a few pairs are alike beyond that, far from each other in the order."""
    common, rows, r = words(120, 900), [], random.Random(6)
    for i in range(150):
        rows.append((i, " ".join(common + words(200, 1000 + i, 10**6))))
    for i in range(0, 150, 5):
        w = words(200, 1000 + i, 10**6)
        for _ in range(10):
            w[r.randrange(200)] = f"x{r.randrange(10**6)}"
        rows.append((1000 - i, " ".join(common + w)))
    want = brute(rows)
    for most in (128, 8):  # small buckets as they are, and large ones divided
        got = {(x.doc_id, x.duplicate_of) for x in S.near_duplicates(table(spark, rows), S.SketchConfig(most=most)).collect()}
        assert len(want) == 30 and len(got & want) >= 29 and not got - want


def test_divided_buckets_keep_pairs_that_agree_twice(spark):
    cfg = S.SketchConfig(bands=4, most=3)
    keys = [(i, [1, 10 + i, 20 + i, 30 + i]) for i in range(20)] + [(50, [1, 70, 71, 72]), (51, [1, 80, 71, 81])]
    bands = spark.createDataFrame(keys, "doc_id long, keys array<long>")
    none = spark.createDataFrame([], "id long, root long")
    assert [tuple(r) for r in S.other_pairs(bands, none, cfg).collect()] == [(50, 51)]
    same = spark.createDataFrame([(i, 0) for i in range(52)], "id long, root long")
    assert S.other_pairs(bands, same, cfg).collect() == []
    alike = spark.createDataFrame([(i, [1, 2, 3, 4]) for i in range(6)], "doc_id long, keys array<long>")
    assert sorted(tuple(r) for r in S.other_pairs(alike, none, cfg).collect()) == [(i, i + 1) for i in range(5)]


def sharing(rows, buckets, threshold=0.5):
    """Groups of the pairs that share a bucket and have the threshold in common, as brute force finds them."""
    ss, root = dict(zip([r[0] for r in rows], sets([r[1] for r in rows]), strict=True)), {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {(a, b) for ids in buckets for a in ids for b in ids if a < b}
    for a, b in pairs:
        n = len(ss[a] & ss[b])
        if n / (len(ss[a]) + len(ss[b]) - n) >= threshold:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, find(i)) for i in root if find(i) != i}


def buckets_of(docs, cfg):
    out = {}
    for r in S.band_table(S.sketch_table(docs, cfg), cfg).collect():
        for k in r["keys"]:
            out.setdefault(k, set()).add(r.doc_id)
    return list(out.values())


def half_alike(n, pairs, common, own, shared):
    """n documents of a common text and words of their own, and pairs more documents with a few of those of an earlier one."""
    boiler, rows = words(common, 900), []
    for i in range(n):
        rows.append((i, " ".join(boiler + words(own, 1000 + i, 10**6))))
    for i in range(pairs):
        rows.append((10_000 - i, " ".join(boiler + words(own, 1000 + 2 * i, 10**6)[:shared] + words(own - shared, 5000 + i, 10**6))))
    return rows


def test_pairs_that_agree_in_large_buckets_only(spark):
    rows = half_alike(60, 30, 110, 60, 20)
    docs = table(spark, rows)
    for block in (1024, 7):  # buckets in one block, and in several
        cfg = S.SketchConfig(bands=6, most=4, block=block)
        buckets = buckets_of(docs, cfg)
        want = sharing(rows, buckets)
        got = {(x.doc_id, x.duplicate_of) for x in S.near_duplicates(docs, cfg).collect()}
        assert max(map(len, buckets)) > 20 and len(want) >= 15 and got == want


def test_slope_says_what_the_estimate_says():
    r = np.random.default_rng(5)
    more = r.integers(0, 40, 5000)
    less = r.integers(0, 63 - more)
    nu, nv = r.integers(1, 400, (2, 5000))
    est = S.jaccard_mle(more, less, 63 - more - less, nu, nv, 1.001)
    got = S.reaches(more, less, 63 - more - less, nu, nv, 1.001, 0.3)
    sure = abs(est - 0.3) > 1e-6
    assert (got == (est >= 0.3))[sure].all() and 500 < got.sum() < 4500


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert {(r.doc_id, r.duplicate_of) for r in S.near_duplicates(docs).collect()} == {(2, 1), (9, 5)}
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "8", "None", "None"]


def test_empty_table(spark):
    assert S.near_duplicates(empty(spark)).collect() == [] and S.drop_near_duplicates(empty(spark)).collect() == []
