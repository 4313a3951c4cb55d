import math

import numpy as np

from tarnwell.llm import mixing as M

from .helpers import awkward, empty, table


def test_pivotal_keeps_sums_and_expectations():
    r = np.random.default_rng(0)
    p = r.random(9)
    total = np.zeros(9)
    for _ in range(6000):
        q, at = M.pivotal(p, r.random(9))
        rest = q[at] if at >= 0 else 0
        assert abs(q.sum() - p.sum()) < 1e-9 and set(np.delete(q, at) if at >= 0 else q) <= {0.0, 1.0} and 0 <= rest < 1
        total += q
    assert np.abs(total / 6000 - p).max() < 0.03


def expected(rows, cfg):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t)
    w = {s: n**cfg.exponent for s, n in size.items()} if cfg.weights is None else {s: cfg.weights.get(s, 0) for s in size}
    return {s: w[s] / sum(w.values()) * sum(size.values()) * cfg.total / size[s] for s in size}


def check(spark, rows, cfg):
    got = {r.doc_id: r for r in M.mix(table(spark, rows), cfg).collect()}
    assert set(got) == {r[0] for r in rows}
    for s, e in expected(rows, cfg).items():
        c = [got[d].copies for d, _, x in rows if x == s]
        assert set(c) <= {math.floor(e + 1e-9), math.ceil(e - 1e-9)}
        assert math.floor(e * len(c) - 1e-6) <= sum(c) <= math.ceil(e * len(c) + 1e-6)
    return {d: r.copies for d, r in got.items()}


def corpus():
    return [(i, "x" * (1 + i % 7), "abc"[min(2, i % 10 // 4)]) for i in range(2000)]


def test_each_source_meets_its_share(spark):
    first = check(spark, corpus(), M.MixConfig(fan_in=2))
    assert first == check(spark, corpus(), M.MixConfig(fan_in=2))  # runs repeat themselves
    check(spark, corpus(), M.MixConfig(weights={"a": 0.2, "b": 0.8}, total=2.5))


def test_documents_have_their_expectation(spark):
    rows = [(i, "xx", "a") for i in range(30)] + [(100 + i, "xx", "b") for i in range(10)]
    n = np.zeros(30)
    for seed in range(12):
        got = check(spark, rows, M.MixConfig(seed=seed))
        n += [got[i] for i in range(30)]
    assert abs(n.mean() / 12 - expected(rows, M.MixConfig())["a"]) < 0.05 and n.max() <= 12 * math.ceil(expected(rows, M.MixConfig())["a"])


def test_the_query_by_brute_force(spark):
    """One partition: pairs of each source meet in the order of their hash, one after another, in plain Python."""
    rows, cfg = corpus()[:300], M.MixConfig()
    docs = table(spark, rows)
    order = {r.doc_id: r.o for r in docs.selectExpr("doc_id", f"xxhash64(doc_id, {cfg.seed}) AS o").collect()}
    u = dict(zip([r[0] for r in rows], M.uniforms(np.array([r[0] for r in rows]), cfg.seed)))
    want = {}
    for s, e in expected(rows, cfg).items():
        ids = sorted((d for d, _, x in rows if x == s), key=lambda d: (order[d], d))
        base, held = math.floor(e), None  # held: the document with a fraction, and the fraction
        for d in ids:
            want[d], p = base, e - base
            if p < 1e-9:
                continue
            if held is None:
                held = (d, p)
                continue
            h, q = held
            if p + q < 1:  # the mass goes to one of the two
                held = (h, p + q) if u[d] * (p + q) < q else (d, p + q)
            else:  # one of the two is full
                full = u[d] * (2 - p - q) < 1 - p
                want[h if full else d] += 1
                held = (d if full else h, p + q - 1)
            if held[1] < 1e-9 or held[1] > 1 - 1e-9:
                want[held[0]] += round(held[1])
                held = None
        if held is not None:
            want[held[0]] += M._uniform(held[0], 1, cfg.seed) < held[1]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.doc_id: r.copies for r in M.mix(docs.coalesce(1), cfg).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = M.mix(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 10)) and all(r.copies >= 0 for r in got)
    out = M.mixed(docs)
    assert out.columns == docs.columns
    copies = {r.doc_id: r.copies for r in got}
    assert out.count() == sum(copies[r.doc_id] for r in docs.collect() if r.doc_id is not None)
    assert M.mix(empty(spark)).collect() == [] and M.mixed(empty(spark)).collect() == []
    assert {r.copies for r in M.mix(table(spark, [(1, "", "a"), (2, None, "b")])).collect()} == {0}
