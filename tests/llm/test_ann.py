import numpy as np

from tarnwell.llm import ann as A


def rows_of(x, start=0):
    return [(start + i, [float(v) for v in r]) for i, r in enumerate(x)]


def recall(got, x, k=10):
    d = A.squared(x, x)
    np.fill_diagonal(d, np.inf)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.neighbour] = r
    hits = 0
    for i in range(len(x)):
        true = set(np.argpartition(d[i], k - 1)[:k].tolist())
        hits += len(true & set(by[i]))
        assert sorted(r["rank"] for r in by[i].values()) == list(range(1, k + 1))
        assert all(abs(r.distance - d[i, j]) < 1e-5 for j, r in by[i].items())
    return hits / (k * len(x))


def blobs(n, dim, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)) + 2 * r.normal(size=(10, dim))[r.integers(0, 10, n)]
    return x.astype(np.float32).astype(float)


def test_recall_of_every_row(spark):
    x = blobs(1500, 32)
    df = spark.createDataFrame(rows_of(x), "vec_id long, embedding array<float>")
    assert recall(A.neighbours(df).collect(), x) >= 0.9


def test_the_tree_has_many_leaves_and_few_are_visited(spark):
    x = blobs(4000, 8, 3)
    t = A.Tree(x.astype(np.float32), 4000 // 32, A.AnnConfig())
    placed = spark.createDataFrame([(int(n), i, [float(c) for c in v]) for i, (n, v) in enumerate(zip(t.assign(x.astype(np.float32)), x))], "leaf long, id long, v array<float>")
    ids = np.arange(0, 4000, 20)
    visits = A.calibrated(t, placed, ids, x[ids].astype(np.float32), A.AnnConfig())
    assert t.leaves >= 120 and visits <= t.leaves // 3
    df = spark.createDataFrame(rows_of(x), "vec_id long, embedding array<float>")
    got = A.neighbours(df, A.AnnConfig(block=200, queries=50), every=20).collect()  # many cells, and blocks within them
    d = A.squared(x, x)
    np.fill_diagonal(d, np.inf)
    found = {(r.vec_id, r.neighbour) for r in got}
    true = {(int(i), int(j)) for i in ids for j in np.argsort(d[i])[:10]}
    assert {r.vec_id for r in got} == set(ids.tolist()) and len(found & true) >= 0.93 * len(true)


def test_brute_force_pass_is_exact(spark):
    x = blobs(500, 6, 5)
    placed = spark.createDataFrame([(0, i, [float(c) for c in v]) for i, v in enumerate(x)], "leaf long, id long, v array<float>").repartition(3)
    ids = np.arange(0, 500, 50)
    got = {(r.t, r.id) for r in A.true_neighbours(placed, ids, x[ids].astype(np.float32), 7).collect()}
    d = A.squared(x, x)
    np.fill_diagonal(d, np.inf)
    assert got == {(t, int(j)) for t, i in enumerate(ids) for j in np.argsort(d[i])[:7]}


def test_best_bin_first_goes_from_near_to_far():
    x = blobs(800, 4, 2)
    t = A.Tree(x, 30, A.AnnConfig(branch=4))
    v = np.array(list(t.visits(x[:5], t.leaves)))
    assert t.leaves >= 30 and all(sorted(row.tolist()) == sorted(np.flatnonzero(t.count == 0).tolist()) == sorted(t.order()) for row in v)
    assert (v[:, 0] == t.assign(x[:5])).mean() == 1.0
    size = np.where(t.count == 0, 2, 0)
    assert [len(o) for o in t.visits(x[:3], 1, size, 11)] == [6, 6, 6]  # goes on until it has seen enough


def test_awkward_rows(spark):
    rows = [(1, [0.0, 0.0], "own"), (2, [0.0, 0.0], "own"), (2, [0.0, 0.0], "own"), (3, None, "own"), (None, [1.0, 1.0], "own"), (4, [1.0], "own"), (5, [None, 1.0], "own"), (6, [float("nan"), 1.0], "own"), (7, [3.0, 4.0], None), (8, [], "own")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string")
    got = sorted((r.vec_id, r["rank"], r.neighbour, r.distance) for r in A.neighbours(df).collect())
    assert got == [(1, 1, 2, 0.0), (1, 2, 7, 25.0), (2, 1, 1, 0.0), (2, 2, 7, 25.0), (7, 1, 1, 25.0), (7, 2, 2, 25.0)]
    assert A.neighbours(df.limit(0)).collect() == []
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert A.neighbours(one).collect() == []


def test_many_equal_vectors_meet_in_blocks(spark):
    x = np.zeros((300, 3))
    df = spark.createDataFrame(rows_of(x), "vec_id long, embedding array<float>")
    got = A.neighbours(df, A.AnnConfig(leaf=20, block=70, queries=90)).collect()
    assert len(got) == 3000 and {r.neighbour for r in got if r.vec_id == 250} == set(range(10))
