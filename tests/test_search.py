import numpy as np
import pytest

from tarnwell.config import IndexConfig
from tarnwell.functions import distance as D
from tarnwell.operators import hnsw, ivf, knn
from tarnwell.sources import store


def unit(n, dim, seed=42):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, key="vec_id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, embedding array<double>")


def true_top(q, x, k, metric="l2"):
    d = D.pairwise(q, x, metric)
    return [np.lexsort([np.arange(len(x)), r])[:k].tolist() for r in d]


def by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id, r.distance))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_exact_top_k(spark, metric):
    x, q = unit(700, 16), unit(30, 16, 999)
    got = by_query(knn.top_k(frame(spark, q, "query_id"), frame(spark, x), 20, metric))
    assert [[i for i, _ in got[n]] for n in range(30)] == true_top(q, x, 20, metric)
    assert all(a[1] <= b[1] for r in got.values() for a, b in zip(r, r[1:], strict=False))


def test_edges(spark):
    one = spark.createDataFrame([(100, [1.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    r = knn.top_k(q, one, 5).collect()
    assert len(r) == 1 and r[0].id == 100 and r[0].distance < 1e-6 and r[0].score == 1
    assert knn.top_k(q, one.limit(0), 5).collect() == []
    twice = spark.createDataFrame([(42, [1.0, 0.0, 0.0, 0.0]), (42, [0.0, 1.0, 0.0, 0.0])], one.schema)
    assert [x.id for x in knn.top_k(q, twice, 5).orderBy("rank").collect()] == [42, 42]
    with pytest.raises(Exception, match="dimensions"):
        knn.top_k(spark.createDataFrame([(0, [1.0])], q.schema), one, 1).collect()
    three = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0, 0.0, 0.0])], one.schema)
    with pytest.raises(Exception, match="dimensions"):  # of the same size together
        knn.top_k(q, three.coalesce(1), 5).collect()
    with pytest.raises(Exception, match="dimensions"):
        ivf.Cells(np.zeros((1, 4))).assign(three).collect()
    holes = spark.createDataFrame([(1, [0.0, 0.0, 0.0, 0.0]), (2, [None, 0.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0, 0.0]), (4, None), (5, [float("nan"), 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])], one.schema)
    assert [x.id for x in knn.top_k(q, holes, 5).orderBy("rank").collect()] == [3, 1]
    cells = ivf.Cells.fit(holes, 2)
    assert {x.vec_id: x.cell is None for x in cells.assign(holes).collect()} == {1: False, 2: True, 3: False, 4: True, 5: True, None: False}
    assert [x.id for x in ivf.search(q, cells.assign(holes), cells, 5, 2).orderBy("rank").collect()] == [3, 1]
    cfg = IndexConfig(dim=4, m=4)
    assert [x.id for x in hnsw.search(q, holes, 5, cfg).orderBy("rank").collect()] == [3, 1]
    with pytest.raises(Exception, match="dimensions"):
        hnsw.search(spark.createDataFrame([(0, [1.0])], q.schema), holes, 1, cfg).collect()
    with pytest.raises(Exception, match="expected 3 dimensions"):
        knn.check_dim(one, "embedding", 3).collect()


def test_self_is_nearest(spark):
    x = unit(100, 8)
    assert all(r[0][0] == q for q, r in by_query(knn.top_k(frame(spark, x, "query_id"), frame(spark, x), 1)).items())


def test_pairs(spark):
    x, q = unit(50, 5), unit(7, 5, 1)
    got = {(r.query_id, r.id): r.distance for r in knn.pairs(frame(spark, q, "query_id"), frame(spark, x), "l2").collect()}
    d = D.pairwise(q, x, "l2")
    assert len(got) == 350 and all(abs(v - d[k]) < 1e-9 for k, v in got.items())


def test_cells_and_recall(spark):
    x, q = unit(3000, 16), unit(50, 16, 999)
    queries, vectors = frame(spark, q, "query_id"), frame(spark, x)
    cells = ivf.Cells.fit(vectors, 16)
    indexed = cells.assign(vectors)
    true = knn.top_k(queries, vectors, 10)
    found = {n: ivf.search(queries, indexed, cells, 10, n) for n in (1, 10, 16)}
    recall = {n: knn.recall(f, true).first().recall for n, f in found.items()}
    assert recall[1] <= recall[10] <= recall[16] == 1.0 and recall[10] > 0.9


def test_graph_search():
    x = unit(2000, 32)
    g = hnsw.Graph(IndexConfig(dim=32, m=8, m_max0=16, ef_construct=60))
    assert g.search(x[0], 3) == []
    for i, v in enumerate(x):
        g.insert(i, v)
    q = unit(30, 32, 555)
    true = true_top(q, x, 10)
    hits = {ef: sum(len({i for _, i in g.search(v, 10, ef)} & set(t)) for v, t in zip(q, true, strict=True)) for ef in (16, 256)}
    assert hits[256] >= hits[16] and hits[256] > 0.9 * 300 and len(g) == 2000
    assert all(len(n) <= 16 for n in g.layers[0].values())
    with pytest.raises(ValueError):
        g.insert(0, x[0][:3])


def test_sharded_graphs(spark):
    x, q = unit(600, 16), unit(20, 16, 5)
    cfg = IndexConfig(dim=16, m=8, m_max0=16, ef_construct=40, ef_search=40)
    queries, vectors = frame(spark, q, "query_id"), frame(spark, x)
    true = knn.top_k(queries, vectors, 10)
    assert knn.recall(hnsw.search(queries, vectors, 10, cfg, per_shard=200), true).first().recall > 0.9
    index = store.saved(hnsw.build(vectors.where("vec_id < 400"), cfg, per_shard=200))
    more = store.saved(hnsw.add(index, vectors.where("vec_id >= 400"), cfg, per_shard=200))
    assert {r.shard: r.n for r in more.collect()}.keys() == {0, 1, 2} and sum(r.n for r in more.collect()) == 600
    assert knn.recall(hnsw.find(queries, more, 10, cfg), true).first().recall > 0.9


def test_a_graph_is_read_as_it_was_written():
    x, cfg = unit(300, 8), IndexConfig(dim=8, m=4, m_max0=8, ef_construct=20)
    g = hnsw.Graph(cfg)
    for i, v in enumerate(x):
        g.insert(i, v)
    back = hnsw.Graph.from_bytes(g.to_bytes(), cfg)
    assert back.layers == g.layers and back.ids == g.ids and all(back.search(q, 5, 30) == g.search(q, 5, 30) for q in unit(20, 8, 3))
    back.insert(300, x[0])
    assert len(back) == 301 and hnsw.Graph.from_bytes(hnsw.Graph(cfg).to_bytes(), cfg).search(x[0], 3) == []


def test_graph_of_cells(spark):
    v = frame(spark, unit(800, 8))
    cells = ivf.Cells.fit(v)
    assert 20 <= len(cells.centres) <= 28
    exact = knn.graph(v, 6).withColumnsRenamed({"src": "query_id", "dst": "id"})
    near = ivf.graph(v, 6, cells, len(cells.centres) // 2)
    assert knn.recall(near.withColumnsRenamed({"src": "query_id", "dst": "id"}), exact).first().recall > 0.9
    assert near.where("src = dst").count() == 0 and knn.heuristic_graph(v, 4, 6, near=near).groupBy("src").count().where("count = 4").count() == 800


def test_standing_tables_are_built_once(spark, tmp_path):
    frame(spark, unit(20, 4)).write.parquet(str(tmp_path / "v"))
    built = []

    def ask():
        v = spark.read.parquet(str(tmp_path / "v"))
        return store.standing(spark, "test", v, lambda: built.append(1) or v.select("vec_id")).count()

    assert (ask(), ask(), len(built)) == (20, 20, 1)
    frame(spark, unit(5, 4)).write.mode("append").parquet(str(tmp_path / "v"))
    assert (ask(), len(built)) == (25, 2)
    assert store.get_vector(spark.read.parquet(str(tmp_path / "v")), 99) is None


def test_levels(spark):
    rows = spark.range(200_000).select(hnsw.level("id", 4).alias("l")).groupBy("l").count().collect()
    n = {r.l: r["count"] for r in rows}
    assert abs(sum(c for lv, c in n.items() if lv >= 1) / 200_000 - 1 / 4) < 0.01 and abs(sum(c for lv, c in n.items() if lv >= 2) / 200_000 - 1 / 16) < 0.005
    with pytest.raises(ValueError):
        hnsw.level("id", 1)


def test_diverse_edges(spark):
    x = unit(200, 6)
    got = {}
    for r in knn.heuristic_graph(frame(spark, x), 5, 15).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    d = D.pairwise(x, x, "l2")
    np.fill_diagonal(d, np.inf)
    for src in range(200):
        near = np.argsort(d[src])[:15]
        chosen, rest = [], []
        for c in near:
            if len(chosen) == 5:
                break
            (rest if any(d[c, s] < d[c, src] for s in chosen) else chosen).append(int(c))
        assert got[src] == chosen + rest[: 5 - len(chosen)]


def test_reverse_edges(spark):
    e = spark.createDataFrame([(1, 2, 0.1), (3, 2, 0.2), (4, 2, 0.3)], "src long, dst long, distance double")
    got = {(r.src, r.dst) for r in knn.reverse_connect(e, 2).collect()}
    assert got == {(1, 2), (3, 2), (4, 2), (2, 1), (2, 3)}


def test_near_pairs_are_all_pairs_below_a_distance(spark):
    x = np.concatenate([unit(300, 6), unit(40, 6) * 3, unit(20, 6) * 1e-20, unit(60, 6)])  # other norms, and copies
    v = frame(spark, x).repartition(3)
    q = v.withColumnRenamed("vec_id", "query_id")
    all_pairs = {(r.query_id, r.id): r.distance for r in knn.pairs(q, v, "l2").where("distance <= 0.25").collect()}
    assert {(r.query_id, r.id): r.distance for r in knn.pairs(q, v, "l2", most=0.25).collect()} == all_pairs and len(all_pairs) > 420


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_near_over_many_matrices(metric):
    """The k nearest of matrices that come one after another are those of all of them, with copies, cells and bounds."""
    x = np.concatenate([unit(500, 6), unit(100, 6), np.zeros((30, 6)), unit(50, 6) * 1e-19, unit(50, 6) * 1e9])
    ids, q = np.random.default_rng(0).permutation(len(x)), x[::5]
    probes, cells = np.random.default_rng(1).random((len(q), 7)) < 0.5, (ids % 7).astype(np.int32)
    d = np.stack([D.exact(v[None], x, metric) for v in q])
    for own, least in ((np.ones_like(d, bool), None), (probes[:, cells], None), (ids[::5, None] != ids, None), (np.ones_like(d, bool), np.sort(d, axis=1)[:, 8])):
        by_cell, no_self = (own == probes[:, cells]).all(), (own == (ids[::5, None] != ids)).all()
        near = knn.Near(ids[::5], q, metric, 8, skip_self=bool(no_self), probes=probes if by_cell else None, bound=least)
        for s in range(0, len(x), 90):
            near.meet(ids[s : s + 90], x[s : s + 90], cells[s : s + 90] if by_cell else None)
        for i in range(len(q)):
            want = [(d[i, j], ids[j]) for j in np.lexsort([ids, d[i]]) if own[i, j]][:8]
            assert [x for x in zip(near.d[i], near.at[i], strict=True) if x[0] < np.inf] == want


def test_a_query_goes_once_to_the_matrices_of_its_cells(spark, monkeypatch):
    """However many cells it reads, and also where each task has some of the matrices only; the results are those of the cells."""
    monkeypatch.setattr(knn, "ROWS", 64)
    x = unit(700, 6)
    v = frame(spark, x)
    cells = ivf.Cells.fit(v, 20)
    rows: list[int] = []
    meet = knn.meet
    monkeypatch.setattr(knn, "meet", lambda q, *a: rows.append(sum(len(r.qids) for r in q.select("qids").collect())) or meet(q, *a))
    got = by_query(ivf.search(v.withColumnRenamed("vec_id", "query_id"), cells.assign(v), cells, 5, 12, skip_self=True))
    assert rows == [700]  # not 700 x 12
    d, own = D.pairwise(x, x, "l2"), cells.probed(x, 12)[:, cells.nearest(x)]
    d[~own | np.eye(700, dtype=bool)] = np.inf
    assert [[i for i, _ in got[n]] for n in range(700)] == [np.lexsort([np.arange(700), r])[:5].tolist() for r in d] and (cells.probed(x, 12).sum(1) == 12).all()


def test_complete_search_of_graphs_misses_nothing(spark):
    """Where a narrow beam over several shards does miss, and with copies, which a graph keeps apart."""
    x = np.concatenate([unit(900, 24), unit(900, 24)[:40]])
    cfg = IndexConfig(dim=24, m=3, m_max0=4, ef_construct=8, ef_search=10)
    v, q = frame(spark, x), frame(spark, x[::3], "query_id").repartition(3)
    index = store.saved(hnsw.build(v, cfg, per_shard=300))
    true = knn.top_k(q, v, 10)
    assert knn.recall(hnsw.find(q, index, 10, cfg), true).first().recall < 1
    assert knn.recall(hnsw.complete(q, index, 10, cfg), true).first().recall == 1.0
    assert by_query(hnsw.complete(q, index, 10, cfg)) == by_query(true)
    assert hnsw.complete(q, index.limit(0), 10, cfg).collect() == []
    few = index.where("shard = 0 AND n < 0").unionByName(hnsw.build(v.limit(4), cfg))
    assert all(len(r) == 4 for r in by_query(hnsw.complete(q.limit(5), few, 10, cfg)).values())


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_diverse_edges_of_many_sources_at_once(metric):
    x, count = np.random.default_rng(2).normal(size=(60, 15, 5)), np.random.default_rng(3).integers(0, 16, 60)
    d = np.sort(D.exact(x, np.zeros((1, 1, 5)) + 0.3, metric), axis=1)
    got = knn.diverse_rows(x, d, count, 6, metric)
    assert [[int(i) for i in r if i >= 0] for r in got] == [knn.diverse(x[k, : count[k]], d[k, : count[k]], 6, metric) for k in range(60)]
