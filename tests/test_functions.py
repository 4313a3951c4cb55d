import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.config import ChunkConfig
from tarnwell.functions import distance as D
from tarnwell.functions import hashing as H
from tarnwell.functions import text as T


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def vec(*x):
    return F.array(*[F.lit(float(v)).cast("float") for v in x])


def test_distances(spark):
    a, b = vec(1, 2, 3), vec(1, 2, 3)
    r = one(spark, same=D.l2_sq(a, b), two=D.l2_sq(vec(1, 0), vec(0, 1)), orth=D.neg_ip(vec(1, 0, 0), vec(0, 1, 0)), ip=D.neg_ip(a, b), odd=D.l2_sq(vec(1, 2, 3, 4, 5), vec(5, 4, 3, 2, 1)))
    assert (r.same, r.two, r.ip, r.odd) == (0, 2, -14, 40) and str(r.orth) == "0.0"


def test_columns_and_numpy_agree(spark):
    a, b = [(i % 37) / 37 for i in range(768)], [((i * 7 + 13) % 41) / 41 for i in range(768)]
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(D.l2_sq(F.col("a"), F.col("b")).alias("l2"), D.neg_ip(F.col("a"), F.col("b")).alias("ip")).first()
    x, y = np.array([a]), np.array([b])
    for metric, got in (("l2", df.l2), ("ip", df.ip)):
        assert abs(D.exact(x, y, metric)[0] - got) < 1e-6 and abs(D.pairwise(x, y, metric)[0, 0] - got) < 1e-6


def test_score_and_normalize(spark):
    r = one(spark, half=D.score(F.lit(1.0)), inf=D.score(F.lit(-1.0)), neg=D.score(F.lit(-3.0)), n=D.normalize(vec(3, 4)), z=D.normalize(vec(0, 0)), norm=D.norm(vec(3, 4)))
    assert r.half == 0.5 and r.inf == float("inf") and r.neg == -0.5 and r.n == [0.6, 0.8] and r.z == [0, 0] and r.norm == 5


def slow_chunks(text, size, overlap):
    """The rules one after another, on single positions."""
    size, overlap, out, at = 4 * size, 4 * overlap, [], 0
    while text:
        end = min(at + size, len(text))
        if end < len(text):
            for sep in ("\n\n", "\n"):
                places = [i for i in range(at + size // 2 + 1, end + 1) if text.startswith(sep, i)]
                if places:
                    end = places[-1] + len(sep)
                    break
        out.append((at, end))
        if end >= len(text):
            break
        at = end - overlap if end > overlap else end
    return out


def test_chunk_bounds():
    r = random.Random(0)
    for size, overlap in ((5, 1), (8, 4), (3, 0), (6, 3), (1, 0)):
        for _ in range(300):
            t = "".join(r.choice("ab\n\n\né") for _ in range(r.randrange(120)))
            got = T.chunk_bounds(t, ChunkConfig(size, overlap))
            assert got == slow_chunks(t, size, overlap) and all(e - s <= 4 * size + 2 for s, e in got)
            assert not t or (got[0][0] == 0 and got[-1][1] == len(t))


def test_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 30), (2, ""), (3, None), (4, "aaaa\n\nbbbbbb" * 3)], "doc_id long, text string")
    rows = T.chunks(df, ChunkConfig(5, 1)).collect()
    assert {r.doc_id for r in rows} == {1, 4} and [r.text for r in rows if r.doc_id == 1] == ["x" * 20, "x" * 14]


def test_hashes(spark):
    texts = ["", "abcé", "日本", "a" * 5000]

    def djb2(s):
        h = 5381
        for b in s.encode():
            h = (h * 33 + (b if b < 128 else b - 256)) % 2**64
        return h

    assert [H.djb2(t) for t in texts] == [djb2(t) for t in texts]
    h, v = djb2("abcé"), []
    for _ in range(8):
        h = (h * H.LCG_A + H.LCG_C) % 2**64
        s = h - 2**64 if h >= 2**63 else h
        v.append((abs(s) % 1000) * (1 if s >= 0 else -1) / 1000)
    assert np.allclose(H.hash_vectors(["abcé"], 8)[0], np.array(v) / np.linalg.norm(v))
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = [r.h for r in df.select(H.fnv1a("t").alias("h")).collect()]
    assert got[0] == 14695981039346656037 - 2**64 and got[-1] is None and len(set(got)) == 5
    assert df.select(H.hash_embed("t", 4).alias("v")).where("v IS NULL").count() == 1


def test_keywords_and_templates(spark):
    hits = lambda q, t: T.keyword_hits(F.lit(q), F.lit(t))
    r = one(spark, sub=hits("Graph graph  x\tÉ", "graphical É"), none=hits("  ", "a"), case=hits("ABC", "xabcx"))
    assert (r["sub"], r["none"], r["case"]) == (3, 0, 1)  # every occurrence of a word counts, É isn't folded
    fill = lambda c, q: T.fill_template("C:{context} Q:{query} {query}", F.lit(c), F.lit(q))
    r = one(spark, plain=fill("ctx", "q"), captured=fill("has {query} inside", "$1"), none=T.fill_template("nothing", F.lit("c"), F.lit("q")))
    assert r.plain == "C:ctx Q:q {query}" and r.captured == "C:has $1 inside Q:{query} {query}" and r["none"] == "nothing"


@pytest.mark.parametrize(("x", "text"), [(0.5, "0.5"), (0.333333333, "0.333333"), (1.0, "1"), (0.0, "0"), (12.3456789, "12.3457"), (0.000123456789, "0.000123457"), (123456.4, "123456")])
def test_general_numbers(spark, x, text):
    assert one(spark, t=T.general(F.lit(x))).t == text


def test_random_unit_vectors(spark):
    rows = [r.embedding for r in D.random_units(spark, 20, 8).collect()]
    assert all(abs(np.linalg.norm(v) - 1) < 1e-12 for v in rows) and len({tuple(v) for v in rows}) == 20


def test_hits_of_all_pairs_are_those_of_each_pair(spark):
    texts = ["graphical É ß", None, "", "xabcx ABC graph", "x" * 300 + "Graph" + "y" * 300, "a\tb\x0bc\fgraph x", "éÉ" * 50, "ABC" * 40 + " " + "z" * 70]
    queries = ["Graph graph  x\tÉ", "", None, "  ", "ABC a b c abc", "ß  é", " x y", "z" * 65]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "graph")], "doc_id int, text string")
    asked = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "query_id string, query string")
    got = T.hit_table(docs, asked)
    pairs = docs.crossJoin(asked).select("query_id", "doc_id", T.keyword_hits(F.col("query"), F.col("text")).alias("hits"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert got.dtypes == pairs.dtypes and rows(got) == rows(pairs) and len(rows(got)) == 72
    many = T.Keywords([f"w{i} w{i}" for i in range(3000)] + ["w1"])
    assert many.hits(["W12 w12 nothing"])[0, [1, 12, 120, 3000]].tolist() == [2, 2, 0, 1] and many.hits(["w2999"])[0].sum() == 8


def test_long_columns_are_cut_some_rows_at_a_time():
    import pyarrow as pa

    seen = []
    out = T.sliced(lambda x, y: seen.append(len(x)) or pa.array([[a] * b for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.list_(pa.string())), pa.array(["a", None] * 500), pa.array([1, 2] * 500), rows=64)
    assert max(seen) == 64 and sum(seen) == 1000 and out.to_pylist() == [["a"], [None, None]] * 500
    assert T.sliced(lambda x: x, pa.array([], pa.string())).to_pylist() == []
