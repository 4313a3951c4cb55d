import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tarnwell.llm import common as C


def test_word_hashes_follow_words_alone():
    h, off = C.word_hashes(pa.array(["Ab cd, ab", None, "", "cd.", "été Été"]))
    assert off.tolist() == [0, 3, 3, 3, 4, 6]
    assert h[0] == h[2] and h[1] == h[3] and h[4] == h[5] and len(set(h.tolist())) == 3


def test_a_text_longer_than_a_slice_hashes_as_a_short_one():
    text = "ab " * 700_000
    h, _ = C.word_hashes(pa.array([text]))
    assert len(h) == 700_000 and len(np.unique(h)) == 1


def test_shingles():
    h, off = C.word_hashes(pa.array(["a b c d", "a b", "", "a b c"]))
    s, to = C.shingles(h, off, 3)
    assert to.tolist() == [0, 2, 3, 3, 4] and s[0] == s[3] and s[2] != s[0]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 3), (7, 7), (20, 11), (20, 21), (30, 21)], "a long, b long")
    got = {r.id: r.root for r in C.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 1, 10: 10, 11: 10, 20: 10, 21: 10, 30: 10}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in C.components(chain).collect()} == {0}
    assert C.components(edges.limit(0)).collect() == []


def test_fresh(spark):
    assert C.fresh(spark.createDataFrame([(1, 2)], "_N int, __n int"), "_n") == "___n"


def test_lists_have_a_bound(spark):
    df = spark.range(6000).selectExpr("if(id < 5990, 1, 2) AS k", "id AS v")
    got = C.lists(df, "k", df["v"], "vs", 500).collect()
    assert max(len(r.vs) for r in got) < 800 and sorted(v for r in got for v in r.vs) == list(range(6000)) and [sorted(r.vs) for r in got if r.k == 2] == [list(range(5990, 6000))]


def test_durable_tables(spark):
    before = spark.conf.get(C._CLEAN)
    t = C.durable(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    assert spark.conf.get(C._CLEAN) == before and t.agg(F.sum("count")).first()[0] == 100
    files = t.inputFiles()
    C.drop_durable(t)
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
    with pytest.raises(AnalysisException):
        C.durable(spark.range(3).select("nothing"), "t")
    assert spark.conf.get(C._CLEAN) == before
