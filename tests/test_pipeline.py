import json

import pytest
from pyspark.sql import functions as F

from tarnwell.config import ChunkConfig, IndexConfig, PipelineConfig
from tarnwell.functions import hashing, text
from tarnwell.functions.hashing import hash_embed
from tarnwell.operators import batching, metrics, prefix, rag
from tarnwell.sources import embedding_api, ingest, store
from tarnwell.streaming import batches


def embed(c):
    return hash_embed(c, 16)


def docs(spark):
    rows = [(1, "Graph search walks a layered graph. " * 3), (2, "Chunks overlap so that nothing is lost."), (3, "Batches are formed by system message."), (4, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_ingest_and_retrieve(spark):
    chunks = ingest.chunk_table(docs(spark), embed, ChunkConfig(10, 2))
    rows = chunks.orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(len(rows))) and [(r.doc_id, r.chunk_idx) for r in rows] == sorted((r.doc_id, r.chunk_idx) for r in rows)
    c = ingest.counts(docs(spark), chunks).first()
    assert (c.documents_indexed, c.chunks_created, c.vectors_inserted) == (4, len(rows), len(rows))
    queries = spark.createDataFrame([(0, "How does graph search work?"), (1, "")], "query_id long, query string")
    got = rag.retrieve(queries, chunks, embed, PipelineConfig(top_k=5, top_n=2)).collect()
    assert len(got) == 2 and {r.query_id for r in got} == {0} and all(r.text for r in got)
    full = {r.query_id: r for r in rag.query(queries, chunks, embed, lambda p: F.concat(F.lit("echo "), p)).collect()}
    assert full[0].answer.startswith("echo Answer") and "[1] " in full[0].prompt and full[1].sources is None and full[1].answer.endswith("Answer:")
    none = rag.query(queries, chunks.limit(0), embed, lambda p: p).collect()
    assert len(none) == 2 and all(r.sources is None for r in none)


def found(spark, n):
    rows = [(7, "Graph GRAPH", k, k, float(k), 1 / (1 + k), "graphical" if k == n else "other") for k in range(1, n + 1)]
    return spark.createDataFrame(rows, "query_id long, query string, rank int, id long, distance double, score double, text string")


def test_rerank(spark):
    on = PipelineConfig(top_n=2, enable_rerank=True)
    got = rag.rerank(found(spark, 4), on).orderBy("rank").collect()
    assert [r.id for r in got] == [4, 1] and abs(got[0].score - (0.7 * 0.2 + 0.3 * 2)) < 1e-12
    got = rag.rerank(found(spark, 2), on).orderBy("rank").collect()  # no more than top_n: as they were
    assert [r.id for r in got] == [1, 2] and got[0].score == 0.5
    assert [r.id for r in rag.rerank(found(spark, 4), PipelineConfig(top_n=2)).orderBy("rank").collect()] == [1, 2]


def test_tool_output_and_context_cut(spark):
    q = spark.createDataFrame([(7, "q"), (8, "r")], "query_id long, query string")
    out = {r.query_id: r.output for r in rag.tool_output(q, found(spark, 3), 2).collect()}
    assert out[7] == "Found 2 relevant passages:\n\n--- Result 1 (score: 0.5) ---\nother\n\n--- Result 2 (score: 0.333333) ---\nother\n\n" and out[8] == "Found 0 relevant passages:\n\n"
    cut = rag.augment(q, found(spark, 3), PipelineConfig(max_context_tokens=2, prompt_template="{context}|{query}")).orderBy("query_id").first()
    assert cut.prompt == "[1] othe|q"


def test_prefixes(spark):
    p = spark.createDataFrame([("You are a helpful assistant", 1), ("You are a helpful bot. x", 2), ("You", 3), ("", 9), ("zero", 0), ("You", 4), ("é", 5)], "prefix string, cache_id long")
    t = spark.createDataFrame([(1, "You are a helpful assistant. Hi"), (2, "You there"), (3, "nothing"), (4, "zero"), (5, "été"), (6, None)], "k long, text string")
    best = prefix.latest(p)
    got = {r.k: (r.cache_id, r.matched_bytes) for r in prefix.longest(t, best, "k", "text").collect()}
    assert got == {1: (1, 27), 2: (4, 3), 3: (0, 0), 4: (0, 0), 5: (5, 2), 6: (0, 0)}
    assert prefix.hit_stats(t, best, "k", "text").first().asDict() == {"hits": 3, "misses": 3}
    assert {r.prefix: r.hits for r in prefix.node_hits(t, best, "k", "text").collect()}["You"] == 2
    assert prefix.size(p).first().size == 7


@pytest.mark.parametrize("n", [0, 31, 32, 33])
def test_batches(spark, n):
    req = spark.createDataFrame([(i, f"p{i}", "s") for i in range(n)] + [(100, "x", None)], "req_id long, prompt string, system_message string")
    s = batching.stats(batching.assign(req)).first()
    assert (s.groups, s.batches, s.requests) == ((n > 0) + 1, -(-n // 32) + 1, n + 1)
    assert batching.stats(batching.assign(req.limit(0))).first().asDict() == {"groups": 0, "batches": 0, "requests": 0, "largest": 0}


def fails(prompt, system):
    if prompt == "fail":
        raise ValueError("no")
    return prompt + "!"


def test_errors_stay_apart(spark):
    req = spark.createDataFrame([(1, "succeed", ""), (2, "fail", ""), (3, "x", "s")], "req_id long, prompt string, system_message string")
    got = {r.req_id: (r.answer, r.error) for r in batching.complete(req, fails).collect()}
    assert got == {1: ("succeed!", None), 2: (None, "no"), 3: ("x!", None)}


def test_token_bucket():
    now = [0.0]
    b = batching.TokenBucket(2, 3, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(7):
        b.take()
    assert abs(now[0] - 2.0) < 1e-6


def test_metrics(spark):
    log = spark.createDataFrame([("a", 3), ("a", 4), ("b", None)], "stage string, us long")
    assert {r.stage: (r.n, r.total_us, r.avg_us) for r in metrics.rollup(log, "stage", "us").collect()} == {"a": (2, 7, 3), "b": (1, 0, 0)}
    v = spark.createDataFrame([(float(i),) for i in range(1, 201)], "v double")
    r = metrics.latency(v, "v", 4).first()
    assert (r.n, r.mean, r.median, r.p99) == (200, 100.5, 100.5, 199.0) and abs(r.qps - 200 / (20100 / 4)) < 1e-12
    s, e, s_ref, e_ref = metrics.mixed_averages(F.lit(2), F.lit(3), F.lit(100), F.lit(30))
    assert tuple(spark.range(1).select(s, e, s_ref, e_ref).first()) == (20, 6, 50, 10)


def test_json_bodies(spark):
    body = lambda *x: spark.createDataFrame([(json.dumps(b),) for b in x], "body string")
    good = ingest.raw_vectors(body({"vectors": [{"id": 4294967295, "data": [1, 2]}]}, {}), 2).collect()
    assert [(r.id, r.embedding) for r in good] == [(4294967295, [1.0, 2.0])]
    with pytest.raises(Exception, match="expected 2 dimensions, vector 6"):
        ingest.raw_vectors(body({"vectors": [{"id": 5, "data": [1, 2]}, {"id": 6, "data": [1]}]}), 2).collect()
    with pytest.raises(Exception, match="MALFORMED"):
        ingest.raw_vectors(spark.createDataFrame([("{",)], "body string"), 2).collect()
    got = ingest.json_documents(body({"documents": [{"id": "a", "text": "x"}, {"id": "b"}]})).collect()
    assert [(r.doc_id, r.text) for r in got] == [("a", "x"), ("b", "")]


def test_directory_and_urls(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.txt").write_text("three")
    assert sorted(r.text for r in ingest.directory(spark, f"file://{tmp_path}").collect()) == ["one\ntwo", "three"]
    u = spark.createDataFrame([("https://api.x.com/v1/",), ("http://h:8080",), ("ftp://x",), (None,)], "u string")
    got = [r.p and tuple(r.p) for r in u.select(ingest.parse_base_url(F.col("u")).alias("p")).collect()]
    assert got == [("https", "api.x.com", 443, "/v1"), ("http", "h", 8080, ""), None, None]


def test_store(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i), 1.0], f"t{i}") for i in range(20)], "vec_id long, embedding array<float>, text string")
    path = f"file://{tmp_path}/index"
    store.save(v, path, IndexConfig(dim=2, ef_search=77))
    store.append(v.limit(1), path)
    back, cfg = store.load(spark, path)
    assert back.count() == 21 and cfg == IndexConfig(dim=2, ef_search=77) and back.columns == v.columns
    assert store.health(back).first().asDict() == {"status": "ok", "index_size": 21, "chunks": 0}
    assert sorted(map(str, store.import_binary(store.export_binary(v, cfg), "data").collect())) == sorted(map(str, v.select("vec_id", "embedding").collect()))
    data = bytes(store.export_binary(v.coalesce(1), cfg).first().data)
    for bad in (data[:-1], b"XXXX" + data[4:], data[:10], data[:8] + b"\0\0\0\0" + data[12:]):
        with pytest.raises(ValueError):
            store.parse_binary(bad)


def test_embedding_service(spark):
    def connect(base):
        def post(path, body, headers):
            assert path == "/v1/embeddings" and headers["Authorization"] == "Bearer key"
            texts = json.loads(body)["input"]
            texts = [texts] if isinstance(texts, str) else texts
            if "bad" in texts:
                return 500, b"x" * 999
            return 200, json.dumps({"data": [{"embedding": [float(len(t)), 0.0], "index": 0} for t in texts]}).encode()

        return post, "/v1"

    df = spark.createDataFrame([("a",), ("bb",), (None,)], "text string").coalesce(1)
    assert [r.embedding[0] for r in embedding_api.embed(df, "http://x/v1", "m", "key", batch=2, connect=connect).collect()] == [1, 2, 0]
    with pytest.raises(Exception, match="status 500: x{200}(?!x)"):
        embedding_api.embed(spark.createDataFrame([("bad",)], "text string"), "http://x", "m", "key", connect=connect).collect()
    with pytest.raises(ValueError):
        embedding_api.http_post("nothing")
    assert embedding_api.http_post("http://localhost:1/v1/")[1] == "/v1"


def test_streams(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    req = spark.createDataFrame([(i, f"request {i}" if i else "fail", "s") for i in range(40)], "req_id long, prompt string, system_message string")
    req.write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        batches.serve(spark.readStream.schema(req.schema).parquet(src), f"file://{tmp_path}/out", f"file://{tmp_path}/state", fails, once=True, limited=False).awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert len(got) == 40 and sum(r.error is not None for r in got) == 1 and {r.batch_no for r in got} == {0, 1}
    docs(spark).write.parquet(f"file://{tmp_path}/docs")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"file://{tmp_path}/docs")
    batches.ingest(stream, f"file://{tmp_path}/chunks", f"file://{tmp_path}/state2", embed, once=True).awaitTermination()
    rows = spark.read.parquet(f"file://{tmp_path}/chunks")
    assert {r.doc_id for r in rows.collect()} == {1, 2, 3} and rows.select("chunk_id").distinct().count() == rows.count()


def test_response_and_tool(spark):
    q = spark.createDataFrame([(7, "q"), (8, "r")], "query_id long, query string")
    body = {r.query_id: json.loads(r.body) for r in rag.response(q, found(spark, 2)).collect()}
    assert [x["id"] for x in body[7]["results"]] == [1, 2] and set(body[7]["results"][0]) == {"id", "score", "distance", "text"} and body[8] == {"results": []}
    search = rag.search_tool(ingest.chunk_table(docs(spark), embed, ChunkConfig(10, 2)), embed)
    assert search("graph", 2).startswith("Found 2 relevant passages:")
    with pytest.raises(ValueError):
        search("")


def test_bodies_bring_their_own_chunk_sizes(spark):
    text_ = "word " * 400
    body = [json.dumps({"documents": [{"id": "a", "text": text_}], "chunk_size": 64, "chunk_overlap": 8}), json.dumps({"documents": [{"id": "b", "text": text_}]})]
    docs = ingest.json_documents(spark.createDataFrame([(b,) for b in body], "body string"))
    got = {}
    for r in text.chunks(docs, sizes=("chunk_size", "chunk_overlap")).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    want = {"a": ChunkConfig(64, 8), "b": ChunkConfig()}
    assert got == {k: [text_[a:b] for a, b in text.chunk_bounds(text_, c)] for k, c in want.items()}
    with pytest.raises(Exception, match="chunk_overlap"):
        text.chunks(docs.withColumn("chunk_overlap", F.lit(60)), sizes=("chunk_size", "chunk_overlap")).collect()


def test_one_document_and_timed_ingestion(spark, tmp_path):
    assert text.chunks(ingest.single(spark, 5, "")).collect() == [] and [r.doc_id for r in text.chunks(ingest.single(spark, "x", "some text")).collect()] == ["x"]
    got = ingest.index(ingest.single(spark, 5, ""), str(tmp_path / "i"), lambda c: hashing.hash_embed(c, 4)).first()
    assert (got.documents_indexed, got.chunks_created, got.vectors_inserted) == (1, 0, 0) and got.time_ms > 0


def test_base_urls_match_as_a_whole(spark):
    urls = ["http://host:80abc", "http://a:b/v1", "https://h/v1/", "http://h:8080", "ftp://h", "http://h:99999999999", "http://h\n", None]
    got = [r.p and tuple(r.p) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(ingest.parse_base_url(F.col("u")).alias("p")).collect()]
    assert got == [None, None, ("https", "h", 443, "/v1"), ("http", "h", 8080, ""), None, ("http", "h", None, ""), ("http", "h\n", 80, ""), None]


def test_batches_of_one_hot_group(spark):
    rows = [(i, None if i % 7 == 0 else "", f"p{i}") for i in range(500)]
    got = batching.assign(spark.createDataFrame(rows, "req_id long, system_message string, prompt string").repartition(5)).collect()
    for value in (None, ""):
        mine = sorted((r.req_id, r.batch_no, r.pos) for r in got if r.system_message == value)
        assert [(b, p) for _, b, p in mine] == [(i // 32, i % 32) for i in range(len(mine))] and len(mine) in (72, 428)


def test_stage_times(spark):
    embed = lambda c: hashing.hash_embed(c, 8)
    chunks = ingest.chunk_table(spark.createDataFrame([(1, "a text"), (2, "another")], "doc_id long, text string"), embed)
    asked = spark.createDataFrame([(0, "a text"), (1, "")], "query_id long, query string")
    out, took = rag.timed_query(asked, chunks, embed, lambda p: F.length(p).cast("string"))
    t = took.first()
    assert t.queries == 2 and t.total_us == t.embed_us + t.search_us + t.generate_us + t.overhead_us and min(t.embed_us, t.search_us, t.generate_us, t.overhead_us) > 0
    plain = rag.query(asked, chunks, embed, lambda p: F.length(p).cast("string"))
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
    assert rag.timed_query(asked, chunks, embed)[1].first().generate_us == 0


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    put = lambda ids: spark.createDataFrame([(i, f"p{i}", "") for i in ids], "req_id long, prompt string, system_message string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([1, 2])

    def serve(llm):
        stream = spark.readStream.schema("req_id long, prompt string, system_message string").parquet(str(tmp_path / "in"))
        batches.serve(stream, str(tmp_path / "out"), str(tmp_path / "state"), llm, once=True, limited=False).awaitTermination()
        return sorted((r.req_id, r.answer) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert serve(lambda p, s: f"first {p}") == [(1, "first p1"), (2, "first p2")]
    put([3])  # queued while nothing runs
    assert serve(lambda p, s: f"second {p}") == [(1, "first p1"), (2, "first p2"), (3, "second p3")]
