"""SQL of the queries, in DuckDB's dialect."""

from __future__ import annotations

from ..config import PROMPT

_DIST = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: {}))"
_L2 = _DIST.format("(p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)")
_IP = "-" + _DIST.format("p[1]::DOUBLE * p[2]::DOUBLE")
_URL = r"\A(https?)://([^:/]+)(:[0-9]+)?(/[\s\S]*)?\z"


def _r(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0.0"


def _pairs(dist: str) -> str:
    return f"SELECT q.vec_id AS query_id, v.vec_id AS id, {dist} AS d FROM embeddings q, embeddings v"


def _top(dist: str, k: int, self: bool) -> str:
    where = "" if self else "WHERE query_id <> id"
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS INT) AS rank FROM ({_pairs(dist)}) {where}) WHERE rank <= {k}"


def _score(d: str) -> str:
    return f"CASE WHEN {d} = -1 THEN CAST('Infinity' AS DOUBLE) ELSE 1 / (1 + {d}) END"


_SCORE = _score("d")


def _chunks(size: int, overlap: int) -> str:
    """Chunks as a recursive table r(doc_id, idx, pos, e): 0-based start and end."""
    s, o = 4 * size, 4 * overlap
    end = f"""CASE WHEN nxt + {s} >= n THEN n
      WHEN strpos(reverse(substr(text, nxt + {s // 2} + 2, {s // 2} + 1)), chr(10) || chr(10)) > 0
        THEN least(n, nxt + {s} + 2) - strpos(reverse(substr(text, nxt + {s // 2} + 2, {s // 2} + 1)), chr(10) || chr(10)) + 1
      WHEN strpos(reverse(substr(text, nxt + {s // 2} + 2, {s // 2})), chr(10)) > 0
        THEN nxt + {s} + 1 - strpos(reverse(substr(text, nxt + {s // 2} + 2, {s // 2})), chr(10)) + 1
      ELSE nxt + {s} END"""
    return f"""t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''),
    r(doc_id, text, n, idx, pos, e, nxt) AS (
      SELECT doc_id, text, n, 0, 0, e, CASE WHEN e > {o} THEN e - {o} ELSE e END FROM (SELECT *, {end} AS e FROM (SELECT *, 0 AS nxt FROM t))
      UNION ALL
      SELECT doc_id, text, n, idx, nxt, e, CASE WHEN e > {o} THEN e - {o} ELSE e END
      FROM (SELECT *, {end} AS e FROM (SELECT doc_id, text, n, idx + 1 AS idx, nxt FROM r WHERE e < n)))"""


def _hash(table: str, key: str, dim: int = 64) -> str:
    """Table {table}_v(key, embedding): hash embeddings of table(key, text)."""
    return f"""{table}_h AS (SELECT {key}, list_reduce(list_prepend(5381::HUGEINT, list_transform(range(0, octet_length(encode(text))),
        lambda k: (('0x' || substr(hex(encode(text)), CAST(2 * k + 1 AS BIGINT), 2))::INT)::HUGEINT)),
        lambda h, b: (h * 33 + CASE WHEN b >= 128 THEN 18446744073709551360 + b ELSE b END) % 18446744073709551616) AS h FROM {table}),
    {table}_g({key}, i, h) AS (SELECT {key}, 0, (h * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 FROM {table}_h
      UNION ALL SELECT {key}, i + 1, (h * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 FROM {table}_g WHERE i < {dim - 1}),
    {table}_u AS (SELECT {key}, i, (CASE WHEN h >= 9223372036854775808 THEN -((18446744073709551616 - h) % 1000) ELSE h % 1000 END)::DOUBLE / 1000 AS x FROM {table}_g),
    {table}_l AS (SELECT {key}, l, sqrt(list_sum(list_transform(l, lambda z: z * z))) AS n FROM (SELECT {key}, list(x ORDER BY i) AS l FROM {table}_u GROUP BY {key})),
    {table}_v AS (SELECT {key}, list_transform(l, lambda z: CASE WHEN n > 0 THEN z / n ELSE z END) AS embedding FROM {table}_l)"""


_RETRIEVED = f"""WITH RECURSIVE {_chunks(512, 64)},
    c AS (SELECT row_number() OVER (ORDER BY doc_id, idx) - 1 AS id, substr(text, pos + 1, e - pos) AS text FROM r),
    b AS (SELECT item_id, text FROM benchmark WHERE text <> ''),
    {_hash('c', 'id')}, {_hash('b', 'item_id')},
    near AS (SELECT q.item_id AS query_id, v.id, {_L2} AS d FROM b_v q, c_v v),
    ten AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank0 FROM near) WHERE rank0 <= 10),
    found AS (SELECT query_id, b.text AS query, rank0, ten.id, d, 1 / (1 + d) AS score, c.text FROM ten JOIN c USING (id) JOIN b ON b.item_id = query_id),
    top3 AS (SELECT query_id, CAST(rank0 AS INT) AS rank, id, d, score, text FROM found WHERE rank0 <= 3)"""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hits(query: str, text: str) -> str:
    words = f"list_filter(regexp_split_to_array(translate({query}, '{_UP}', '{_LOW}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
    return f"len(list_filter({words}, lambda w: contains(translate({text}, '{_UP}', '{_LOW}'), w)))"


_HEAD, _MIDDLE, _TAIL = PROMPT.partition("{context}")[0], *PROMPT.partition("{context}")[2].partition("{query}")[::2]
_Q = lambda s: "'" + s.replace("'", "''") + "'"
_AUGMENTED = f"""{_RETRIEVED},
    ctx AS (SELECT query_id, string_agg('[' || rank || '] ' || text || chr(10) || chr(10), '' ORDER BY rank) AS ctx FROM top3 GROUP BY query_id),
    filled AS (SELECT item_id AS query_id, text AS query, {_Q(_HEAD)} || coalesce(ctx, '') || {_Q(_MIDDLE + '{query}' + _TAIL)} AS p FROM benchmark LEFT JOIN ctx ON item_id = query_id),
    prompts AS (SELECT query_id, substr(p, 1, strpos(p, '{{query}}') - 1) || query || substr(p, strpos(p, '{{query}}') + 7) AS prompt FROM filled)"""

_PREFIXES = "p AS (SELECT DISTINCT substr(text, 1, n) AS prefix FROM benchmark, (VALUES (1), (2), (3), (5), (8)) AS lens(n) WHERE text <> '')"
_REQUESTS = """s AS (SELECT conv_id, arg_min(text, turn) AS system_message FROM conversations WHERE role = 'system' GROUP BY conv_id),
    rq AS (SELECT u.conv_id, u.turn, u.text AS prompt, coalesce(system_message, '') AS system_message FROM conversations u LEFT JOIN s ON u.conv_id = s.conv_id WHERE role = 'user'),
    ba AS (SELECT *, row_number() OVER (PARTITION BY system_message ORDER BY conv_id, turn) - 1 AS rn FROM rq)"""
_COMPONENTS = "SELECT vec_id, CAST(i - 1 AS INT) AS i, {} AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) AS i, sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE))) AS n FROM embeddings)"

_TOOL = """'Found ' || count(rank) || ' relevant passages:' || chr(10) || chr(10) || coalesce(string_agg('--- Result ' || rank || ' (score: ' || printf('%g', score) || ') ---' || chr(10) || top3.text || chr(10) || chr(10), '' ORDER BY rank), '')"""

ORACLE_SQL: dict[str, str] = {
    "knn_l2_top10": f"SELECT query_id, rank, id, {_r('d')} AS distance, {_r(_SCORE)} AS score FROM ({_top(_L2, 10, True)})",
    "knn_ip_top10": f"SELECT query_id, rank, id, {_r('d')} AS distance, {_r(_SCORE)} AS score FROM ({_top(_IP, 10, False)})",
    "knn_self_top1": f"SELECT query_id, id, {_r('d')} AS distance, {_r(_SCORE)} AS score FROM ({_top(_L2, 1, True)})",
    "l2_pairs": f"SELECT query_id, id, {_r('d')} AS distance FROM ({_pairs(_L2)})",
    "ip_pairs": f"SELECT query_id, id, {_r('d')} AS distance FROM ({_pairs(_IP)})",
    "range_score_filter": f"SELECT query_id, id, {_r(_SCORE)} AS score FROM ({_pairs(_L2)}) WHERE {_SCORE} > 0.5 AND query_id <> id",
    "l2_norm": f"SELECT vec_id, {_r('sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE)))')} AS norm FROM embeddings",
    "normalize": _COMPONENTS.format(_r("CASE WHEN n > 0 THEN y / n ELSE y END")),
    "score_of_distance": f"SELECT vec_id, {_r('a')} AS l2, {_r('b')} AS ip, {_r(_score('a'))} AS l2_score, {_r(_score('b'))} AS ip_score FROM (SELECT q.vec_id, {_L2} AS a, {_IP} AS b FROM embeddings q JOIN embeddings v ON v.vec_id = q.vec_id + 1)",
    "filtered_top5": f"SELECT query_id, rank, id, {_r('d')} AS distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS INT) AS rank FROM ({_pairs(_L2)} WHERE q.label = v.label AND q.vec_id <> v.vec_id)) WHERE rank <= 5",
    "knn_graph_simple": f"SELECT query_id AS src, rank, id AS dst, {_r('d')} AS distance FROM ({_top(_L2, 8, False)})",
    "ivf_all_cells": f"SELECT query_id, rank, id, {_r('d')} AS distance, {_r(_SCORE)} AS score FROM ({_top(_L2, 10, True)})",
    "hnsw_levels": "SELECT vec_id, CAST(least(floor(-ln((('0x' || substr(md5(vec_id || ':42'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE) / ln(32::DOUBLE)), 15) AS TINYINT) AS level FROM embeddings",
    "random_unit_norms": "SELECT range AS vec_id, CAST(64 AS INT) AS n, 1.0::DOUBLE AS norm FROM range(1000)",
    "dimension_check": "SELECT vec_id, CAST(len(embedding) AS INT) AS n FROM embeddings",
    "vector_of_id": f"{_COMPONENTS.format(_r('y'))} WHERE vec_id = (SELECT max(vec_id) FROM embeddings)",
    "json_responses": f"""{_RETRIEVED} SELECT item_id AS query_id, CAST(count(rank) AS INT) AS n, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank), '') AS ids, coalesce(string_agg(md5(top3.text), ',' ORDER BY rank), '') AS texts
      FROM benchmark LEFT JOIN top3 ON item_id = query_id GROUP BY item_id""",
    "knowledge_search": f"""{_RETRIEVED}, o AS (SELECT item_id AS query_id, {_TOOL} AS output FROM benchmark LEFT JOIN top3 ON item_id = query_id WHERE benchmark.text <> '' GROUP BY item_id)
      SELECT * FROM o WHERE query_id = (SELECT min(query_id) FROM o)""",
    "single_document_ingest": f"WITH RECURSIVE {_chunks(512, 64)} SELECT doc_id, idx AS chunk_idx, substr(text, pos + 1, e - pos) AS text FROM r WHERE doc_id = (SELECT max(doc_id) FROM documents)",
    "documents_json_chunked": f"WITH RECURSIVE {_chunks(64, 8)} SELECT CAST(doc_id AS VARCHAR) AS doc_id, idx AS chunk_idx, substr(text, pos + 1, e - pos) AS text FROM r",
    "directory_source": "SELECT item_id, regexp_replace(text, '[\\r\\n]', ' ', 'g') AS text FROM benchmark",
    "config_settings": "SELECT * FROM (VALUES ('m', '24'), ('dim', '64'), ('ef_search', '200'), ('chunk_size', '128'), ('chunk_overlap', '16'), ('top_k', '10'), ('top_n', '4'), ('enable_rerank', 'True'), ('llm_rate_limit', '30.5'), ('max_batch_size', '32'), ('embed_model', 'own')) AS t(name, value)",
    "api_embedding": "SELECT item_id, CAST(i AS INT) AS i, x::DOUBLE AS x FROM (SELECT item_id, unnest([0, 1, 2]) AS i, unnest([length(text), length(text) - length(replace(text, 'e', '')), 0.5]) AS x FROM benchmark)",
    "prefix_inserts": "WITH w AS (SELECT item_id, substr(text, 1, n) AS prefix, item_id + 1 AS cache_id FROM benchmark, (VALUES (1), (2), (3)) AS lens(n) WHERE text <> '') SELECT prefix, arg_max(cache_id, item_id) AS cache_id, (SELECT count(*) FROM w) AS size FROM w GROUP BY prefix",
    "complete_limited": f"WITH {_REQUESTS} SELECT conv_id, turn, CAST(length(prompt) - length(system_message) AS VARCHAR) AS answer, CAST(NULL AS VARCHAR) AS error FROM rq",
    "mixed_averages": """WITH l AS (SELECT user_id, event_id, CAST(floor(value * 1000) AS BIGINT) AS us FROM events),
      a AS (SELECT user_id, count(*) FILTER (event_id % 3 = 0) AS s, count(*) FILTER (event_id % 3 <> 0) AS q, CAST(coalesce(sum(us), 0) AS BIGINT) AS t, CAST(coalesce(sum(us) FILTER (event_id % 3 <> 0), 0) AS BIGINT) AS e FROM l GROUP BY user_id)
      SELECT user_id, CASE WHEN s + q > 0 THEN CAST(floor(t / (s + q)) AS BIGINT) ELSE 0 END AS avg_search_us, CASE WHEN s + q > 0 THEN CAST(floor(e / (s + q)) AS BIGINT) ELSE 0 END AS avg_embed_us,
        CASE WHEN s > 0 THEN CAST(floor(t / s) AS BIGINT) ELSE 0 END AS avg_search_us_ref, CASE WHEN q > 0 THEN CAST(floor(e / q) AS BIGINT) ELSE 0 END AS avg_embed_us_ref FROM a""",
    "hnsw_top10": f"SELECT query_id, rank, id, {_r('d')} AS distance, {_r(_SCORE)} AS score FROM ({_top(_L2, 10, True)})",  # the beam finds all of them on these tables
    "hnsw_recall": "SELECT 1.0::DOUBLE AS recall, count(*) AS queries FROM embeddings",
    "knn_graph_heuristic": f"""WITH RECURSIVE near AS ({_top(_L2, 24, False)}), n AS (SELECT query_id AS src, rank AS i, id, d, embedding AS e FROM near JOIN embeddings ON vec_id = id),
      g(src, i, chosen, rest) AS (SELECT vec_id, 0, []::STRUCT(id BIGINT, d DOUBLE, e FLOAT[])[], []::STRUCT(id BIGINT, d DOUBLE, e FLOAT[])[] FROM embeddings
        UNION ALL SELECT src, i, CASE WHEN far THEN chosen ELSE list_append(chosen, c) END, CASE WHEN far THEN list_append(rest, c) ELSE rest END
        FROM (SELECT g.src, n.i, chosen, rest, {{'id': id, 'd': d, 'e': n.e}} AS c, len(chosen) >= 8 OR len(list_filter(chosen, lambda o: list_sum(list_transform(list_zip(o.e, n.e), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) < d)) > 0 AS far FROM g JOIN n ON n.src = g.src AND n.i = g.i + 1)),
      l AS (SELECT src, list_concat(chosen, rest)[1:8] AS l FROM g WHERE i = 24)
      SELECT src, CAST(rank AS INT) AS rank, l[rank].id AS dst, {_r('l[rank].d')} AS distance FROM (SELECT src, l, unnest(range(1, 9)) AS rank FROM l)""",
    "saved_graphs_top10": f"SELECT query_id, rank, id, {_r('d')} AS distance, {_r(_SCORE)} AS score FROM ({_top(_L2, 10, True)})",
    "json_answers": f"""WITH RECURSIVE {_chunks(512, 64)}, c AS (SELECT count(*) AS n FROM r)
      SELECT 'counts' AS what, printf('{{"documents_indexed":%d,"chunks_created":%d,"vectors_inserted":%d}}', (SELECT count(*) FROM documents), n, n) AS body FROM c
      UNION ALL SELECT 'health', printf('{{"status":"ok","index_size":%d,"chunks":%d}}', (SELECT count(*) FROM embeddings), n) FROM c
      UNION ALL SELECT 'metrics', printf('{{"stage":"%s","n":%d,"total_us":%d,"avg_us":%d}}', event_type, count(*), CAST(coalesce(sum(us), 0) AS BIGINT), CAST(coalesce(sum(us), 0) // count(*) AS BIGINT)) FROM (SELECT event_type, CAST(floor(value * 1000) AS BIGINT) AS us FROM events) GROUP BY event_type
      UNION ALL SELECT 'failure', '{{"error":"the query is missing"}}'""",
    "reverse_connect": f"""WITH g AS ({_top(_L2, 8, False)}), e AS (SELECT query_id AS src, id AS dst, d FROM g UNION SELECT id, query_id, d FROM g)
      SELECT src, rank, dst, {_r('d')} AS distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY d, dst) AS INT) AS rank FROM e) WHERE rank <= 16""",
    "chunk_default": f"WITH RECURSIVE {_chunks(512, 64)} SELECT doc_id, idx AS chunk_idx, substr(text, pos + 1, e - pos) AS text FROM r",
    "chunk_64_8": f"WITH RECURSIVE {_chunks(64, 8)} SELECT doc_id, idx AS chunk_idx, substr(text, pos + 1, e - pos) AS text FROM r",
    "chunk_ids": f"WITH RECURSIVE {_chunks(512, 64)} SELECT row_number() OVER (ORDER BY doc_id, idx) - 1 AS chunk_id, doc_id, idx AS chunk_idx FROM r",
    "ingest_counts": f"WITH RECURSIVE {_chunks(512, 64)} SELECT (SELECT count(*) FROM documents) AS documents_indexed, count(*) AS chunks_created, count(*) AS vectors_inserted FROM r",
    "mock_embed_64": f"WITH RECURSIVE b AS (SELECT item_id, text FROM benchmark), {_hash('b', 'item_id')} SELECT item_id, CAST(i - 1 AS INT) AS i, {_r('x', 4)} AS x FROM (SELECT item_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM b_v)",
    "fnv1a_prefix_hash": """SELECT conv_id, turn, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS hash FROM (
      SELECT conv_id, turn, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, octet_length(encode(text))), lambda k: (('0x' || substr(hex(encode(text)), CAST(2 * k + 1 AS BIGINT), 2))::INT)::HUGEINT)),
        lambda h, b: (xor(h, CASE WHEN b >= 128 THEN 18446744073709551360 + b ELSE b END) * 1099511628211) % 18446744073709551616) AS h FROM conversations)""",
    "retrieve_top3": f"{_RETRIEVED} SELECT query_id, rank, id, {_r('d', 4)} AS distance, {_r('score', 4)} AS score, text FROM top3",
    "retrieve_rerank": f"""{_RETRIEVED}, bl AS (SELECT *, 0.7 * score + 0.3 * {_hits('query', 'text')} AS s2 FROM found)
      SELECT query_id, rank, id, {_r('d', 4)} AS distance, {_r('s2', 4)} AS score, text FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, rank0) AS INT) AS rank FROM bl) WHERE rank <= 3""",
    "keyword_hits": f"""WITH q AS MATERIALIZED (SELECT item_id, list_filter(regexp_split_to_array(translate(text, '{_UP}', '{_LOW}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM benchmark),
      t AS MATERIALIZED (SELECT doc_id, translate(text, '{_UP}', '{_LOW}') AS low FROM documents)
      SELECT item_id AS query_id, doc_id, CAST(len(list_filter(w, lambda x: contains(low, x))) AS INT) AS hits FROM q, t""",
    "augment_prompt": f"{_AUGMENTED} SELECT query_id, prompt FROM prompts",
    "tool_output": f"""{_RETRIEVED} SELECT item_id AS query_id, {_TOOL} AS output
      FROM benchmark LEFT JOIN top3 ON item_id = query_id GROUP BY item_id""",
    "rag_query_stub": f"{_AUGMENTED} SELECT query_id, 'prompt of ' || length(prompt) || ' characters' AS answer, CAST((SELECT count(*) FROM top3 WHERE top3.query_id = prompts.query_id) AS INT) AS n_sources FROM prompts",
    "prefix_longest": f"WITH {_PREFIXES} SELECT doc_id, CAST(coalesce(max(octet_length(encode(prefix))), 0) AS BIGINT) AS matched_bytes FROM documents LEFT JOIN p ON starts_with(text, prefix) GROUP BY doc_id",
    "prefix_hit_stats": f"WITH {_PREFIXES}, m AS (SELECT doc_id, count(prefix) AS c FROM documents LEFT JOIN p ON starts_with(text, prefix) GROUP BY doc_id) SELECT count(*) FILTER (c > 0) AS hits, count(*) FILTER (c = 0) AS misses FROM m",
    "prefix_node_hits": f"WITH {_PREFIXES} SELECT prefix, count(doc_id) AS hits FROM p LEFT JOIN documents ON starts_with(text, prefix) GROUP BY prefix",
    "batch_assign": f"WITH {_REQUESTS} SELECT conv_id, turn, rn // 32 AS batch_no, rn % 32 AS pos FROM ba",
    "batch_stats": f"WITH {_REQUESTS}, e AS (SELECT system_message, rn // 32 AS b, count(*) AS n FROM ba GROUP BY ALL) SELECT count(*) FILTER (b = 0) AS groups, count(*) AS batches, CAST(coalesce(sum(n), 0) AS BIGINT) AS requests, coalesce(max(n), 0) AS largest FROM e",
    "complete_requests": f"WITH {_REQUESTS} SELECT conv_id, turn, CASE WHEN contains(prompt, '?') THEN NULL ELSE CAST(length(prompt) + length(system_message) AS VARCHAR) END AS answer, CASE WHEN contains(prompt, '?') THEN 'refused' END AS error FROM rq",
    "metrics_rollup": "SELECT event_type AS stage, count(*) AS n, CAST(coalesce(sum(us), 0) AS BIGINT) AS total_us, CAST(coalesce(sum(us), 0) // count(*) AS BIGINT) AS avg_us FROM (SELECT event_type, CAST(floor(value * 1000) AS BIGINT) AS us FROM events) GROUP BY event_type",
    "latency_summary": f"SELECT count(value) AS n, {_r('avg(value)', 4)} AS mean, {_r('quantile_cont(value, 0.5)', 4)} AS median, {_r('list_sort(list(value))[CAST(floor(count(value) * 0.99) AS BIGINT) + 1]', 4)} AS p99, {_r('count(value) / (sum(value) / 8)', 4)} AS qps FROM events",
    "ingest_raw_vectors": _COMPONENTS.format(_r("y")),
    "binary_roundtrip": _COMPONENTS.format(_r("y")),
    "documents_json_ingest": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents",
    "save_load_roundtrip": "SELECT vec_id, label, CAST(len(embedding) AS INT) AS n, 64 AS dim FROM embeddings",
    "base_urls": f"""SELECT page_id, CASE WHEN ok THEN g[1] END AS scheme, CASE WHEN ok THEN g[2] END AS host,
      CASE WHEN NOT ok THEN NULL WHEN length(g[3]) > 1 THEN TRY_CAST(CASE WHEN length(g[3]) <= 10 THEN substr(g[3], 2) END AS INT) WHEN g[1] = 'https' THEN 443 ELSE 80 END AS port,
      CASE WHEN ok THEN regexp_replace(g[4], '/\\z', '') END AS path
      FROM (SELECT page_id, coalesce(regexp_matches(url, '{_URL}'), false) AS ok, [{", ".join(f"regexp_extract(url, '{_URL}', {k})" for k in range(1, 5))}] AS g FROM pages)""",
    "index_health": f"WITH RECURSIVE {_chunks(512, 64)} SELECT 'ok' AS status, (SELECT count(*) FROM embeddings) AS index_size, count(*) AS chunks FROM r",
    "stream_batches": f"WITH {_REQUESTS} SELECT conv_id, turn, length(prompt) || '/' || length(system_message) AS answer, CAST(NULL AS VARCHAR) AS error FROM rq",
    "stream_ingest": f"WITH RECURSIVE {_chunks(512, 64)} SELECT doc_id, idx AS chunk_idx, substr(text, pos + 1, e - pos) AS text FROM r",
}
