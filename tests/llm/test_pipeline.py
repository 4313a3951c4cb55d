"""The pipeline's stages one after another, on a small corpus where the right result is known."""

import functools

import tiktoken

from tarnwell.llm import bpe, mixing

from .helpers import awkward, words


@functools.cache
def whole():
    return tiktoken.Encoding("whole", pat_str=bpe.PATTERN, mergeable_ranks=bpe.Bpe(bpe.BpeConfig()).ranks, special_tokens={})


def corpus(spark, tmp_path):
    from .test_secrets import KEY

    rows, labels = [], []
    for i in range(120):
        text = " ".join(words(60 + i % 40, i))
        if i % 6 == 0:
            text = " ".join(w + "###" for w in text.split())
        if i % 6 == 1:
            text += f' token = "{KEY}" '
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 0 if i % 6 == 0 else 1, 0))
    rows += [(1000 + r[0], r[1] + " tail", *r[2:]) for r in rows[1:20]]
    d = f"file://{tmp_path}/sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, {r[0]: r[1] for r in rows}, KEY


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    d, texts, key = corpus(spark, tmp_path)
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "secret_scans", "mixing_sources", "bpe_encoding"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, d)
        assert k == 4 or out.columns == columns
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.collect())
    good = {i for i in texts if (i % 1000) % 6 != 0}
    assert {r.doc_id for r in seen[0]} == good and len(seen[0]) == len(good)
    one = {i for i in good if i < 1000}  # each copy has a smaller original
    assert {r.doc_id for r in seen[1]} == one and len(seen[1]) == len(one)
    assert {r.doc_id: r.text for r in seen[2]} == {i: texts[i].replace(key, "[SECRET]") for i in one}
    assert {r.doc_id for r in seen[3]} <= one and all(r.text == texts[r.doc_id].replace(key, "[SECRET]") for r in seen[3])
    text = {r.doc_id: r.text for r in seen[2]}
    assert len(seen[4]) == len(seen[3]) and all(r.tokens == whole().encode_ordinary(text[r.doc_id]) and r.exact for r in seen[4])


def test_run_is_the_stages(spark, tmp_path):
    import corpus_pipeline as P

    d, texts, _ = corpus(spark, tmp_path)
    got = P.run(spark, d)
    assert got.columns == ["doc_id", "n_tokens", "tokens", "exact"] and {r.doc_id for r in got.collect()} <= set(texts) and P.ORACLE_SQL is None


def test_run_by_brute_force(spark, tmp_path):
    """run() against each stage's plain counterpart, on rows with nulls, repeats, ties, long texts and clashing names."""
    import corpus_pipeline as P
    from tarnwell.llm import rules

    from .test_rules import plain_statistics
    from .test_secrets import found_in
    from .test_sketch import brute

    d, _, key = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet").unionByName(awkward(spark).select("doc_id", "text", "lang", "source", "n_chars").selectExpr("doc_id + 5000 AS doc_id", "text", "lang", "source", "n_chars"))
    docs = docs.selectExpr("*", "'own' AS _stats", "'own' AS _gone", "'own' AS tokens")
    e = f"file://{tmp_path}/own"
    docs.write.parquet(f"{e}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").write.parquet(f"{e}/labels.parquet")
    learned = rules.fit(docs, spark.read.parquet(f"{e}/labels.parquet"))
    rows = [r for r in docs.collect() if not any(all(plain_statistics(r.text)[c.statistic] >= c.value if c.at_least else plain_statistics(r.text)[c.statistic] <= c.value for c in rule) for rule in learned)]
    first = {r.doc_id: r.text for r in rows if r.doc_id is not None and r.text}
    short = {i: t for i, t in first.items() if len(t.split()) < 3}  # of fewer words than a shingle: copies only if equal
    gone = {i for i, _ in brute(sorted((i, t) for i, t in first.items() if i not in short))}
    rows = [r for r in rows if r.doc_id not in gone]
    masked = {}
    for r in rows:
        text = r.text
        for f in found_in([text])[0] if text else []:
            text = text.replace(f, "[SECRET]", 1)
        masked.setdefault(r.doc_id, []).append(text)
    left = spark.createDataFrame([(i, t, next(r.source for r in rows if r.doc_id == i)) for i, ts in masked.items() for t in ts], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix(left).collect()}
    want = sorted((i, str(None if t is None else whole().encode_ordinary(t))) for i, ts in masked.items() if i is not None for t in ts for _ in range(copies[i]))
    got = sorted((r.doc_id, str(r.tokens)) for r in P.run(spark, e).collect())
    assert got == want and len(want) > 60
    empty = f"file://{tmp_path}/none"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert P.run(spark, empty).collect() == []


def test_near_dedup_keeps_no_pair_of_a_large_bucket(spark, monkeypatch):
    import corpus_pipeline as P
    from tarnwell.llm import sketch

    from .test_sketch import buckets_of, half_alike, sharing, table

    cfg, rows = sketch.SketchConfig(bands=6, most=4), half_alike(60, 30, 110, 60, 20)
    monkeypatch.setattr(sketch.drop_near_duplicates, "__defaults__", (cfg,))
    docs = table(spark, rows)
    gone = {i for i, _ in sharing(rows, buckets_of(docs, cfg))}
    assert {r.doc_id for r in P.near_dedup(spark, docs, "").collect()} == {r[0] for r in rows} - gone and len(gone) >= 15
