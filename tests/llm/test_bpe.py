import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken

from tarnwell.llm import bpe as B

from .helpers import awkward, empty

ALPHABET = ["a", "b", "th", "er", " the", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "\x1c", "\x85", "é", "漢", "字", "12", "3", ",", ".!", "<|endoftext|>", "😀", "́", "ñ", "Ω", "_"]


@pytest.fixture(scope="module", params=["byte_bpe_50k", "byte_bpe_multi_50k"])
def bpe(request):
    return B.Bpe(B.BpeConfig(vocabulary=f"/opt/tokenizers/{request.param}.tiktoken"))


def texts():
    r = random.Random(3)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(60))) for _ in range(1500)] + ["", " ", "\n\n", "a" * 3000, "é" * 900, "ab " * 2000, "  x  "]


def test_same_tokens_as_encoding_whole_texts(bpe):
    whole = tiktoken.Encoding("whole", pat_str=B.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    ts = texts()
    ids, off = bpe.encode(pa.array(ts))
    for i, t in enumerate(ts):
        assert ids[off[i] : off[i + 1]].tolist() == whole.encode_ordinary(t)


def test_pieces_are_those_of_the_pattern():
    pattern, ts = regex.compile(B.PATTERN), [t for t in texts() if t] + ["'", "'s", "x're", "''s", " 's", "\n's", "'say'll've'", "'l", "a'r", "  \n", "  \nx", "\u3000 b"]
    for t in ts:
        x = np.frombuffer(t.encode(), np.uint8)
        at = np.cumsum([0, *(len(p.encode()) for p in pattern.findall(t))])
        assert np.flatnonzero(B.Bpe.pieces(x, np.zeros(1, np.int64))).tolist() == at[:-1].tolist(), t
    both = np.frombuffer("".join(ts).encode(), np.uint8)
    starts = np.cumsum([0, *(len(t.encode()) for t in ts)])[:-1]
    alone = np.concatenate([B.Bpe.pieces(np.frombuffer(t.encode(), np.uint8), np.zeros(1, np.int64)) for t in ts])
    assert (B.Bpe.pieces(both, starts) == alone).all()


def test_matrix_and_heap_merge_alike(bpe):
    r = random.Random(5)
    parts = ["".join(r.choice("abcdeth") for _ in range(r.randrange(2, 200))).encode() for _ in range(300)]
    start = np.cumsum([0, *map(len, parts)])
    ids, n = bpe.merge(np.frombuffer(b"".join(parts), np.uint8), start[:-1], np.diff(start))
    cut = np.cumsum([0, *n])
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [bpe._heap(p) for p in parts]


def test_a_token_that_merges_do_not_reach(tmp_path):
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"xyz"]
    path = tmp_path / "v"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    bpe = B.Bpe(B.BpeConfig(vocabulary=str(path)))
    assert bpe.odd == {b"xyz": 257}
    ids, off = bpe.encode(pa.array(["xyz", "axyz", "ab xyz,xyz"]))
    whole = tiktoken.Encoding("w", pat_str=B.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [whole.encode_ordinary(t) for t in ("xyz", "axyz", "ab xyz,xyz")]


def test_every_forced_boundary_is_cut(bpe):
    text = "déjà vu, 漢字 and kqzx\x00y"
    x = np.frombuffer(text.encode(), np.uint8)
    at, _ = bpe.cuts(x, np.array([0, len(x)]))
    assert set(np.flatnonzero(bpe.forced[x[:-1], x[1:]]) + 1) <= set(at.tolist())


def test_round_trip(bpe):
    ts = texts()
    ids, off = bpe.encode(pa.array(ts))
    data, to = bpe.decode(ids, off)
    assert [data[to[i] : to[i + 1]].tobytes().decode() for i in range(len(ts))] == ts


def test_no_token_spans_a_forced_boundary(bpe):
    for t in bpe.ranks:
        assert not any(bpe.forced[a, b] for a, b in zip(t, t[1:], strict=False))
    assert 0.5 < bpe.forced.mean() < 1


def test_awkward_rows(spark):
    docs = awkward(spark)
    enc = B.encode(docs)
    rows = enc.collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[3].tokens is None and by[3].n_tokens is None and by[4].tokens == [] and by[4].n_tokens == 0
    assert all(r.exact and len(r.tokens) == r.n_tokens for r in rows if r.tokens is not None)
    want = sorted((str(r.doc_id), str(r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), str(r.text)) for r in B.decode(enc).collect()) == want
    assert B.encode(empty(spark)).collect() == []
    some = spark.createDataFrame([(1, [64, None, 65, -3, 10**6]), (2, None), (3, []), (None, [150])], "doc_id long, tokens array<int>")
    assert [(r.doc_id, r.text) for r in B.decode(some).collect()] == [(1, "ab"), (2, None), (3, ""), (None, B._load(B.BpeConfig()).bytes[B._load(B.BpeConfig()).at[150] : B._load(B.BpeConfig()).at[151]].tobytes().decode("utf-8", "replace"))]
