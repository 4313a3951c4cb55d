"""Hash embedding and 64-bit hashes of strings, for whole Arrow batches."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_U = np.uint64
LCG_A, LCG_C = 6364136223846793005, 1442695040888963407
_MASK = (1 << 64) - 1


def _signed_bytes(text: str) -> np.ndarray:
    """UTF-8 bytes, those from 128 extended with their sign."""
    return np.frombuffer(text.encode(), np.int8).astype(np.int64).view(_U)


@functools.lru_cache(maxsize=4)
def _powers33(n: int) -> np.ndarray:
    a = np.full(n, 33, _U)
    a[:1] = 1
    return np.multiply.accumulate(a)


def djb2(text: str) -> int:
    """h = 33 h + byte from 5381, modulo 2**64, as one dot product."""
    b = _signed_bytes(text)
    n = len(b)
    p = _powers33(max(1024, 1 << (n + 1).bit_length()))
    return (int((p[:n][::-1] * b).sum(dtype=_U)) + int(p[n]) * 5381) & _MASK


@functools.lru_cache(maxsize=8)
def _lcg(dim: int) -> tuple[np.ndarray, np.ndarray]:
    a, c, out = 1, 0, []
    for _ in range(dim):
        a, c = a * LCG_A & _MASK, (c * LCG_A + LCG_C) & _MASK
        out.append((a, c))
    return np.array([x for x, _ in out], _U), np.array([x for _, x in out], _U)


def hash_vectors(texts: list[str | None], dim: int) -> np.ndarray:
    """A unit vector for each text from its hash; it has no meaning, but equal texts have equal vectors."""
    h = np.array([djb2(t or "") for t in texts], _U)
    a, c = _lcg(dim)
    x = (h[:, None] * a + c).view(np.int64)
    v = np.sign(x) * (np.abs(x) % 1000) / 1000.0  # the remainder has the sign of x
    low = x == np.iinfo(np.int64).min
    if low.any():
        v[low] = -((1 << 63) % 1000) / 1000.0
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(n > 0, n, 1)


def hash_embed(text: Column | str, dim: int) -> Column:
    """Column of hash_vectors(), array<double>; null for null."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pa.Array) -> pa.Array:
        v = np.concatenate([hash_vectors(texts.slice(s, 1024).to_pylist(), dim) for s in range(0, max(1, len(texts)), 1024)])
        off = pa.array(np.arange(len(v) + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(off, pa.array(v.ravel()), mask=texts.is_null() if texts.null_count else None)

    return embed(text)


def fnv1a_all(texts: pa.Array) -> np.ndarray:
    """The hashes of texts without nulls: a byte of every text at a time, of those that have one left."""
    col = texts.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.int8) if off[-1] > off[0] else np.zeros(0, np.int8)
    length = np.diff(off)
    order = np.argsort(-length, kind="stable")  # those that go on are always the first
    start, left = off[:-1][order], -np.sort(-length)
    h = np.full(len(order), 14695981039346656037, _U)
    for at in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -at, "left"))
        h[:n] = (h[:n] ^ data[start[:n] + at].astype(np.int64).view(_U)) * _U(1099511628211)
    out = np.empty(len(order), _U)
    out[order] = h
    return out.view(np.int64)


def fnv1a_of(text: str) -> int:
    return int(fnv1a_all(pa.array([text]))[0])


def fnv1a(text: Column | str) -> Column:
    """64-bit FNV-1a over the bytes, those from 128 extended with their sign; as a long with the same bits."""

    @F.arrow_udf(T.LongType())
    def hashed(texts: pa.Array) -> pa.Array:
        d = texts.dictionary_encode()
        return pa.array(fnv1a_all(d.dictionary), pa.int64()).take(d.indices)

    return hashed(text)
