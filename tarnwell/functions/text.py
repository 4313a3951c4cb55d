"""Text functions: chunking, keyword hits, templates."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ChunkConfig

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def chunk_bounds(text: str, cfg: ChunkConfig) -> list[tuple[int, int]]:
    """Start and end of each chunk, in characters.

    A chunk ends at the last separator, else at the last line end, that starts in the second half of its size or right
    at its end; else it is cut there. The next one starts `overlap` before the end.
    """
    size, overlap, n, out, at = 4 * cfg.chunk_size, 4 * cfg.chunk_overlap, len(text), [], 0
    while n:
        end = at + size
        if end >= n:
            out.append((at, n))
            break
        for sep in (cfg.separator, "\n"):
            found = text.rfind(sep, at + size // 2 + 1, end + len(sep))
            if found >= 0:
                end = found + len(sep)
                break
        out.append((at, end))
        if end >= n:
            break
        at = end - overlap if end > overlap else end
    return out


def sliced(f: Callable[..., pa.Array], *columns: pa.Array, rows: int = 256) -> pa.Array:
    """f of the columns, some rows at a time, so that Python has objects of these only."""
    return pa.concat_arrays([f(*(c.slice(s, rows) for c in columns)) for s in range(0, max(1, len(columns[0])), rows)])


def chunks(docs: DataFrame, cfg: ChunkConfig = ChunkConfig(), key: str = "doc_id", text: str = "text", sizes: tuple[str, str] | None = None) -> DataFrame:
    """(key, chunk_idx, text): chunks of every text; null and empty texts have none. sizes: columns of each row's own
    chunk_size and chunk_overlap, which replace those of cfg where they aren't null; ValueError as in ChunkConfig."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return sliced(lambda x: pa.array([[t[a:b] for a, b in chunk_bounds(t, cfg)] if t else [] for t in x.to_pylist()], pa.list_(pa.string())), texts)

    @F.arrow_udf("array<string>")
    def cut_by(texts: pa.Array, size: pa.Array, overlap: pa.Array) -> pa.Array:
        of = functools.cache(lambda s, o: replace(cfg, **{k: v for k, v in (("chunk_size", s), ("chunk_overlap", o)) if v is not None}))
        return sliced(lambda *x: pa.array([[t[a:b] for a, b in chunk_bounds(t, of(s, o))] if t else [] for t, s, o in zip(*(c.to_pylist() for c in x), strict=True)], pa.list_(pa.string())), texts, size, overlap)

    parts = cut(text) if sizes is None else cut_by(text, *sizes)
    return docs.select(key, F.posexplode(parts).alias("chunk_idx", "text"))


def ascii_lower(s: Column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(s, _UPPER, _LOWER)


def words(s: Column) -> Column:
    """Runs without ASCII white space."""
    return F.filter(F.split(s, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def keyword_hits(query: Column, text: Column) -> Column:
    """How many words of the query (repeated ones count again) the text contains, as substrings, without case."""
    once = F.array(F.struct(ascii_lower(text).alias("t"), words(ascii_lower(query)).alias("w")))  # a lambda's argument is computed once, not for each word
    return F.transform(once, lambda o: F.size(F.filter(o["w"], lambda w: F.contains(o["t"], w))))[0]


class Keywords:
    """The words of queries, to be counted in many texts as keyword_hits() does."""

    def __init__(self, queries: list[str | None]) -> None:
        split = [(q or "").encode().lower().split() for q in queries]  # of bytes both know ASCII only
        self.place = {w: i for i, w in enumerate(dict.fromkeys(w for q in split for w in q))}
        self.lengths = sorted({len(w) for w in self.place})
        self.times = np.zeros((len(self.place), len(queries)), np.float32)
        np.add.at(self.times, ([self.place[w] for q in split for w in q], [i for i, q in enumerate(split) for _ in q]), 1)
        self.known: dict[bytes, frozenset[int]] = {}

    def _within(self, token: bytes) -> frozenset[int]:
        """Which words the token contains; words have no white space, so that a text contains those of its tokens."""
        found = self.known.get(token)
        if found is None:
            if len(token) * len(self.lengths) > 4 * len(self.place):
                found = frozenset(i for w, i in self.place.items() if w in token)
            else:
                found = frozenset(i for n in self.lengths for s in range(len(token) - n + 1) if (i := self.place.get(token[s : s + n])) is not None)
            if len(self.known) >= 1 << 17:
                self.known.clear()
            if len(token) <= 64:
                self.known[token] = found
        return found

    def hits(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text, a column for each query."""
        there = np.zeros((len(texts), len(self.place)), np.float32)
        for i, t in enumerate(texts):
            there[i, list(frozenset().union(*map(self._within, set((t or "").encode().lower().split()))))] = 1
        return (there @ self.times).astype(np.int32)


def hit_table(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", qkey: str = "query_id", query: str = "query") -> DataFrame:
    """(qkey, key, hits) of every query and document: keyword_hits() of all pairs; 0 in a null text, null for a null query.

    Documents and queries meet in bounded packs, and each word is looked for once in a document, whatever queries have it.
    """
    kinds = {"qkey": queries.schema[qkey].dataType.simpleString(), "key": docs.schema[key].dataType.simpleString()}

    def pack(rows: int, size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                length = np.cumsum(np.concatenate([[0], np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0))]))
                s = 0
                while s < b.num_rows:
                    e = min(s + rows, max(s + 1, int(np.searchsorted(length, length[s] + size, "right")) - 1))
                    part = b.slice(s, e - s)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, e - s], pa.int32()), c) for c in part.columns], names=b.schema.names)
                    s = e

        return run

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, Keywords] = {}
        for b in batches:
            for i, block in enumerate(b.column("block").to_pylist()):
                asked = b.column("queries")[i].values
                if block not in words:
                    if len(words) == 8:
                        words.pop(next(iter(words)))
                    words[block] = Keywords(asked.to_pylist())
                texts = b.column("texts")[i].values.to_pylist()
                n = len(texts)
                hits = pa.array(words[block].hits(texts).ravel(), mask=np.tile(np.asarray(asked.is_null()), n))
                qids, ids = b.column("qids")[i].values, b.column("ids")[i].values
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(np.tile(np.arange(len(asked)), n))), ids.take(pa.array(np.repeat(np.arange(n), len(asked)))), hits], names=[qkey, key, "hits"])

    d = docs.select(F.col(key).alias("ids"), F.col(text).alias("texts")).mapInArrow(pack(512, 1 << 20), f"ids array<{kinds['key']}>, texts array<string>")
    q = queries.select(F.col(qkey).alias("qids"), F.col(query).alias("queries")).mapInArrow(pack(256, 1 << 18), f"qids array<{kinds['qkey']}>, queries array<string>")
    return d.crossJoin(q.withColumn("block", F.monotonically_increasing_id())).mapInArrow(count, f"`{qkey}` {kinds['qkey']}, `{key}` {kinds['key']}, hits int")


def general(x: Column) -> Column:
    """A number with six significant digits, without zeros at the end."""
    out = x.cast("string")
    for places in range(0, 10):
        low, high = 10.0 ** (5 - places), 10.0 ** (6 - places)
        text = F.format_string(f"%.{places}f", x)
        text = F.regexp_replace(text, r"\.?0+$", "") if places else text
        out = F.when((F.abs(x) >= low) & (F.abs(x) < high), text).otherwise(out)
    return F.when(x == 0, F.lit("0")).otherwise(out)


def replace_first(s: Column, what: str, by: Column) -> Column:
    """s with its first `what` replaced, taken literally."""
    at = F.locate(what, s)
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), by, F.substring(s, at + len(what), F.length(s)))).otherwise(s)


def fill_template(template: str, context: Column, query: Column) -> Column:
    """The first {context}, then the first {query} of what results."""
    return replace_first(replace_first(F.lit(template), "{context}", context), "{query}", query)
