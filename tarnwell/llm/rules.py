"""Quality rules: a decision list of threshold conjunctions, learned by sequential covering from labelled documents.

The statistics of a text come from one pass over its bytes (an Arrow function). On the labelled documents, rules for
low quality are grown one after another: conditions `statistic >= x` or `statistic <= x` are added by information
gain on two thirds of what no rule covers yet, and dropped again from the end while that does better on the other
third. A rule stays if enough of what it rejects there is of low quality. The list is an ordered conditional
expression of Spark over the statistics' columns.

Defined results: a null text counts as an empty one; without labels of both kinds the list is empty and rejects
nothing; labels with nulls are not used; rows of equal doc_id in labels count once (the lowest quality wins); every
input row is judged by itself, repeated rows alike, and for the fit a labelled document counts once (of rows of equal
doc_id the smallest statistics); thresholds lie between values, so that equal values fall on one side; statistics are
those of whole texts of any length; an empty table gives an empty result; columns of the input that are named like a
statistic stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C


@dataclass(frozen=True)
class RuleConfig:
    """sample: most labelled documents that the rules are fitted on, by order of a hash of doc_id."""

    sample: int = 20_000
    precision: float = 0.95
    support: int = 3
    conditions: int = 4
    rules: int = 24
    thresholds: int = 48
    seed: int = 3


STATISTICS = ("chars", "words", "word_length", "upper", "digits", "symbols", "stops", "spaces", "other_script", "unique_words", "longest_word", "lines", "line_length", "repeated_lines", "odd_word_ends")

_B = np.arange(256)
_CONT = (_B & 0xC0) == 0x80
_UPPER, _LOWER, _DIGIT = (_B >= 65) & (_B <= 90), (_B >= 97) & (_B <= 122), (_B >= 48) & (_B <= 57)
_SPACE = np.isin(_B, [9, 10, 11, 12, 13, 32])
_STOP = np.isin(_B, [ord(c) for c in ".,;:?'\"()-"])
_SYMBOL = (_B > 32) & (_B < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_STOP
_NOT_NEWLINE = _B != 10
_NOT_SPACE = ~_SPACE


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (c[off[1:] - off[0]] - c[off[:-1] - off[0]]).astype(float)


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys by document."""
    k = np.sort((C.mix(keys + C.mix(doc.astype(np.uint64) + np.uint64(9))) & ~np.uint64(0xFFFFFF)) | (doc.astype(np.uint64) & np.uint64(0xFFFFFF)))
    k = k[np.concatenate([[True], k[1:] != k[:-1]])] if len(k) else k
    return np.bincount((k & np.uint64(0xFFFFFF)).astype(np.int64), minlength=n).astype(float)


def statistics(texts: pa.Array | pa.ChunkedArray) -> dict[str, np.ndarray]:
    """The statistics by text."""
    col = C.utf8(texts)
    buf, off = C.raw(col)
    parts = []
    for a, b in C._slices(off):
        sub = off[a : b + 1]
        n, x = b - a, buf[sub[0] : sub[-1]]
        doc_of = lambda s: np.searchsorted(sub[1:], s, "right")  # noqa: B023, E731
        chars = _sums(~_CONT[x], sub)
        some = np.maximum(chars, 1)
        s, e = C.spans(buf, sub, _NOT_SPACE)
        wd = doc_of(s)
        words = np.bincount(wd, minlength=n).astype(float)
        length = e - s
        longest = np.zeros(n)
        np.maximum.at(longest, wd, length)
        odd = np.bincount(wd, weights=_SYMBOL[buf[e - 1]] if len(e) else None, minlength=n)
        ls, le = C.spans(buf, sub, _NOT_NEWLINE)
        ld = doc_of(ls)
        lines = np.bincount(ld, minlength=n).astype(float)
        st = {"chars": chars, "words": words, "word_length": chars / np.maximum(words, 1), "longest_word": longest, "lines": lines, "line_length": chars / np.maximum(lines, 1)}
        for name, table in (("upper", _UPPER), ("digits", _DIGIT), ("symbols", _SYMBOL), ("stops", _STOP), ("spaces", _SPACE), ("other_script", _B >= 0xC0)):
            st[name] = _sums(table[x], sub) / some
        st["unique_words"] = _distinct(C._hash_runs(buf, s, e), wd, n) / np.maximum(words, 1)
        st["repeated_lines"] = 1 - _distinct(C._hash_runs(buf, ls, le), ld, n) / np.maximum(lines, 1)
        st["odd_word_ends"] = odd / np.maximum(words, 1)
        parts.append(st)
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in STATISTICS}


@F.arrow_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))
def _statistics_udf(texts: pa.Array) -> pa.Array:
    st = statistics(texts)
    return pa.StructArray.from_arrays([pa.array(st[k]) for k in STATISTICS], names=list(STATISTICS))


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.statistic] >= self.value if self.at_least else x[self.statistic] <= self.value

    def column(self, struct: str) -> Column:
        c = F.col(f"{struct}.{self.statistic}")
        return c >= self.value if self.at_least else c <= self.value

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _thresholds(x: dict[str, np.ndarray], y: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Cuts by statistic: in the middle between values that follow each other, about the quantiles of either kind."""
    out = {}
    for s, v in x.items():
        values = np.unique(v)
        at = np.searchsorted(values, np.concatenate([np.quantile(w, np.linspace(0, 1, k), method="nearest") for w in (v[y], v[~y]) if len(w)]))
        at = np.unique(np.concatenate([at, at + 1]))
        at = at[(at > 0) & (at < len(values))]
        out[s] = (values[at - 1] + values[at]) / 2
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, cfg: RuleConfig) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(y), bool)
    while len(rule) < cfg.conditions and y[inside].any() and not y[inside].all():
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        sub = {s: v[inside] for s, v in x.items()}
        yy, best = y[inside], (1e-9, None)
        for s, values in _thresholds(sub, yy, cfg.thresholds).items():
            lo = sub[s]
            for up in (True, False):
                for v in values:
                    m = lo >= v if up else lo <= v
                    p, n = (m & yy).sum(), (m & ~yy).sum()
                    if p and p + n < len(yy):
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, Condition(s, up, float(v)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = covers(tuple(rule), x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        m = covers(r, x)
        return (y[m].sum() - (~y[m]).sum()) / max(1, m.sum())

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth) if rule else rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, cfg: RuleConfig = RuleConfig()) -> list[Rule]:
    """Rules for the documents that are bad, by sequential covering."""
    rng = np.random.default_rng(cfg.seed)
    left, out = np.ones(len(bad), bool), []
    while len(out) < cfg.rules and bad[left].sum() >= cfg.support:
        i = np.flatnonzero(left)
        rng.shuffle(i)
        grow, prune = i[: 2 * len(i) // 3], i[2 * len(i) // 3 :]
        rule = _grow({s: v[grow] for s, v in x.items()}, bad[grow], cfg)
        rule = _prune(rule, {s: v[prune] for s, v in x.items()}, bad[prune])
        if not rule:
            break
        m, held = covers(rule, x) & left, covers(rule, x)
        part = np.zeros(len(bad), bool)
        part[prune] = True
        test = held & part
        if m.sum() < cfg.support or bad[m].mean() < cfg.precision or (test.any() and bad[test].mean() < cfg.precision):
            break
        out.append(rule)
        left &= ~held
    return out


def rejects(rules: list[Rule], struct: str = "_stats") -> Column:
    """Number of the first rule that holds, from 1, or null: an ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.column(struct)
        out = F.when(cond, k) if out is None else out.when(cond, k)
    return F.lit(None).cast("int") if out is None else out


def fit(docs: DataFrame, labels: DataFrame, cfg: RuleConfig = RuleConfig()) -> list[Rule]:
    """The decision list of at most `sample` labelled documents."""
    few = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.sample)
    met = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # of bounded size
    one = met.select("doc_id", F.struct("quality", _statistics_udf(F.coalesce("text", F.lit(""))).alias("_stats")).alias("_x")).groupBy("doc_id").agg(F.min("_x").alias("_x"))
    rows = one.select("_x.quality", "_x._stats.*").toArrow()  # a row for each labelled document, however often docs has it
    x = {s: rows.column(s).to_numpy() for s in STATISTICS}
    order = np.lexsort([*x.values(), rows.column("quality").to_numpy()])  # rows come in no order
    return learn({s: v[order] for s, v in x.items()}, rows.column("quality").to_numpy()[order] == 0, cfg)


def judge(docs: DataFrame, rules: list[Rule], stats: str = "_stats", rule: str = "_rule") -> DataFrame:
    """docs with a struct of the statistics and the number of the rule that rejects a row, or null."""
    return docs.withColumn(stats, _statistics_udf(F.coalesce("text", F.lit("")))).withColumn(rule, rejects(rules, stats))


def keep_good(docs: DataFrame, labels: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """The rows of docs that no rule rejects; all columns as they were."""
    stats, rule = C.fresh(docs, "_stats"), C.fresh(docs, "_rule")
    return judge(docs, fit(docs, labels, cfg), stats, rule).where(F.col(rule).isNull()).select(*docs.columns)
