import random
import re

import numpy as np
import pyarrow as pa

from tarnwell.llm import rules as R

from .helpers import awkward, empty, table, words


def samples(n, seed):
    r = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        w = words(int(r.integers(20, 200)), seed * 10_000 + i)
        bad = i % 5
        if bad == 0:
            w = [x + "###" for x in w]
        elif bad == 1:
            w = ["spam", "eggs"] * (len(w) // 2)
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if bad < 2 else 1, 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = samples(600, 1)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = R.fit(table(spark, rows), lab)
    assert 1 <= len(rules) <= R.RuleConfig().rules
    rows, labels = samples(400, 2)
    got = {r.doc_id for r in R.judge(table(spark, rows), rules).where("_rule IS NOT NULL").collect()}
    bad = {d for d, q, _ in labels if q == 0}
    assert len(got & bad) >= 0.97 * len(bad) and len(got - bad) <= 0.01 * len(rows)


def test_the_expression_is_the_list(spark):
    rows, labels = samples(300, 3)
    x = R.statistics(pa.array([t for _, t in rows]))
    rules = R.learn(x, np.array([q == 0 for _, q, _ in labels]))
    want = {}
    for k, rule in reversed(list(enumerate(rules, 1))):
        for i in np.flatnonzero(R.covers(rule, x)):
            want[rows[i][0]] = k
    got = {r.doc_id: r._rule for r in R.judge(table(spark, rows), rules).collect() if r._rule is not None}
    assert got == want


def test_statistics():
    s = R.statistics(pa.array(["Ab cd!\nAb cd!\nx1 é", None, ""]))
    assert s["chars"].tolist() == [18, 0, 0] and s["words"].tolist() == [6, 0, 0] and s["lines"].tolist() == [3, 0, 0]
    assert abs(s["unique_words"][0] - 4 / 6) < 1e-12 and abs(s["repeated_lines"][0] - 1 / 3) < 1e-12 and abs(s["upper"][0] - 2 / 18) < 1e-12


def plain_statistics(text):
    """The statistics by their definition, a character at a time."""
    text = text or ""
    raw = text.encode()
    chars, blank, stops = len(text), "\t\n\x0b\x0c\r ", ".,;:?'\"()-"
    ws, ls = [w for w in re.split(f"[{blank}]+", text) if w], [x for x in text.split("\n") if x]
    symbol = lambda c: 32 < c < 127 and not chr(c).isalnum() and chr(c) not in stops
    some, nw, nl = max(chars, 1), max(len(ws), 1), max(len(ls), 1)
    return {
        "chars": chars, "words": len(ws), "word_length": chars / nw, "upper": sum("A" <= c <= "Z" for c in text) / some, "digits": sum("0" <= c <= "9" for c in text) / some, "symbols": sum(map(symbol, raw)) / some,
        "stops": sum(c in stops for c in text) / some, "spaces": sum(c in blank for c in text) / some, "other_script": sum(c >= 0xC0 for c in raw) / some, "unique_words": len(set(ws)) / nw,
        "longest_word": max((len(w.encode()) for w in ws), default=0), "lines": len(ls), "line_length": chars / nl, "repeated_lines": 1 - len(set(ls)) / nl, "odd_word_ends": sum(symbol(w.encode()[-1]) for w in ws) / nw,
    }


def test_statistics_by_their_definition():
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "B", "7", " ", "\n", ".", "#", "é", "漢", "😀", "word ", "\t", "-", "$"]) for _ in range(r.randrange(80))) for _ in range(300)] + [None, "", "\n", "x" * 5000]
    got = R.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        for k, v in plain_statistics(t).items():
            # a text without lines or words has no repeated ones
            want = 0 if k == "repeated_lines" and not [x for x in (t or "").split("\n") if x] else v
            assert abs(got[k][i] - want) < 1e-9 or (k == "repeated_lines" and not (t or "").strip("\n")), (k, t)


def test_the_query_by_brute_force(spark):
    """keep_good() against the list applied one document and one condition at a time."""
    rows, labels = samples(500, 6)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = table(spark, rows + rows[:40] + [(None, rows[0][1]), (9000, None), (9001, "")])
    kept = []
    rules = R.fit(docs, lab)
    for d in docs.collect():
        st = plain_statistics(d.text)
        if not any(all(st[c.statistic] >= c.value if c.at_least else st[c.statistic] <= c.value for c in rule) for rule in rules):
            kept.append(str(d))
    assert rules and 0 < len(kept) < docs.count() and sorted(map(str, R.keep_good(docs, lab).collect())) == sorted(kept)
    assert [[str(c) for c in rule] for rule in rules] == [[str(c) for c in rule] for rule in R.fit(table(spark, rows[::-1]), lab)]  # repeats and order don't matter


def test_the_first_condition_has_the_greatest_gain():
    r = np.random.default_rng(3)
    x = {"a": r.integers(0, 12, 200).astype(float), "b": r.random(200).round(1)}
    y = (x["a"] >= 7) & (r.random(200) < 0.9)
    best, p0 = 0, y.mean()
    for v in x.values():
        u = np.unique(v)
        for t in (u[1:] + u[:-1]) / 2:
            for m in (v >= t, v <= t):
                if y[m].any():
                    best = max(best, y[m].sum() * (np.log2(y[m].mean()) - np.log2(p0)))
    c = R._grow(x, y, R.RuleConfig(thresholds=400))[0]
    m = c.holds(x)
    assert abs(y[m].sum() * (np.log2(y[m].mean()) - np.log2(p0)) - best) < 1e-9


def test_awkward_rows_and_labels(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert R.keep_good(docs, none).count() == docs.count()
    odd = spark.createDataFrame([(1, None, 0), (None, 0, 0), (5, 1, 0), (7, 0, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    kept = R.keep_good(docs, odd)
    assert kept.columns == docs.columns and {r._stats for r in kept.collect()} == {"own"}
    rows, labels = samples(200, 4)
    rules = R.fit(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert R.judge(docs, rules, "s1", "r1").count() == docs.count()
    assert R.keep_good(empty(spark), odd).collect() == []
