"""Tables for the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; the input may have them too.
CLASHING = ["key", "words", "tokens", "_stats", "_rule", "_n", "_id", "_gone", "_new", "_k", "a", "b", "bucket", "regs", "start", "doc", "place", "seg", "copies", "g", "o", "p", "host", "html", "reference"]


def words(n, seed, vocabulary=3000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def table(spark, rows):
    """Documents of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("own") for c in CLASHING if c not in df.columns})


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, clashing names."""
    long = " ".join(words(60_000, 1))
    shared = " ".join(words(120, 2))
    rows = [
        (1, shared, "en", "s1", 3), (2, shared, None, None, None), (2, shared, None, None, None), (3, None, "en", "s1", 0), (None, shared, "en", "s1", 1), (4, "", "en", "s2", 0), (5, long, "en", "s2", len(long)),
        (6, " \n\t ", "fr", "s2", 4), (7, "one", "en", None, 3), (None, None, None, None, None), (8, "ünïcødé 漢字 😀 " * 30, "xx", "s3", 9), (9, long + " and more", "en", "s1", 7),
    ]
    return with_clashes(spark.createDataFrame(rows, SCHEMA))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
