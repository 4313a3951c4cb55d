"""Longest-prefix lookup as a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(prefixes: DataFrame, order: str | None = None) -> DataFrame:
    """(prefix, cache_id): the last id of each prefix. Empty prefixes and the id 0 never match and are left out."""
    usable = prefixes.where("prefix IS NOT NULL AND prefix <> '' AND cache_id <> 0")
    pick = F.max_by("cache_id", order) if order else F.max("cache_id")
    return usable.groupBy("prefix").agg(pick.alias("cache_id"))


def matches(texts: DataFrame, prefixes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, prefix, cache_id) of every prefix of every text.

    An equality join: each text is looked up with its beginnings of the lengths that prefixes have, of which there
    are few. Nothing is compared pair by pair.
    """
    lengths = prefixes.agg(F.sort_array(F.collect_set(F.length("prefix"))).alias("lens"))
    starts = texts.crossJoin(F.broadcast(lengths)).select(key, F.explode(F.transform(F.filter("lens", lambda n: n <= F.length(text)), lambda n: F.substring(F.col(text), F.lit(1), n))).alias("prefix"))
    return starts.join(prefixes, "prefix").select(key, "prefix", "cache_id")


def longest(texts: DataFrame, prefixes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cache_id, matched_bytes): the longest prefix of each text; (0, 0) if it has none. key is unique."""
    best = matches(texts, prefixes, key, text).groupBy(key).agg(F.max_by("cache_id", F.octet_length("prefix")).alias("c"), F.max(F.octet_length("prefix")).alias("b"))
    return texts.select(key).join(best, key, "left").select(key, F.coalesce("c", F.lit(0)).cast("long").alias("cache_id"), F.coalesce("b", F.lit(0)).cast("long").alias("matched_bytes"))


def hit_stats(texts: DataFrame, prefixes: DataFrame, key: str, text: str) -> DataFrame:
    """(hits, misses) over all texts."""
    found = longest(texts, prefixes, key, text)
    return found.agg(F.count_if(F.col("cache_id") != 0).alias("hits"), F.count_if(F.col("cache_id") == 0).alias("misses"))


def node_hits(texts: DataFrame, prefixes: DataFrame, key: str, text: str) -> DataFrame:
    """(prefix, cache_id, hits): how many texts each prefix is a prefix of, not only as the longest."""
    n = matches(texts, prefixes, key, text).groupBy("prefix").agg(F.count("*").alias("n"))
    return prefixes.join(n, "prefix", "left").select("prefix", "cache_id", F.coalesce("n", F.lit(0)).alias("hits"))


def size(inserts: DataFrame) -> DataFrame:
    """(size): number of inserts; writing a prefix again counts again."""
    return inserts.agg(F.count("*").alias("size"))


