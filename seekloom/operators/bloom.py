"""Keyword filters of peers: 4,096 bits, three places from slices of a word's hash.

A filter is an array of 64 longs. Bits are set by bit_or over (key, long), so
building is a partial aggregate of at most 64 rows a key, and probing a word looks
at three longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, SLICE = 4096, 12


def keyword_hash(word: Column) -> Column:
    """36 bits of the word's MD5: any hash will do as long as peers share it."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 9), 16, 10).cast("long")


def places(hashed: Column) -> list[Column]:
    """The three bits of a hash."""
    return [F.shiftrightunsigned(hashed, SLICE * k).bitwiseAND(F.lit(BITS - 1)) for k in range(3)]


def build(words: DataFrame, key: str, word: str = "term") -> DataFrame:
    """(key, word) -> (key, filter array<long>); keys without a word have no row."""
    bit = F.explode(F.array(*places(keyword_hash(F.col(word))))).alias("_bit")
    rows = words.where(F.col(word).isNotNull()).select(key, bit)
    parts = rows.groupBy(key, F.shiftright("_bit", 6).cast("int").alias("_k")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit").bitwiseAND(63).cast("int"))).alias("_v"))
    known = parts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_m"))  # at most 64 entries
    every = F.transform(F.sequence(F.lit(0), F.lit(BITS // 64 - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0).cast("long")))
    return known.select(key, every.alias("filter"))


def holds(filter_column: Column, word: Column) -> Column:
    """Whether a word may have been put in; never false for one that was."""
    out = F.lit(True)
    for bit in places(keyword_hash(word)):
        part = F.get(filter_column, F.shiftright(bit, 6).cast("int"))
        out &= F.call_function("getbit", part, bit.bitwiseAND(63).cast("int")) == 1
    return out


def fill(filter_column: Column) -> Column:
    """Share of the bits that are set."""
    return F.aggregate(filter_column, F.lit(0), lambda a, x: a + F.bit_count(x)) / F.lit(float(BITS))


def best_peers(filters: DataFrame, words: DataFrame, key: str, word: str = "term", most: int = 4) -> DataFrame:
    """(key, hits): the peers whose filter holds most of the words, ties by key; peers without a hit are left out.

    filters has a row of 512 bytes a peer, words those of one query.
    """
    asked = words.select(word).distinct()
    hit = filters.join(F.broadcast(asked) if asked.limit(100_001).count() <= 100_000 else asked, holds(F.col("filter"), F.col(word)))
    return hit.groupBy(key).agg(F.count("*").alias("hits")).orderBy(F.col("hits").desc(), key).limit(most)


def peer_summary(centroids: DataFrame, filters: DataFrame) -> DataFrame:
    """One row: distinct centroids over all peers (key, centroid_id), and the filters' mean fill."""
    return centroids.agg(F.countDistinct("centroid_id").alias("centroids")).crossJoin(filters.agg(F.round(F.avg(fill(F.col("filter"))), 6).alias("mean_fill")))
