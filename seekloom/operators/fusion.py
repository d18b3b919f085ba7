"""Reciprocal rank fusion of engines, with adaptive weights, penalties and filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekloom.functions.urls import domain

RRF_K = 60
#: Engines in the order in which the first document of a URL wins, and their weights.
ENGINES = ("DIR", "FTS", "IVF", "DIS", "DEC")
WEIGHTS = {"DIR": 3.0, "DIS": 0.5, "DEC": 0.9}
QUESTION_WORDS = ("what", "why", "how", "when", "who", "where", "which")
INTENTS = ("informational", "navigational", "transactional", "commercial", "local", "unknown")


def adaptive_weights(query: Column) -> Column:
    """struct<fts, ivf>: heuristics over the query's tokens, each capped at 2."""
    tokens = F.filter(F.split(F.trim(query), r"\s+"), lambda t: t != "")
    n = F.size(tokens)
    quotes = F.contains(query, F.lit('"'))
    question = F.exists(tokens, lambda t: F.lower(t).isin(*QUESTION_WORDS))
    long_words = (n > 0) & (F.size(F.filter(tokens, lambda t: F.octet_length(t) > 7)) > 0.3 * n)
    part = lambda ok, x: F.when(ok, F.lit(x)).otherwise(F.lit(0.0))
    fts = 1.0 + part(n <= 2, 0.7) + part(quotes, 0.8) + part(long_words, 0.4)
    ivf = 1.0 + part(n >= 6, 0.7) + part(question, 0.6)
    return F.struct(F.round(F.least(fts, F.lit(2.0)), 6).alias("fts"), F.round(F.least(ivf, F.lit(2.0)), 6).alias("ivf"))


def query_weights(query: str) -> dict[str, float]:
    """The same for one query on the driver, with the fixed weights of the other engines."""
    t = query.split()
    fts = 1 + 0.7 * (len(t) <= 2) + 0.8 * ('"' in query) + 0.4 * bool(t and sum(len(x.encode()) > 7 for x in t) > 0.3 * len(t))
    ivf = 1 + 0.7 * (len(t) >= 6) + 0.6 * any(x.lower() in QUESTION_WORDS for x in t)
    return WEIGHTS | {"FTS": min(fts, 2.0), "IVF": min(ivf, 2.0)}


def gates(query: str) -> tuple[bool, bool]:
    """Whether full-text and vector search run for a query."""
    cjk = len(re.findall(r"[฀-๿぀-ヿ㐀-鿿가-힯]", query))
    return len(query.split()) < 8 and cjk < 15, not re.search(r'["|:-]| OR ', query)


def fuse(hits: DataFrame, weights: dict[str, float], lang: str = "", intent: int = 5, k: int = RRF_K) -> DataFrame:
    """(engine, url, score, lang, intent, ..) -> one row per URL: search_score, sources in engine order.

    Rank in an engine is by score, then url; a repeated URL adds score but no
    source; the other columns come from the first engine's best row.
    """
    order = F.array_position(F.array(*[F.lit(e) for e in ENGINES]), F.col("engine"))
    within = Window.partitionBy("engine").orderBy(F.col("score").desc(), "url")
    w = F.element_at(F.create_map(*[F.lit(x) for e in ENGINES for x in (e, float(weights.get(e, 1.0)))]), F.col("engine"))
    foreign = F.col("engine").isin("FTS", "IVF") & F.lit(bool(lang) and lang != "all") & (F.col("lang") != lang)
    penalty = F.when(foreign, F.lit(0.7 if intent == 1 else 0.1)).otherwise(F.lit(1.0))
    boost = F.when((F.col("intent") == intent) & F.lit(intent != 5), F.lit(1.3)).otherwise(F.lit(1.0))
    ranked = hits.withColumn("_rank", F.row_number().over(within) - 1).withColumn("_part", w / (k + F.col("_rank") + 1) * penalty * boost).withColumn("_ord", order)
    rest = [c for c in hits.columns if c not in ("engine", "url", "score")]
    return ranked.groupBy("url").agg(
        F.round(F.sum("_part"), 9).alias("search_score"),
        F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("_ord", "engine"))), lambda s: s["engine"]), ",").alias("source"),  # at most one entry an engine
        *[F.min_by(c, F.struct("_ord", "_rank")).alias(c) for c in rest],
    )


def site_filter(rows: DataFrame, sites: list[str]) -> DataFrame:
    """Rows whose domain is one of the sites or below one; no sites keep all."""
    names = [re.sub(r"^www\.", "", re.sub(r"^https?://", "", s)).rstrip("/").lower() for s in sites]
    if not names:
        return rows
    d = domain(F.col("url"))
    keep = F.lit(False)
    for n in names:
        keep |= (d == n) | F.endswith(d, F.lit("." + n))
    return rows.where(keep)


def drop_http_twins(rows: DataFrame) -> DataFrame:
    """Without http:// rows whose https:// twin is there, a final slash apart."""
    bare = F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"/$", "")
    twins = rows.where(F.startswith("url", F.lit("https://"))).select(bare.alias("_bare")).distinct()
    http = rows.where(~F.startswith("url", F.lit("https://"))).withColumn("_key", bare)
    kept = http.join(twins, http["_key"] == twins["_bare"], "left_anti").drop("_key")
    return rows.where(F.startswith("url", F.lit("https://"))).unionByName(kept)
