"""Feature-driven re-ranking: boosts, rule sets, PageRank factor, rerank seam, domain cap.

Everything is a product of column expressions over the candidates of one query.
The global windows here run over candidate lists of at most a few hundred rows.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seekloom.functions import urls
from seekloom.session import checkpoints

#: Default weights of the factors.
W = {
    "domain_match": 4.164, "homepage": 1.8207127570559796, "product": 1.2, "shop": 1.1151867372193276, "wiki": 1.3623035283335967,
    "edu": 1.2588360222339798, "info_shop": 0.6423278191323988, "lang": 1.01, "loc": 1.242, "tld_loc": 1.2, "wiki_lang": 1.3905070941466917,
    "wiki_other": 0.1, "https": 1.3521680592049155, "com": 1.01, "org": 1.0343461125773576, "bad_url": 0.99, "depth": 0.7579354778664352,
    "title": 1.3818951856263455, "readability": 0.001, "effort": 0.26516713994470764, "long_effort": 0.85, "words": 1.15, "words_intent": 1.1,
    "few_words": 0.9, "mobile": 1.0, "not_mobile": 1.0,
}
INFORMATIONAL, NAVIGATIONAL, TRANSACTIONAL, COMMERCIAL, LOCAL, UNKNOWN = range(6)
LOADS = ((0.2, 1.08), (0.3, 1.05), (0.5, 1.02), (1.2, 1.0), (2.0, 0.9), (3.5, 0.7), (5.0, 0.4))
#: The rules of a query are broadcast up to so many rows; beyond, they are joined by shuffle.
BROADCAST_RULES = 200_000


def reload_weights(spark: SparkSession, folder: str, current: dict[str, float]) -> dict[str, float]:
    """Weights of folder/weights.json once folder/weights.ready is there, which is then removed; an unreadable file changes nothing."""
    ready = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/weights.ready")
    files = ready.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(ready):
        return current
    try:
        text = spark.read.text(f"{folder}/weights.json", wholetext=True).first().value
        found = {k: float(v) for k, v in json.loads(text).items()}
        new = current | {k: v for k, v in found.items() if k in W}
    except (AnalysisException, AttributeError, TypeError, ValueError):
        new = current
    files.delete(ready, False)
    return new


def load_factor(seconds: Column) -> Column:
    """Steps of loading time; a NaN falls through to the last."""
    out = F.when(F.isnan(seconds), F.lit(0.1))
    for limit, x in LOADS:
        out = out.when(seconds < limit, F.lit(x))
    return out.otherwise(F.lit(0.1))


def factor(ok: Column, x: float) -> Column:
    return F.when(ok, F.lit(x)).otherwise(F.lit(1.0))


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found |= F.contains(text, F.lit(part))
    return found


def _after_scheme(url: Column) -> Column:
    """What follows the first "://" up to another one, null if there is none."""
    return F.get(F.split(url, "://", -1), F.lit(1))


def url_factors(url: Column, w: dict[str, float] = W) -> Column:
    """The part of the boost that a URL alone decides, its query and fragment apart: scheme, TLD, odd characters, depth."""
    clean = urls.strip_noise(url)
    body = F.coalesce(_after_scheme(clean), clean)
    tld = F.when(_any(clean, (".dev", ".com")), w["com"]).when(_any(clean, (".org", ".net")), w["org"]).otherwise(1.0)
    depth = F.length(clean) - F.length(F.replace(clean, F.lit("/"), F.lit(""))) - 2
    return factor(F.startswith(clean, F.lit("https://")), w["https"]) * tld * factor(_any(body, ("_", ",,", ":")), w["bad_url"]) * F.when(depth > 0, F.pow(F.lit(w["depth"]), depth)).otherwise(F.lit(1.0))


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def hand_boost(query: str, lang: str, loc: str, intent: int, w: dict[str, float] = W) -> Column:
    """The product of the factors before rule sets, for columns url, title, lang, loc, load, qna, readability, effort."""
    clean, q = urls.strip_noise(F.col("url")), query.lower()
    rest = F.coalesce(_after_scheme(clean), F.lit(""))
    b = F.lit(1.0)
    if intent == NAVIGATIONAL:
        root = F.split_part(F.regexp_replace(F.split_part(rest, F.lit("/"), F.lit(1)), r"^www[.]", ""), F.lit("."), F.lit(1))
        b *= factor(F.lower(root) == q, w["domain_match"]) * factor(urls.is_homepage(clean), w["homepage"])
    if intent == COMMERCIAL:
        b *= factor(_any(clean, ("/product/", "/item/", "review")), w["product"]) * factor(_any(clean, (".com", ".shop", ".store")), w["shop"])
    if intent == INFORMATIONAL:
        b *= factor(_any(clean, (".wikipedia.org",)), w["wiki"]) * factor(_any(clean, (".org", ".edu", ".gov")), w["edu"]) * factor(_any(clean, (".shop", "/product/")), w["info_shop"])
    b *= factor(F.col("lang") == lang, w["lang"])
    if intent == LOCAL:
        b *= factor(F.col("loc") == loc, w["loc"])
    b *= factor(F.lower(F.substring_index(F.regexp_replace(rest, "/+$", ""), ".", -1)) == loc.lower(), w["tld_loc"])
    wiki = F.contains(clean, F.lit(".wikipedia.org/wiki/"))
    b *= F.when(wiki & (F.split_part(rest, F.lit("."), F.lit(1)) == lang), w["wiki_lang"]).when(wiki & F.lit(lang != "all"), w["wiki_other"]).otherwise(1.0)
    b *= url_factors(F.col("url"), w) * load_factor(F.col("load")) * factor(F.contains(F.lower("title"), F.lit(q)), w["title"])
    b *= 1 + _clamp(F.col("qna") / 2400, -0.2, 0.25)
    readable = _clamp(F.col("readability") / 100, 0.0, 1.0)
    if intent == INFORMATIONAL:
        words = query.split()
        hard = bool(words) and sum(len(x.encode()) for x in words) / len(words) > 7
        b *= 1 + (1 - readable if hard else readable) * F.lit(w["readability"] * 1.4)
    elif intent in (COMMERCIAL, TRANSACTIONAL):
        b *= 1 + _clamp(F.col("qna") / 1200, 0.0, 0.2)
        b *= factor(F.col("effort") > 500, w["long_effort"])
    elif intent != NAVIGATIONAL:
        b *= 1 + readable * F.lit(w["readability"] * 10)
        b *= 1 + _clamp(F.col("effort") / 1000, 0.0, 0.5) * F.lit(w["effort"])
    return b


def usability_factor(intent: int, mobile: bool = False, w: dict[str, float] = W) -> Column:
    """Applied after the rule sets, so that an important domain keeps it: columns has_500_words and, for a mobile user, is_mobile."""
    yes = w["words"] * (w["words_intent"] if intent in (INFORMATIONAL, COMMERCIAL) else 1.0)
    words = F.when(F.col("has_500_words"), F.lit(yes)).otherwise(F.lit(w["few_words"] if intent == INFORMATIONAL else 1.0))
    return words * F.when(F.col("is_mobile"), w["mobile"]).otherwise(w["not_mobile"]) if mobile else words


def _few(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules


def apply_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (url, boost) with the rule sets' effect on boost.

    rules: (goggle_id, kind boost|downrank|discard|important|path|discard_default, domain,
    pattern, weight); www. and apex are two domains. Discarded domains go; if a set
    discards by default only boosted domains and matching paths stay. The first set that
    calls a domain important replaces the boost by its own boost or downrank of the domain
    (or leaves it, if it has neither), else all sets multiply; path rules always multiply.
    """
    rows = rows.withColumn("_d", urls.domain(F.col("url"), remove_www=False))
    discard = rules.where("kind = 'discard'").select(F.col("domain").alias("_x")).distinct()
    rows = rows.join(_few(discard), rows["_d"] == F.col("_x"), "left_anti")
    strength = F.least(F.col("weight"), F.lit(3.0))
    up, down = F.col("kind") == "boost", F.col("kind") == "downrank"
    effect = F.when(up, 1 + 0.15 * strength).when(down, 1 / (1 + strength))
    per_set = rules.where("kind in ('boost', 'downrank', 'important')").groupBy("domain", "goggle_id").agg(
        F.product(F.coalesce(effect, F.lit(1.0))).alias("m"),
        F.max(F.when(up, effect)).alias("up"), F.max(F.when(down, effect)).alias("down"),
        F.max(F.when(F.col("kind") == "important", F.col("goggle_id"))).alias("important"),
    )
    per_domain = per_set.groupBy("domain").agg(
        F.product("m").alias("_m"),
        F.min_by(F.coalesce("up", "down"), "important").alias("_own"),
        F.min("important").isNotNull().alias("_important"),
        F.max("up").isNotNull().alias("_boosted"),
    )
    paths = rules.where("kind = 'path'").agg(F.collect_list(F.struct("pattern", "weight")).alias("_paths"))  # the path rules of a query
    default = rules.agg(F.coalesce(F.max((F.col("kind") == "discard_default").cast("int")), F.lit(0)).alias("_default"))
    out = rows.join(_few(per_domain.withColumnRenamed("domain", "_dom")), F.col("_d") == F.col("_dom"), "left").crossJoin(F.broadcast(paths)).crossJoin(F.broadcast(default))  # one row each
    hit = F.filter("_paths", lambda p: urls.path_matches(urls.strip_noise(F.col("url")), p["pattern"]))
    by_path = F.aggregate(hit, F.lit(1.0), lambda a, p: a * (1 + 0.15 * F.least(p["weight"], F.lit(3.0))))
    out = out.where((F.col("_default") == 0) | F.coalesce("_boosted", F.lit(False)) | (F.size(hit) > 0))
    ruled = F.when(F.coalesce("_important", F.lit(False)), F.coalesce("_own", "boost")).otherwise(F.col("boost") * F.coalesce("_m", F.lit(1.0)))
    return out.withColumn("boost", ruled * by_path).select(*[c for c in rows.columns if c != "_d"])


def rescore_prefix(rows: DataFrame, factor_column: Column, cutoff: int, score: str = "score", tie: str = "url") -> DataFrame:
    """Only the first cutoff rows are rescored and re-sorted; the rows behind keep their place. Adds place (from 1)."""
    first = Window.orderBy(F.col(score).desc(), tie)
    ranked = rows.withColumn("_n", F.row_number().over(first)) if "place" not in rows.columns else rows.withColumnRenamed("place", "_n")
    head = F.col("_n") <= cutoff
    ranked = ranked.withColumn(score, F.when(head, F.round(F.col(score) * factor_column, 9)).otherwise(F.col(score)))
    again = Window.orderBy((~head).cast("int"), F.when(head, F.col(score)).desc(), F.when(head, F.col(tie)), "_n")
    return ranked.withColumn("place", F.row_number().over(again)).drop("_n")


def placed(rows: DataFrame, score: str = "score", tie: str = "url", buckets: int = 64) -> DataFrame:
    """rows with place (from 1) by score, then tie, over a whole table: ranks within ranges of the score, plus the sizes of the ranges before.

    The result is saved in the shared folder, so that it can be used more than once.
    """
    checkpoints(rows.sparkSession)
    parts = rows.repartitionByRange(buckets, F.col(score).desc(), F.col(tie)).withColumn("_p", F.spark_partition_id()).checkpoint()
    before = parts.groupBy("_p").agg(F.count("*").alias("_k")).select(F.col("_p").alias("_q"), F.coalesce(F.sum("_k").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(F.col(score).desc(), tie))
    # a row a range
    return parts.join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn("place", (own + F.col("_before")).cast("int")).drop("_p", "_q", "_before").checkpoint()


def rescore_table(rows: DataFrame, factor_column: Column, cutoff: int, score: str = "score", tie: str = "url") -> DataFrame:
    """As rescore_prefix(), for a whole table: only the first cutoff rows meet in a window."""
    ranked = placed(rows, score, tie)
    head = ranked.where(F.col("place") <= cutoff).withColumn(score, F.round(F.col(score) * factor_column, 9))
    head = head.withColumn("place", F.row_number().over(Window.orderBy(F.col(score).desc(), tie)))
    return head.unionByName(ranked.where(F.col("place") > cutoff))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def overlap_logit(query: str, passage: Column) -> Column:
    """The default reranker: share of query words in the passage, as a logit. Any column can take its place."""
    words = sorted({w for w in query.lower().split() if w})
    hits = sum((F.contains(F.lower(passage), F.lit(w)).cast("int") for w in words), F.lit(0))
    return F.lit(4.0) * hits / F.lit(float(max(1, len(words)))) - F.lit(2.0)


def domain_cap(rows: DataFrame, most: int = 5, order: str = "place") -> DataFrame:
    """At most so many rows per domain, in place order."""
    w = Window.partitionBy("_d").orderBy(order)
    return rows.withColumn("_d", urls.domain(F.col("url"))).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_d", "_k")
