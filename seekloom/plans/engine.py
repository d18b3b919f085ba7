"""The search facade: one lazy plan from query text to the final page of results.

Query understanding happens on the driver and yields literals; the engines'
hits are ranked on narrow columns, fused, filtered, boosted and capped.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekloom.functions import urls
from seekloom.operators import fts, fusion, ranking, understanding, vector
from seekloom.operators.cache import ResultCache
from seekloom.session import checkpoints, table
from seekloom.sources.adapters import web_documents

SHOWN, PAGERANK_CUTOFF, RERANK_CUTOFF, PER_DOMAIN = 20, 100, 30, 5
_INTENTS = ("informational", "navigational", "transactional", "commercial", "local", "unknown")


def hashed_words(text: str, dim: int) -> list[float]:
    """The default embedding: words hashed to signed places, scaled to length one; the same everywhere."""
    out = [0.0] * dim
    for word in text.lower().split():
        h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
        out[h % dim] += 1.0 if h >> 63 else -1.0
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


class SearchEngine:
    """Search over a data set directory.

    embed: text to vector; scores: (node, score) of URLs; synonyms, entities: what
    a plain query is expanded with. cache: pages kept by everything that decides them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, embed=None, scores: DataFrame | None = None, synonyms: dict[str, list[str]] | None = None, lexicon: dict[str, str] | None = None, weights: dict[str, float] = ranking.W):
        self.spark, self.docs, self.vectors = spark, web_documents(spark, sf_dir), table(spark, sf_dir, "embeddings")
        self.embed = embed or (lambda text: hashed_words(text, self._dim()))
        self.scores, self.synonyms, self.lexicon, self.weights = scores, synonyms, lexicon or {}, weights
        self.cache = ResultCache()

    def _dim(self) -> int:
        row = self.vectors.where("embedding is not null").select(F.size("embedding")).first()
        return row[0] if row else 0

    def _intent(self, text: str) -> int:
        return _INTENTS.index(self.spark.range(1).select(understanding.intent(F.lit(text))).first()[0])

    def _text_hits(self, plain: str, must) -> DataFrame:
        found = understanding.entities(plain, self.lexicon)
        return fts.top(fts.search(self.docs, understanding.expand(plain, self.synonyms, found), where=must)).withColumn("engine", F.lit("FTS"))

    def _vector_hits(self, text: str) -> DataFrame:
        asked = self.embed(text)
        checkpoints(self.spark)
        centers = vector.centroids(self.vectors).checkpoint()  # a model: counted, probed and assigned with
        chosen = [r.bucket_id for r in vector.probes(centers, asked).collect()]  # a few probe ids
        near = vector.search(vector.assign(self.vectors, centers), chosen, asked)
        return near.select(F.col("vec_id").alias("doc_id"), "score", F.lit("IVF").alias("engine"))

    def _direct_hits(self, plain: str, sites: list[str]) -> DataFrame:
        """Documents under an address that the query, or a site: of it, may name."""
        names = [urls.site_forms(F.lit(s)) for s in sites] + ([F.transform(urls.direct_candidates(F.lit(plain.lower())), lambda c: c["url"])] if plain and len(plain.split()) == 1 else [])
        asked = self.spark.range(1).select(F.explode(F.concat(*names)).alias("_u")).distinct()  # some eighteen addresses
        return self.docs.join(F.broadcast(asked), F.col("url") == F.col("_u"), "left_semi").select("doc_id", F.lit(0.8).alias("score"), F.lit("DIR").alias("engine"))

    def search(self, text: str, lang: str = "", loc: str = "", intent: int | None = None, rules: DataFrame | None = None, blocked: tuple[str, ...] = (), peers: DataFrame | None = None, discovered: DataFrame | None = None, mobile: bool = False) -> DataFrame:
        """The page of results. peers and discovered: (doc_id, score) hits of other engines."""
        plain, sites = understanding.sites(text)
        intent = self._intent(plain) if intent is None else intent
        plain = understanding.rewrite_dates(plain).replace("intitle:", "title:").replace(" | ", " OR ")
        run_text, run_vectors = fusion.gates(plain)
        docs = self.docs
        must = None
        if sites:
            names = [s.removeprefix("www.") for s in sites]
            host = urls.domain(F.col("url"), remove_www=False)
            must = host.isin([p + n for n in names for p in ("", "www.", "en.", "m.")])
        if intent == ranking.LOCAL and loc not in ("", "all"):
            must = (F.col("loc") == loc) if must is None else must & (F.col("loc") == loc)
        hits = docs.select("doc_id", F.lit(0.0).alias("score"), F.lit("FTS").alias("engine")).limit(0)
        if run_text and plain:
            hits = hits.unionByName(self._text_hits(plain, must))
        if run_vectors and plain:
            local = intent == ranking.LOCAL or (len(plain.split()) <= 2 and loc)
            hits = hits.unionByName(self._vector_hits(f"{plain} {loc}" if local else plain))
        if sites or len(plain.split()) == 1:
            hits = hits.unionByName(self._direct_hits(plain, sites))
        for name, more in (("DIS", discovered), ("DEC", peers)):
            if more is not None:
                hits = hits.unionByName(more.select("doc_id", F.col("score").cast("double").alias("score"), F.lit(name).alias("engine")))
        # the engines' hits fetch their wide rows; adaptive execution picks the join by their size
        wide = docs.join(hits.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id")).drop("_id")
        fused = fusion.fuse(wide.drop("source"), fusion.query_weights(plain), lang, intent)
        fused = fusion.site_filter(fusion.drop_http_twins(fused), sites)
        if blocked:
            fused = fused.where(~understanding.blocked(F.concat_ws(" ", "title", "url", "content"), blocked))
        boosted = fused.withColumn("boost", ranking.hand_boost(plain, lang, loc, intent, self.weights))
        if rules is not None:
            boosted = ranking.apply_rules(boosted, rules)
        scored = boosted.withColumn("score", F.round(F.col("search_score") * F.col("boost") * ranking.usability_factor(intent, mobile, self.weights), 9))
        if self.scores is not None:
            scored = scored.join(self.scores.select(F.col("node").alias("_u"), F.col("score").alias("_pr")), F.col("url") == F.col("_u"), "left").withColumn("_pr", F.coalesce("_pr", F.lit(0.0)))
            placed = ranking.rescore_prefix(scored, 1 + F.col("_pr"), PAGERANK_CUTOFF)
        else:
            placed = ranking.rescore_prefix(scored, F.lit(1.0), PAGERANK_CUTOFF)
        placed = ranking.rescore_prefix(placed, ranking.sigmoid(ranking.overlap_logit(plain, F.col("title"))), RERANK_CUTOFF)
        capped = placed if "site:" in text else ranking.domain_cap(placed, PER_DOMAIN)
        return capped.orderBy("place").limit(SHOWN).select("place", "doc_id", "url", "title", "score", F.col("source").alias("engines"))

    def page(self, text: str, lang: str = "", loc: str = "", rules_key: tuple = (), **more) -> list:
        """The rows of search(), kept in the cache; rules_key names the rule sets and whatever else more depends on."""
        return self.cache.page((text, lang, loc, rules_key), lambda: self.search(text, lang, loc, **more).collect())  # a page of rows
