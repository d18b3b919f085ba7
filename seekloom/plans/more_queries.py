"""Registered queries of peers' filters, spelling, entities, languages, charts, rule-set storage and small parsers, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekloom.functions import language
from seekloom.operators import analytics, bloom, crawl, geo, ingest, rules, understanding, updates
from seekloom.session import table
from seekloom.sources.adapters import VISITS_SQL, query_log, visits, web_documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# -------------------------------------------------------------------- peers

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"
_BITS = "(SELECT conv_id, (('0x' || substr(md5(term), 1, 9))::BIGINT >> (12 * k)) & 4095 AS bit FROM held, (VALUES (0), (1), (2)) AS s(k))"
#: Conversations stand for peers, their words for the peers' keywords.
_PEERS = f"""WITH held AS (SELECT DISTINCT conv_id, unnest({_WORDS}) AS term FROM conversations),
asked AS (SELECT DISTINCT unnest({_WORDS}) AS term FROM benchmark), bits AS (SELECT DISTINCT conv_id, bit FROM {_BITS})"""


def _words(rows, *keys):
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    return rows.select(*keys, F.explode(found).alias("term"))


def _filters(spark, sf):
    return bloom.build(_words(table(spark, sf, "conversations"), "conv_id"), "conv_id")


@query("peer_bloom_fill", _PEERS + " SELECT conv_id, round(count(*) / 4096.0::DOUBLE, 6) AS fill FROM bits GROUP BY conv_id")
def peer_bloom_fill(spark, sf):
    return _filters(spark, sf).select("conv_id", F.round(bloom.fill(F.col("filter")), 6).alias("fill"))


@query("qu_bloom_peers", _PEERS + """, probes AS (SELECT term, (('0x' || substr(md5(term), 1, 9))::BIGINT >> (12 * k)) & 4095 AS bit, k FROM asked, (VALUES (0), (1), (2)) AS s(k)),
hit AS (SELECT conv_id, term FROM probes JOIN bits USING (bit) GROUP BY conv_id, term HAVING count(DISTINCT k) = 3) SELECT conv_id, count(*)::BIGINT AS hits FROM hit GROUP BY conv_id ORDER BY hits DESC, conv_id LIMIT 4""")
def qu_bloom_peers(spark, sf):
    return bloom.best_peers(_filters(spark, sf), _words(table(spark, sf, "benchmark")), "conv_id")


@query("peer_summary", _PEERS + ", f AS (SELECT conv_id, count(*) / 4096.0::DOUBLE AS fill FROM bits GROUP BY conv_id) SELECT (SELECT count(DISTINCT label) FROM embeddings)::BIGINT AS centroids, round(avg(fill), 6) AS mean_fill FROM f")
def peer_summary(spark, sf):
    centroids = table(spark, sf, "embeddings").select((F.col("vec_id") % 5).alias("key"), F.col("label").alias("centroid_id"))
    return bloom.peer_summary(centroids, _filters(spark, sf))


# ------------------------------------------------------ query understanding

_DICT = "WITH x AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}')) AS term FROM documents), d AS (SELECT term, count(*) AS cnt FROM x GROUP BY term HAVING count(*) >= 50)"
_PREFIX = "(SELECT coalesce(max(i), 0) FROM (SELECT unnest(range(1, least(length(word), length(term)) + 1)) AS i) WHERE substr(word, 1, i::INTEGER) = substr(term, 1, i::INTEGER))"


def _dictionary(spark, sf, least=50):
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


#: Asked words: each dictionary word with its second and third letters exchanged and its last one gone.
_ASKED = "w AS (SELECT DISTINCT substr(term, 1, 1) || substr(term, 3, 1) || substr(term, 2, 1) || substr(term, 4, greatest(0, length(term) - 4)) AS word FROM d)"


@query("qu_spell_distance2", _DICT + ", " + _ASKED + f""", p AS (SELECT word, term, cnt, damerau_levenshtein(word, term) AS distance FROM w JOIN d ON abs(length(word) - length(term)) <= 2 AND damerau_levenshtein(word, term) <= CASE WHEN length(word) <= 4 THEN 1 ELSE 2 END),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, {_PREFIX} DESC, cnt DESC, term) AS k FROM p) SELECT word, term, distance::INTEGER AS distance FROM r WHERE k = 1""")
def qu_spell_distance2(spark, sf):
    d = _dictionary(spark, sf)
    asked = d.select(F.concat(F.substring("term", 1, 1), F.substring("term", 3, 1), F.substring("term", 2, 1), F.substring(F.col("term"), F.lit(4), F.greatest(F.lit(0), F.length("term") - 4))).alias("word")).distinct()
    return understanding.spell_candidates(asked, d, 2)


_LEXICON = (("of the", "PHRASE"), ("the", "WORD"), ("de la", "PHRASE"), ("der", "WORD"), ("and the of", "NAME"))


def _lexicon(spark):
    return spark.createDataFrame(_LEXICON, "entry string, kind string")


@query("qu_entity_hits", r"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents), l AS (SELECT * FROM (VALUES """ + ", ".join(f"('{e}', '{k}', {len(e.split())})" for e, k in _LEXICON) + r""") AS l(entry, kind, size)),
h AS (SELECT id, i - 1 AS place, entry, kind, size, row_number() OVER (PARTITION BY id, i ORDER BY size DESC) AS r FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w), l WHERE array_to_string(w[i:i + size - 1], ' ') = entry),
b AS (SELECT * FROM h WHERE r = 1), c AS (SELECT b.*, NOT EXISTS (SELECT 1 FROM b x WHERE x.id = b.id AND x.place < b.place AND x.place + x.size > b.place) AS free FROM b)
SELECT id, kind, count(*)::BIGINT AS n FROM c WHERE free GROUP BY id, kind""")
def qu_entity_hits(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return understanding.entity_hits(texts, _lexicon(spark), strict=True).groupBy("id", "kind").agg(F.count("*").alias("n"))


@query("qu_spell_corrected")
def qu_spell_corrected(spark, sf):
    asked = query_log(spark, sf).select(F.col("query_id").alias("id"), "text")
    return understanding.corrected(asked, _dictionary(spark, sf), _lexicon(spark))


_LOG = "WITH q AS (SELECT conv_id * 1000 + turn AS query_id, coalesce(text, '') AS t FROM conversations WHERE role = 'user')"


@query("qu_contextual", _LOG + r" SELECT query_id, CASE WHEN query_id % 3 = 0 OR len(list_filter(regexp_split_to_array(trim(t), '\s+'), lambda x: x <> '')) <= 2 THEN t || ' us' ELSE t END AS q FROM q")
def qu_contextual(spark, sf):
    intent = F.when(F.col("query_id") % 3 == 0, "local").otherwise("unknown")
    return query_log(spark, sf).select("query_id", understanding.contextual(F.col("text"), intent, F.lit("us")).alias("q"))


@query("qu_bang_table", "SELECT * FROM (VALUES ('g', 'g.example', 'https://g.example/?q={{{s}}}'), ('w', 'w2.example', 'https://w2.example/{{{s}}}')) AS t(bang, domain, template)")
def qu_bang_table(spark, sf):
    literal = 'window.b=[{c:"x",d:"g.example",t:"g",u:"https://g.example/?q={{{s}}}"},{d:"w.example",t:"w",u:"https://w.example/{{{s}}}"},{d:"none.example",t:"n"},{d:"w2.example",t:"w",u:"https://w2.example/{{{s}}}"}]'
    return understanding.bang_table(spark.createDataFrame([(literal,)], "value string"))


@query("qu_currency_converted", "SELECT o_orderkey, round((o_orderkey % 100)::DOUBLE / 0.9::DOUBLE * CASE o_custkey % 2 WHEN 0 THEN 25.0 ELSE 160.0 END::DOUBLE, 2) AS amount FROM orders")
def qu_currency_converted(spark, sf):
    text = F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit(" EUR to "), F.when(F.col("o_custkey") % 2 == 0, "czk").otherwise("yen"))
    rates = spark.createDataFrame([("USD", 1.0), ("EUR", 0.9), ("CZK", 25.0), ("JPY", 160.0)], "code string, rate double")
    return table(spark, sf, "orders").select("o_orderkey", understanding.converted(understanding.currency(text), rates).alias("amount"))


_LISTS = {k: "[" + ", ".join(f"'{w}'" for w in v.split()) + "]" for k, v in sorted(language.FUNCTION_WORDS.items())}


@query("lang_detect", r"WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS w FROM documents), s AS (SELECT doc_id, t, list_sort([" + ", ".join(f"{{'s': -len(list_filter(w, lambda x: list_contains({v}, x))), 'code': '{k}'}}" for k, v in _LISTS.items()) + r"])[1] AS b FROM w) SELECT doc_id, CASE WHEN NOT regexp_matches(t, '\p{L}') THEN '' WHEN b.s <= -2 THEN b.code ELSE '' END AS detected FROM s")
def lang_detect(spark, sf):
    return table(spark, sf, "documents").select("doc_id", language.detect(F.coalesce("text", F.lit(""))).alias("detected"))


# -------------------------------------------------------------- small parts


@query("idx_segment_sizes", "SELECT source AS segment, count(*)::BIGINT AS live FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source")
def idx_segment_sizes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("segment"))
    return analytics.index_size(d, table(spark, sf, "labels").where("toxic = 1"))


@query("ana_flush_increments", f"WITH {VISITS_SQL} SELECT day, stage, count(*)::BIGINT AS n FROM v GROUP BY day, stage")
def ana_flush_increments(spark, sf):
    v = visits(spark, sf)
    counters = analytics.daily_counts(v.where("event_id % 3 = 0"))
    for k in (1, 2):
        counters = analytics.flushed(counters, v.where(F.col("event_id") % 3 == k).select("day", "stage", F.lit(1).cast("long").alias("n")), "day", "stage")
    return counters


@query("ana_ratio", f"WITH {VISITS_SQL} SELECT stage, CASE WHEN sum((visitor % 2)::BIGINT) > 0 THEN printf('%.1f', 100.0 * sum((visitor % 2 * (event_id % 2))::BIGINT) / sum((visitor % 2)::BIGINT)) || '%' ELSE '-' END AS share FROM v GROUP BY stage UNION ALL SELECT 'none', '-'")
def ana_ratio(spark, sf):
    v = visits(spark, sf)
    sums = v.groupBy("stage").agg(F.sum(F.col("visitor") % 2 * (F.col("event_id") % 2)).alias("a"), F.sum(F.col("visitor") % 2).alias("b"))
    sums = sums.unionByName(spark.createDataFrame([("none", 0, 0)], "stage string, a long, b long"))
    return sums.select("stage", analytics.ratio(F.col("a"), F.col("b")).alias("share"))


_SERIES = f"WITH {VISITS_SQL}, c AS (SELECT stage, day, count(*) AS n FROM v GROUP BY stage, day), s AS (SELECT stage, list(n::DOUBLE ORDER BY day) AS r FROM c GROUP BY stage)"


@query("ana_sparkline", _SERIES + ", p AS (SELECT stage, r, unnest(r) AS x, generate_subscripts(r, 1) - 1 AS i FROM s) SELECT stage, CASE WHEN len(any_value(r)) < 2 OR list_max(any_value(r)) <= list_min(any_value(r)) THEN 'M 0,20 L 120,20' ELSE string_agg(CASE WHEN i = 0 THEN 'M ' ELSE 'L ' END || printf('%.1f', i * (120.0::DOUBLE / (len(r) - 1))) || ',' || printf('%.1f', 40.0::DOUBLE - ((x - list_min(r)) / (list_max(r) - list_min(r)) * 30.0::DOUBLE + 5.0::DOUBLE)), ' ' ORDER BY i) END AS path FROM p GROUP BY stage")
def ana_sparkline(spark, sf):
    c = analytics.daily_counts(visits(spark, sf))
    series = c.groupBy("stage").agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "n"))), lambda x: x["n"].cast("double")).alias("r"))  # a number a day
    return series.select("stage", analytics.sparkline(F.col("r"), 120, 40).alias("path"))


@query("ana_bars", _SERIES + ", p AS (SELECT stage, r, unnest(r) AS x, generate_subscripts(r, 1) - 1 AS i FROM s) SELECT stage, i::INTEGER AS place, printf('%.2f', i * (300.0::DOUBLE / len(r)) + 300.0::DOUBLE / len(r) * 0.15::DOUBLE) AS x, printf('%.2f', greatest(x / list_max(r) * 96.0::DOUBLE, CASE WHEN x > 0 THEN 2.0 ELSE 0.6 END)) AS h, i + 1 = len(r) AS last FROM p")
def ana_bars(spark, sf):
    c = analytics.daily_counts(visits(spark, sf))
    series = c.groupBy("stage").agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "n"))), lambda x: x["n"]).alias("r"))  # a number a day
    return series.select("stage", F.posexplode(analytics.bars(F.col("r"))).alias("place", "b")).select("stage", "place", "b.x", "b.h", "b.last")


@query("ana_series_summary", _SERIES + " SELECT stage, r[1] AS first, r[-1] AS last, list_min(r) AS low, list_max(r) AS high, round((r[-1] - r[1]) * 100.0::DOUBLE / r[1], 2) AS change FROM s")
def ana_series_summary(spark, sf):
    c = analytics.daily_counts(visits(spark, sf)).withColumn("n", F.col("n").cast("double"))
    return analytics.series_summary(c, "stage", "day", "n")


@query("geo_country_names", "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'France' WHEN 1 THEN 'Canada' WHEN 2 THEN 'Russia' WHEN 3 THEN 'Jordan' ELSE 'xx' END AS country_name, CASE n_nationkey % 5 WHEN 0 THEN chr(127467) || chr(127479) WHEN 1 THEN chr(127464) || chr(127462) WHEN 2 THEN chr(127479) || chr(127482) WHEN 3 THEN chr(127471) || chr(127476) ELSE '' END AS flag FROM nation")
def geo_country_names(spark, sf):
    code = F.element_at(F.array(*[F.lit(x) for x in ("fr", "ca", "ru", "jo", "xx")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return geo.named(table(spark, sf, "nation").select("n_nationkey", code.alias("country")), geo.countries(spark)).select("n_nationkey", "country_name", "flag")


@query("rule_sets_stored", "SELECT c_custkey AS goggle_id, c_custkey % 2 = 0 AS public, CASE WHEN c_custkey = 4 THEN 99 ELSE 1 END::BIGINT AS fetched_at FROM customer WHERE c_custkey <> 6 AND (c_custkey % 2 = 0 OR c_nationkey = 3)")
def rule_sets_stored(spark, sf):
    sets = table(spark, sf, "customer").select(F.col("c_custkey").alias("goggle_id"), F.col("c_nationkey").cast("string").alias("owner"), (F.col("c_custkey") % 2 == 0).alias("public"), F.lit(1).cast("long").alias("fetched_at"))
    return rules.visible(rules.touch(rules.delete(sets, 6), 4, F.lit(99).cast("long")), "3").drop("owner")


@query("crawl_image_results", "SELECT p_partkey, 'https://img.example/' || p_partkey AS site_url, 'img.example' AS site_domain, CASE WHEN p_partkey % 2 = 0 THEN 't' || p_partkey ELSE '' END AS thumbnail, p_brand AS title FROM part WHERE p_partkey % 3 <> 0")
def crawl_image_results(spark, sf):
    k = F.col("p_partkey")
    thumb = F.when(k % 2 == 0, F.struct(F.concat(F.lit("t"), k.cast("string")).alias("src")))
    item = F.struct(F.when(k % 3 != 0, F.concat(F.lit("https://img.example/"), k.cast("string"))).alias("url"), F.col("p_brand").alias("title"), thumb.alias("thumbnail"))
    answers = table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(F.array(item).alias("results"))).alias("json"))
    return crawl.image_results(answers).select("p_partkey", "site_url", "site_domain", "thumbnail", "title")


@query("upd_next_batch", "SELECT doc_id FROM documents WHERE doc_id > 40 ORDER BY doc_id LIMIT 25")
def upd_next_batch(spark, sf):
    done = spark.createDataFrame([("u", 0, 20), ("u", 15, 40), ("v", 0, 5)], "update_id string, start long, end long")
    progress = updates.first_unprocessed(done, spark.createDataFrame([("u", 10**12), ("v", 3)], "update_id string, ceiling long"))
    return updates.next_batch(table(spark, sf, "documents"), progress, "u", 25).select("doc_id")


@query("idx_quota", "SELECT sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes, sum(octet_length(encode(coalesce(text, '')))) <= 0.000001::DOUBLE * 1073741824 AS within FROM documents")
def idx_quota(spark, sf):
    sizes = table(spark, sf, "documents").select(F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return sizes.agg(F.sum("bytes").alias("bytes")).withColumn("within", F.lit(ingest.within_quota(sizes, 0.000001)))


@query("rank_labels", "SELECT doc_id % 6 AS intent, CASE doc_id % 6 WHEN 0 THEN 'informational' WHEN 1 THEN 'navigational' WHEN 2 THEN 'transactional' WHEN 3 THEN 'commercial' WHEN 4 THEN 'local' ELSE '' END AS label, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def rank_labels(spark, sf):
    from seekloom.functions.text import intent_label

    d = web_documents(spark, sf)
    return d.select(F.col("intent").cast("long").alias("intent"), intent_label(F.col("intent")).alias("label")).groupBy("intent", "label").agg(F.count("*").alias("n"))
