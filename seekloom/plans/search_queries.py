"""Registered queries of retrieval, vectors, fusion and ranking, with their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seekloom.functions.text import breadcrumb, load_label, reading_level, terms
from seekloom.functions.urls import domain, path_matches
from seekloom.functions.vectors import dot, l2_normalize
from seekloom.operators import fts, fusion, ranking, vector
from seekloom.plans import engine
from seekloom.session import table
from seekloom.sources.adapters import DOCS_SQL, web_documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---------------------------------------------------------------- full text

_TOKENS = DOCS_SQL + r""",
fields AS (SELECT doc_id, 'title' AS field, title AS t FROM docs UNION ALL SELECT doc_id, 'content', content FROM docs),
listed AS (SELECT doc_id, field, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS ts FROM fields),
lens AS (SELECT doc_id, field, len(ts)::DOUBLE AS len FROM listed),
avgs AS (SELECT field, sum(len) / (SELECT count(*) FROM docs) AS avg FROM lens GROUP BY field),
nd AS (SELECT count(*)::DOUBLE AS n FROM docs)"""


def _leaf_sql(name: str, words: str, fields=("title", "content")) -> str:
    """CTE of one leaf: (doc_id, s) with s its BM25 sum over the fields. words: one term, or a phrase's words by spaces."""
    w = words.split()
    if len(w) == 1:
        count = f"len(list_filter(ts, lambda x: x = '{w[0]}'))"
    else:
        tests = " AND ".join(f"ts[i + {k}] = '{x}'" for k, x in enumerate(w))
        count = f"len(list_filter(range(1, len(ts) + 1), lambda i: {tests}))"
    chosen = ", ".join(f"'{f}'" for f in fields)
    return f""",
{name}_tf AS (SELECT doc_id, field, tf FROM (SELECT doc_id, field, {count}::DOUBLE AS tf FROM listed WHERE field IN ({chosen})) WHERE tf > 0),
{name}_df AS (SELECT field, count(*)::DOUBLE AS df FROM {name}_tf GROUP BY field),
{name} AS (
  SELECT t.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / avg))) AS s
  FROM {name}_tf t JOIN {name}_df USING (field) JOIN lens l ON l.doc_id = t.doc_id AND l.field = t.field JOIN avgs a ON a.field = t.field, nd GROUP BY t.doc_id
)"""


def _sql(leaves: dict[str, str], body: str, fields: dict | None = None) -> str:
    return "WITH " + _TOKENS + "".join(_leaf_sql(k, v, (fields or {}).get(k, ("title", "content"))) for k, v in leaves.items()) + "\n" + body


@query("fts_term_df", "WITH " + _TOKENS + " , x AS (SELECT doc_id, unnest(ts) AS term FROM listed WHERE field = 'content') SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS tf FROM x GROUP BY term")
def fts_term_df(spark, sf):
    words = web_documents(spark, sf).select("doc_id", F.explode(terms(F.col("content"))).alias("term"))
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


@query("fts_postings_stats", "WITH " + _TOKENS + " SELECT field, doc_id, len(ts)::BIGINT AS len, len(list_distinct(ts))::BIGINT AS distinct_terms FROM listed WHERE len(ts) > 0")
def fts_postings_stats(spark, sf):
    p = fts.postings(web_documents(spark, sf))
    return p.groupBy("field", "doc_id").agg(F.sum("tf").alias("len"), F.count("*").alias("distinct_terms"))


_TOP = " ORDER BY score DESC, doc_id LIMIT 160"


@query("fts_bm25_topk", _sql({"a": "with", "b": "from", "c": "when"}, "SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY doc_id" + _TOP))
def fts_bm25_topk(spark, sf):
    return fts.top(fts.search(web_documents(spark, sf), "with OR from OR when"))


@query("fts_bm25_and", _sql({"a": "with", "b": "from"}, "SELECT doc_id, round(a.s + b.s, 6) AS score FROM a JOIN b USING (doc_id)" + _TOP))
def fts_bm25_and(spark, sf):
    return fts.top(fts.search(web_documents(spark, sf), "with from"))


@query("fts_or_boost", _sql({"a": "with", "b": "from"}, "SELECT doc_id, round(coalesce(a.s, 0) * 2 + coalesce(b.s, 0) * 0.5, 6) AS score FROM a FULL JOIN b USING (doc_id)" + _TOP))
def fts_or_boost(spark, sf):
    return fts.top(fts.search(web_documents(spark, sf), "with^2.0 OR from^0.5"))


@query("fts_not", _sql({"a": "with", "b": "from"}, "SELECT doc_id, round(s, 6) AS score FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)"))
def fts_not(spark, sf):
    return fts.search(web_documents(spark, sf), "with -from")


@query("fts_phrase", _sql({"a": "of the"}, "SELECT doc_id, round(s, 6) AS score FROM a" + _TOP))
def fts_phrase(spark, sf):
    return fts.top(fts.search(web_documents(spark, sf), '"of the"'))


@query("fts_field_filter", _sql({"a": "the"}, "SELECT doc_id, round(s, 6) AS score FROM a", {"a": ("title",)}))
def fts_field_filter(spark, sf):
    return fts.search(web_documents(spark, sf), "title:the")


@query("fts_date_range", _sql({"a": "with"}, "SELECT doc_id, round(s, 6) AS score FROM a JOIN docs USING (doc_id) WHERE date > 240301 AND date < 240915"))
def fts_date_range(spark, sf):
    return fts.search(web_documents(spark, sf), "with date:{240301 TO 240915}")


@query("fts_locality_filter", _sql({"a": "de"}, "SELECT doc_id, round(s, 6) AS score FROM a JOIN docs USING (doc_id) WHERE loc = 'es'" + _TOP))
def fts_locality_filter(spark, sf):
    return fts.top(fts.search(web_documents(spark, sf), "de", where=F.col("loc") == "es"))


@query("fts_site_must", _sql({"a": "with"}, "SELECT doc_id, round(s, 6) AS score FROM a JOIN docs USING (doc_id) WHERE source IN ('src1', 'src2')"))
def fts_site_must(spark, sf):
    return fts.search(web_documents(spark, sf), "with", where=domain(F.col("url")).isin("src1.example.com", "src2.example.com"))


@query("fts_nested_groups", _sql({"a": "with", "b": "from", "c": "when"}, "SELECT doc_id, round(coalesce(a.s, 0) + coalesce(b.s, 0), 6) AS score FROM a FULL JOIN b USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM c)" + _TOP))
def fts_nested_groups(spark, sf):
    return fts.top(fts.search(web_documents(spark, sf), "(with OR from) AND NOT when"))


@query("fts_index_update", "WITH " + _TOKENS + """, keep AS (SELECT doc_id FROM listed WHERE field = 'content' AND NOT list_contains(ts, 'with')),
now AS (SELECT doc_id, field, ts FROM listed WHERE doc_id IN (SELECT doc_id FROM keep) AND doc_id NOT IN (SELECT doc_id FROM docs WHERE lang = 'de') UNION ALL SELECT doc_id, 'title', ['new', 'title'] FROM docs WHERE lang = 'de' UNION ALL SELECT doc_id, 'content', ts FROM listed WHERE field = 'content' AND doc_id IN (SELECT doc_id FROM docs WHERE lang = 'de'))
SELECT field, count(DISTINCT doc_id)::BIGINT AS docs, sum(len(ts))::BIGINT AS words FROM now WHERE len(ts) > 0 GROUP BY field""")
def fts_index_update(spark, sf):
    d = web_documents(spark, sf)
    index = fts.delete_by_term(fts.postings(d), "content", "with")
    index = fts.add(index, d.where("lang = 'de'").withColumn("title", F.lit("new title")))
    return index.groupBy("field", "doc_id").agg(F.sum("tf").alias("n")).groupBy("field").agg(F.count("*").alias("docs"), F.sum("n").alias("words"))


@query("fts_index_any", _sql({"a": "with", "b": "from", "c": "when"}, "SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY doc_id"))
def fts_index_any(spark, sf):
    from seekloom.session import shared_folder

    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    d = web_documents(spark, sf)
    fts.commit(fts.postings(d), path)
    size = F.regexp_count(F.lower(F.col("x.t")), F.lit(f"{fts.TOKEN}+")).alias("len")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("t")) for f in fts.FIELDS])).alias("x")
    lengths = d.select("doc_id", each).select("doc_id", "x.field", size)
    return fts.any_of(fts.lookup(spark, path, ["with", "from", "when"]), lengths)


# ------------------------------------------------------------------ vectors

_CENTERS = r"""
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
parts AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
mean AS (SELECT label, i, avg(x) AS x FROM parts GROUP BY label, i),
raw AS (SELECT label AS bucket_id, list(x ORDER BY i) AS m FROM mean GROUP BY label),
c AS (SELECT bucket_id, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS centroid FROM raw)"""
_ASSIGNED = _CENTERS + """,
a AS (SELECT vec_id, e.v, bucket_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_inner_product(list_transform(e.v, lambda x: x / sqrt(list_inner_product(e.v, e.v))), centroid), 9) DESC, bucket_id) AS k FROM e, c),
q AS (SELECT v FROM e WHERE vec_id = 0),
p AS (SELECT bucket_id, round(list_inner_product(centroid, q.v), 6) AS sim FROM c, q ORDER BY sim DESC, bucket_id LIMIT 4)"""


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings")


def _first_vector(spark, sf) -> list[float]:
    return [float(x) for x in _embeddings(spark, sf).where("vec_id = 0").first().embedding]  # the query, one row


@query("vec_l2_normalize", "SELECT vec_id, round(sqrt(list_inner_product(u, u)), 6) AS norm, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings))")
def vec_l2_normalize(spark, sf):
    u = _embeddings(spark, sf).select("vec_id", l2_normalize(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.sqrt(dot(F.col("u"), F.col("u"))), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query("vec_centroids", "WITH " + _CENTERS + " SELECT bucket_id, array_to_string(list_transform(centroid, lambda x: printf('%.5f', round(x, 5) + 0.0)), ' ') AS centroid FROM c")
def vec_centroids(spark, sf):
    c = vector.centroids(_embeddings(spark, sf))
    return c.select("bucket_id", F.array_join(F.transform("centroid", lambda x: F.format_string("%.5f", F.round(x, 5) + 0.0)), " ").alias("centroid"))


@query("vec_assign_argmax", "WITH " + _ASSIGNED + " SELECT vec_id, bucket_id FROM a WHERE k = 1")
def vec_assign_argmax(spark, sf):
    e = _embeddings(spark, sf)
    return vector.assign(e, vector.centroids(e)).select("vec_id", "bucket_id")


@query("vec_probe_topt", "WITH " + _ASSIGNED + " SELECT bucket_id, sim FROM p")
def vec_probe_topt(spark, sf):
    return vector.probes(vector.centroids(_embeddings(spark, sf)), _first_vector(spark, sf))


@query("vec_ivf_search", "WITH " + _ASSIGNED + " SELECT vec_id, max(round(list_inner_product(a.v, q.v), 6)) AS score FROM a, q WHERE k = 1 AND bucket_id IN (SELECT bucket_id FROM p) GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT 200")
def vec_ivf_search(spark, sf):
    e, asked = _embeddings(spark, sf), _first_vector(spark, sf)
    centers = vector.centroids(e)
    chosen = [r.bucket_id for r in vector.probes(centers, asked).collect()]  # a few probe ids
    return vector.search(vector.assign(e, centers), chosen, asked)


@query("vec_brute_force_topk", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT v FROM e WHERE vec_id = 0) SELECT vec_id, round(list_inner_product(e.v, q.v), 6) AS score FROM e, q ORDER BY score DESC, vec_id LIMIT 200")
def vec_brute_force_topk(spark, sf):
    return vector.search(_embeddings(spark, sf), None, _first_vector(spark, sf))


@query("vec_bucket_sizes_top20", "WITH " + _ASSIGNED + " SELECT bucket_id, count(*)::BIGINT AS n FROM a WHERE k = 1 GROUP BY bucket_id ORDER BY n DESC, bucket_id LIMIT 20")
def vec_bucket_sizes_top20(spark, sf):
    e = _embeddings(spark, sf)
    return vector.assign(e, vector.centroids(e)).groupBy("bucket_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "bucket_id").limit(20)


@query("vec_upsert_last_wins", "SELECT vec_id, label FROM (SELECT vec_id, label + 100 AS label FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id, label FROM embeddings WHERE label >= 3)")
def vec_upsert_last_wins(spark, sf):
    e = _embeddings(spark, sf).select("vec_id", "label")
    staged = e.where("label < 3")
    staging = staged.withColumn("offset", F.lit(1)).unionByName(staged.withColumn("label", F.col("label") + 100).withColumn("offset", F.lit(2)))
    return vector.merge_bucket(e, staging)


@query("vec_zero_filter", "SELECT label, count(*)::BIGINT AS n FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY label")
def vec_zero_filter(spark, sf):
    return _embeddings(spark, sf).where(F.exists("embedding", lambda x: x != 0)).groupBy("label").agg(F.count("*").alias("n"))


@query("vec_mean_pool", "SELECT label, i::INTEGER AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i")
def vec_mean_pool(spark, sf):
    parts = _embeddings(spark, sf).select("label", F.posexplode("embedding").alias("i", "x"))
    return parts.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


@query("vec_kmeans")
def vec_kmeans(spark, sf):
    e = _embeddings(spark, sf)
    return vector.assign(e, vector.train_centroids(e, 10)).groupBy("bucket_id").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------- fusion

#: Engine hits over the driver's tables: text lengths and sources stand for scores.
_HITS = DOCS_SQL + r""",
hits AS (
  SELECT 'FTS' AS engine, url, score, lang, intent FROM (SELECT url, length(content)::DOUBLE AS score, lang, intent, doc_id FROM docs ORDER BY score DESC, doc_id LIMIT 160)
  UNION ALL SELECT 'IVF', url, score, lang, intent FROM (SELECT url, score, lang, intent FROM (SELECT vec_id, round(list_inner_product(v, (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) ORDER BY score DESC, vec_id LIMIT 200) JOIN docs ON doc_id = vec_id)
  UNION ALL SELECT 'DIR', url, 0.8::DOUBLE, lang, intent FROM docs WHERE source = 'src1'
  UNION ALL SELECT 'DIS', url, qna, lang, intent FROM docs WHERE source = 'src2'
  UNION ALL SELECT 'DEC', url, load, lang, intent FROM docs WHERE source IN ('src1', 'src3')
),
ord AS (SELECT * FROM (VALUES ('DIR', 1), ('FTS', 2), ('IVF', 3), ('DIS', 4), ('DEC', 5)) AS t(engine, o)),
r AS (SELECT hits.*, o, row_number() OVER (PARTITION BY hits.engine ORDER BY score DESC, url) - 1 AS k FROM hits JOIN ord USING (engine)),
w AS (SELECT r.*, CASE engine WHEN 'DIR' THEN 3.0 WHEN 'FTS' THEN 1.7 WHEN 'IVF' THEN 1.0 WHEN 'DIS' THEN 0.5 ELSE 0.9 END::DOUBLE / (60 + k + 1) AS p FROM r)"""


def _hits(spark, sf):
    d = web_documents(spark, sf)
    cols = ["url", "score", "lang", "intent"]
    text = fts.top(d.withColumn("score", F.length("content").cast("double"))).select(F.lit("FTS").alias("engine"), *cols)
    near = vector.search(_embeddings(spark, sf), None, _first_vector(spark, sf))
    ivf = d.join(F.broadcast(near), d["doc_id"] == near["vec_id"]).select(F.lit("IVF").alias("engine"), *cols)  # at most 200 hits
    other = [("DIR", d.where("source = 'src1'"), F.lit(0.8)), ("DIS", d.where("source = 'src2'"), F.col("qna")), ("DEC", d.where("source in ('src1', 'src3')"), F.col("load"))]
    out = text.unionByName(ivf)
    for engine_name, rows, score in other:
        out = out.unionByName(rows.select(F.lit(engine_name).alias("engine"), "url", score.cast("double").alias("score"), "lang", "intent"))
    return out


_W = {"DIR": 3.0, "FTS": 1.7, "IVF": 1.0, "DIS": 0.5, "DEC": 0.9}
_FUSED = "SELECT url, round(sum({p}), 9) AS search_score, array_to_string(list(DISTINCT engine ORDER BY CASE engine WHEN 'DIR' THEN 1 WHEN 'FTS' THEN 2 WHEN 'IVF' THEN 3 WHEN 'DIS' THEN 4 ELSE 5 END), ',') AS source, arg_min(lang, o * 1000000 + k) AS lang, arg_min(intent, o * 1000000 + k) AS intent FROM w GROUP BY url"


@query("fuse_rrf_scores", "WITH " + _HITS + " SELECT engine, url, k::INTEGER AS rank, round(p, 9) AS part FROM w")
def fuse_rrf_scores(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("engine").orderBy(F.col("score").desc(), "url")
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in _W.items() for x in kv]), F.col("engine"))
    h = _hits(spark, sf).withColumn("rank", F.row_number().over(w) - 1)
    return h.select("engine", "url", "rank", F.round(weight / (60 + F.col("rank") + 1), 9).alias("part"))


@query("fuse_source_chain", "WITH " + _HITS + " " + _FUSED.format(p="p"))
def fuse_source_chain(spark, sf):
    return fusion.fuse(_hits(spark, sf), _W)


@query("fuse_lang_penalty", "WITH " + _HITS + " " + _FUSED.format(p="p * CASE WHEN engine IN ('FTS', 'IVF') AND lang <> 'en' THEN 0.1::DOUBLE ELSE 1 END * CASE WHEN intent = 0 THEN 1.3::DOUBLE ELSE 1 END"))
def fuse_lang_penalty(spark, sf):
    return fusion.fuse(_hits(spark, sf), _W, lang="en", intent=0)


@query("fuse_adaptive_weights", r"""
WITH q AS (SELECT conv_id * 1000 + turn AS query_id, coalesce(text, '') AS t FROM conversations WHERE role = 'user'),
k AS (SELECT query_id, t, list_filter(regexp_split_to_array(trim(t), '\s+'), lambda x: x <> '') AS w FROM q)
SELECT query_id, round(least(2.0, 1.0 + CASE WHEN len(w) <= 2 THEN 0.7 ELSE 0 END + CASE WHEN contains(t, '"') THEN 0.8 ELSE 0 END + CASE WHEN len(w) > 0 AND len(list_filter(w, lambda x: octet_length(encode(x)) > 7)) > 0.3 * len(w) THEN 0.4 ELSE 0 END)::DOUBLE, 6) AS fts,
       round(least(2.0, 1.0 + CASE WHEN len(w) >= 6 THEN 0.7 ELSE 0 END + CASE WHEN len(list_filter(w, lambda x: lower(x) IN ('what', 'why', 'how', 'when', 'who', 'where', 'which'))) > 0 THEN 0.6 ELSE 0 END)::DOUBLE, 6) AS ivf FROM k""")
def fuse_adaptive_weights(spark, sf):
    from seekloom.sources.adapters import query_log

    return query_log(spark, sf).select("query_id", fusion.adaptive_weights(F.col("text")).alias("w")).select("query_id", "w.fts", "w.ivf")


@query("fuse_site_filter", "WITH " + DOCS_SQL + " SELECT url FROM docs WHERE source IN ('src1', 'src4')")
def fuse_site_filter(spark, sf):
    return fusion.site_filter(web_documents(spark, sf).select("url"), ["https://www.src1.example.com/", "src4.example.com"])


@query("fuse_http_twin", r"""
WITH u AS (SELECT url FROM pages WHERE url IS NOT NULL UNION ALL SELECT regexp_replace(url, '^http://', 'https://') FROM pages WHERE url LIKE 'http://%' AND page_id % 2 = 0)
SELECT url FROM u WHERE url LIKE 'https://%' OR regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '') NOT IN (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '') FROM u WHERE url LIKE 'https://%')""")
def fuse_http_twin(spark, sf):
    p = table(spark, sf, "pages").where("url is not null").select("page_id", "url")
    twins = p.where("url like 'http://%' and page_id % 2 = 0").select(F.regexp_replace("url", "^http://", "https://").alias("url"))
    return fusion.drop_http_twins(p.select("url").unionByName(twins))


@query("fuse_engine_maps", "WITH " + _HITS + " SELECT engine, url, round(CASE engine WHEN 'FTS' THEN score / (score + 40) WHEN 'IVF' THEN greatest(0, least(1, (score - 0.75) / 0.25)) WHEN 'DIR' THEN 0.8 ELSE score END::DOUBLE, 6) AS mapped FROM hits")
def fuse_engine_maps(spark, sf):
    s = F.col("score")
    mapped = F.when(F.col("engine") == "FTS", s / (s + 40)).when(F.col("engine") == "IVF", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s - 0.75) / 0.25))).when(F.col("engine") == "DIR", F.lit(0.8)).otherwise(s)
    return _hits(spark, sf).select("engine", "url", F.round(mapped, 6).alias("mapped"))


# ------------------------------------------------------------------ ranking

_LOAD_SQL = "CASE WHEN load < 0.2 THEN 1.08 WHEN load < 0.3 THEN 1.05 WHEN load < 0.5 THEN 1.02 WHEN load < 1.2 THEN 1.0 WHEN load < 2 THEN 0.9 WHEN load < 3.5 THEN 0.7 WHEN load < 5 THEN 0.4 ELSE 0.1 END::DOUBLE"
_CLEAN = "regexp_replace(url, '[?#].*', '')"
_BODY = f"(CASE WHEN contains({_CLEAN}, '://') THEN string_split({_CLEAN}, '://')[2] ELSE {_CLEAN} END)"
_DEPTH = f"(length({_CLEAN}) - length(replace({_CLEAN}, '/', '')) - 2)"


def _has(text: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def _times(ok: str, x: float) -> str:
    return f"CASE WHEN {ok} THEN {x!r}::DOUBLE ELSE 1 END"


_URL_SQL = (
    f"({_times(_CLEAN + " LIKE 'https://%'", 1.3521680592049155)} * CASE WHEN {_has(_CLEAN, '.dev', '.com')} THEN 1.01::DOUBLE WHEN {_has(_CLEAN, '.org', '.net')} THEN 1.0343461125773576::DOUBLE ELSE 1 END"
    f" * {_times(_has(_BODY, '_', ',,', ':'), 0.99)} * CASE WHEN {_DEPTH} > 0 THEN pow(0.7579354778664352::DOUBLE, {_DEPTH}) ELSE 1 END)"
)


def _hand_sql(query: str, lang: str, loc: str, intent: int, mobile: bool = False) -> str:
    """The boost as SQL over docs, written from the list of factors."""
    rest = f"(CASE WHEN contains({_CLEAN}, '://') THEN string_split({_CLEAN}, '://')[2] ELSE '' END)"
    root = f"string_split(regexp_replace(string_split({rest}, '/')[1], '^www[.]', ''), '.')[1]"
    path = f"regexp_replace(regexp_extract({_CLEAN}, '^[A-Za-z]+://[^/]*/?(.*)$', 1), '/$', '')"
    out = [_URL_SQL, _LOAD_SQL, _times(f"lang = '{lang}'", 1.01), _times(f"contains(lower(title), '{query.lower()}')", 1.3818951856263455), "(1 + greatest(-0.2, least(0.25, qna / 2400)))::DOUBLE"]
    out.append(_times(f"lower(string_split(regexp_replace({rest}, '/+$', ''), '.')[-1]) = '{loc.lower()}'", 1.2))
    out.append(f"CASE WHEN contains({_CLEAN}, '.wikipedia.org/wiki/') AND string_split({rest}, '.')[1] = '{lang}' THEN 1.3905070941466917::DOUBLE WHEN contains({_CLEAN}, '.wikipedia.org/wiki/') THEN 0.1::DOUBLE ELSE 1 END")
    readable = "greatest(0, least(1, readability / 100))::DOUBLE"
    if intent == 1:
        out += [_times(f"lower({root}) = '{query.lower()}'", 4.164), _times(f"({path} = '' OR regexp_matches({path}, '^[A-Za-z-]{{2,7}}$'))", 1.8207127570559796)]
    if intent == 3:
        out += [_times(_has(_CLEAN, "/product/", "/item/", "review"), 1.2), _times(_has(_CLEAN, ".com", ".shop", ".store"), 1.1151867372193276)]
    if intent == 0:
        out += [_times(_has(_CLEAN, ".wikipedia.org"), 1.3623035283335967), _times(_has(_CLEAN, ".org", ".edu", ".gov"), 1.2588360222339798), _times(_has(_CLEAN, ".shop", "/product/"), 0.6423278191323988)]
        words = query.split()
        hard = sum(map(len, words)) > 7 * len(words)
        out.append(f"(1 + ({'1 - ' if hard else ''}{readable}) * 0.001 * 1.4)")
    if intent == 4:
        out.append(_times(f"loc = '{loc}'", 1.242))
    if intent in (2, 3):
        out += ["(1 + greatest(0, least(0.2, qna / 1200)))::DOUBLE", _times("effort > 500", 0.85)]
    if intent in (4, 5):
        out += [f"(1 + {readable} * 0.001 * 10)", "(1 + greatest(0, least(0.5, effort / 1000))::DOUBLE * 0.26516713994470764::DOUBLE)"]
    out.append(f"CASE WHEN has_500_words THEN {1.15 * (1.1 if intent in (0, 3) else 1.0)!r}::DOUBLE ELSE {0.9 if intent == 0 else 1.0}::DOUBLE END")
    if mobile:
        out.append("CASE WHEN is_mobile THEN 1.0 ELSE 1.0 END")
    return "(" + " * ".join(out) + ")"


#: URLs that reach the factors which the tables' own URLs do not.
_VARIANTS = (
    "https://en.wikipedia.org/wiki/Query", "https://de.wikipedia.org/wiki/A_b", "http://www.query.com/", "https://query.org/en-GB", "https://a.shop/product/1?x=c_d", "http://b.store/item/2,,3",
    "https://c.net/review", "https://x.com.evil.io/a?b=c_d", "https://uni.edu/a/b/c", "https://d.dev:8080/x#y", "https://amt.us", "no scheme", "https://www.src1.example.com/d/1",
)
_VARIED_SQL = "WITH " + DOCS_SQL + ", u AS (SELECT i - 1 AS k, x AS url FROM (SELECT unnest(range(1, " + str(len(_VARIANTS) + 1) + ")) AS i, unnest([" + ", ".join(f"'{u}'" for u in _VARIANTS) + "]) AS x)), t AS (SELECT docs.* EXCLUDE (url), coalesce(u.url, docs.url) AS url FROM docs LEFT JOIN u ON u.k = doc_id % 20)"


def _varied(spark, sf):
    names = F.create_map(*[F.lit(x) for k, u in enumerate(_VARIANTS) for x in (k, u)])
    return web_documents(spark, sf).withColumn("url", F.coalesce(F.try_element_at(names, (F.col("doc_id") % 20).cast("int")), F.col("url")))


@query("rank_hand_url_factors", f"SELECT page_id, round({_URL_SQL}, 9) AS factor FROM pages WHERE url IS NOT NULL")
def rank_hand_url_factors(spark, sf):
    p = table(spark, sf, "pages").where("url is not null")
    return p.select("page_id", F.round(ranking.url_factors(F.col("url")), 9).alias("factor"))


@query("rank_hand_full", _VARIED_SQL + f" SELECT doc_id, round({_hand_sql('the', 'en', 'us', 5)}, 9) AS boost FROM t")
def rank_hand_full(spark, sf):
    boost = ranking.hand_boost("the", "en", "us", ranking.UNKNOWN) * ranking.usability_factor(ranking.UNKNOWN)
    return _varied(spark, sf).select("doc_id", F.round(boost, 9).alias("boost"))


@query("rank_hand_intents", _VARIED_SQL + " UNION ALL ".join(f" SELECT doc_id, {k}::INTEGER AS intent, '{q}' AS query, round({_hand_sql(q, 'en', 'us', k, True)}, 9) AS boost FROM t" for k in range(6) for q in ("query", "incomprehensibilities")))
def rank_hand_intents(spark, sf):
    d = _varied(spark, sf)

    def case(k: int, q: str):
        boost = ranking.hand_boost(q, "en", "us", k) * ranking.usability_factor(k, mobile=True)
        return d.select("doc_id", F.lit(k).alias("intent"), F.lit(q).alias("query"), F.round(boost, 9).alias("boost"))

    out = None
    for k in range(6):
        for q in ("query", "incomprehensibilities"):
            out = case(k, q) if out is None else out.unionByName(case(k, q))
    return out


_RULES = [
    (1, "boost", "src1.example.com", "", 3.0), (1, "downrank", "src2.example.com", "", 3.0), (1, "discard", "src3.example.com", "", 1.0),
    (2, "boost", "src1.example.com", "", 1.0), (2, "path", "", "/d/1", 1.2), (1, "downrank", "src4.example.com", "", 1.0), (2, "important", "src4.example.com", "", 1.0), (2, "boost", "src4.example.com", "", 5.0),
    (1, "important", "src2.example.com", "", 1.0), (3, "important", "src2.example.com", "", 1.0), (3, "boost", "src2.example.com", "", 1.0), (2, "boost", "src5.example.com", "", 2.0), (1, "important", "src5.example.com", "", 1.0),
]


def _rules(spark, kinds):
    from seekloom.operators.rules import SCHEMA

    return spark.createDataFrame([r for r in _RULES if r[1] in kinds], SCHEMA)


@query("rank_goggle_boost", _VARIED_SQL + " SELECT url, round(CASE WHEN url LIKE '%://src1.%' THEN 1.45::DOUBLE * 1.15::DOUBLE WHEN url LIKE '%://src2.%' THEN 0.25 * 1.15::DOUBLE WHEN url LIKE '%://src4.%' THEN 0.5 * 1.45::DOUBLE WHEN url LIKE '%://src5.%' THEN 1.3::DOUBLE ELSE 1 END * CASE WHEN contains(regexp_replace(url, '[?#].*', ''), '/d/1') THEN 1 + 0.15::DOUBLE * 1.2::DOUBLE ELSE 1 END, 9) AS boost FROM t")
def rank_goggle_boost(spark, sf):
    rows = _varied(spark, sf).select("url", F.lit(1.0).alias("boost"))
    return ranking.apply_rules(rows, _rules(spark, ("boost", "downrank", "path"))).select("url", F.round("boost", 9).alias("boost"))


@query("rank_goggle_discard", _VARIED_SQL + " SELECT url FROM t WHERE url NOT LIKE '%://src3.%'")
def rank_goggle_discard(spark, sf):
    return ranking.apply_rules(_varied(spark, sf).select("url", F.lit(1.0).alias("boost")), _rules(spark, ("discard",))).select("url")


@query("rank_goggle_allowlist", "WITH " + DOCS_SQL + " SELECT url FROM docs WHERE source IN ('src1', 'src2', 'src4', 'src5') OR contains(url, '/d/1')")
def rank_goggle_allowlist(spark, sf):
    from seekloom.operators.rules import SCHEMA

    rules = _rules(spark, ("boost", "path")).unionByName(spark.createDataFrame([(3, "discard_default", "", "", 1.0)], SCHEMA))
    return ranking.apply_rules(web_documents(spark, sf).select("url", F.lit(1.0).alias("boost")), rules).select("url")


@query("rank_goggle_important", _VARIED_SQL + " SELECT url, round(CASE WHEN url LIKE '%://src1.%' THEN 2 * 1.45::DOUBLE * 1.15::DOUBLE WHEN url LIKE '%://src2.%' THEN 0.25 WHEN url LIKE '%://src4.%' THEN 1.45 ELSE 2 END::DOUBLE, 9) AS boost FROM t")
def rank_goggle_important(spark, sf):
    out = ranking.apply_rules(_varied(spark, sf).select("url", F.lit(2.0).alias("boost")), _rules(spark, ("important", "boost", "downrank")))
    return out.select("url", F.round("boost", 9).alias("boost"))


@query("rank_path_matches", r"""
WITH p AS (SELECT * FROM (VALUES ('^http://src1'), ('1$'), ('/d/2'), (''), ('^https://src2.example.com/d/7$')) AS t(pattern)), docs AS (SELECT 'https://' || coalesce(source, 'none') || '.example.com/d/' || doc_id AS url FROM documents)
SELECT pattern, count(*)::BIGINT AS n FROM p, docs WHERE CASE WHEN pattern LIKE '^%' AND pattern LIKE '%$' AND length(pattern) >= 2 THEN url = substr(pattern, 2, length(pattern) - 2) WHEN pattern LIKE '^%' THEN starts_with(url, substr(pattern, 2)) WHEN pattern LIKE '%$' THEN ends_with(url, substr(pattern, 1, length(pattern) - 1)) ELSE contains(url, pattern) END GROUP BY pattern""")
def rank_path_matches(spark, sf):
    patterns = spark.createDataFrame([("^http://src1",), ("1$",), ("/d/2",), ("",), ("^https://src2.example.com/d/7$",)], "pattern string")
    d = table(spark, sf, "documents").select(F.concat(F.lit("https://"), F.coalesce("source", F.lit("none")), F.lit(".example.com/d/"), F.col("doc_id").cast("string")).alias("url"))
    # a theta join with the few patterns of a rule set
    return d.join(F.broadcast(patterns), path_matches(F.col("url"), F.col("pattern"))).groupBy("pattern").agg(F.count("*").alias("n"))


_BASE = "WITH " + DOCS_SQL + ", b AS (SELECT doc_id, url, source, round((length(content) + 1) / 1000.0::DOUBLE, 6) AS score FROM docs), n AS (SELECT *, row_number() OVER (ORDER BY score DESC, url) AS rn FROM b)"


def _ranked(spark, sf):
    return web_documents(spark, sf).select("doc_id", "url", F.round((F.length("content") + 1) / F.lit(1000.0), 6).alias("score"))


@query("rank_pagerank_factor_top100", _BASE + """, s AS (SELECT doc_id, url, rn, CASE WHEN rn <= 100 THEN round(score * (1 + (doc_id % 10) / 10.0::DOUBLE), 9) ELSE score END AS score FROM n)
SELECT doc_id, score, row_number() OVER (ORDER BY (rn > 100)::INTEGER, CASE WHEN rn <= 100 THEN score END DESC, CASE WHEN rn <= 100 THEN url END, rn)::INTEGER AS place FROM s""")
def rank_pagerank_factor_top100(spark, sf):
    out = ranking.rescore_table(_ranked(spark, sf), 1 + F.col("doc_id") % 10 / F.lit(10.0), 100)
    return out.select("doc_id", "score", "place")


@query("rank_rerank_sigmoid_top30", _BASE + """, s AS (SELECT doc_id, url, rn, CASE WHEN rn <= 30 THEN round(score * (1 / (1 + exp(-((doc_id % 7) - 3.0::DOUBLE)))), 9) ELSE score END AS score FROM n)
SELECT doc_id, score, row_number() OVER (ORDER BY (rn > 30)::INTEGER, CASE WHEN rn <= 30 THEN score END DESC, CASE WHEN rn <= 30 THEN url END, rn)::INTEGER AS place FROM s""")
def rank_rerank_sigmoid_top30(spark, sf):
    out = ranking.rescore_table(_ranked(spark, sf), ranking.sigmoid(F.col("doc_id") % 7 - F.lit(3.0)), 30)
    return out.select("doc_id", "score", "place")


@query("rank_domain_cap", _BASE + " SELECT doc_id, rn::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rn) AS k FROM n) WHERE k <= 5")
def rank_domain_cap(spark, sf):
    return ranking.domain_cap(ranking.placed(_ranked(spark, sf))).select("doc_id", "place")


@query("rank_final_top20", _BASE + " SELECT doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rn) AS k FROM n) WHERE k <= 5 ORDER BY rn LIMIT 20")
def rank_final_top20(spark, sf):
    return ranking.domain_cap(ranking.placed(_ranked(spark, sf))).orderBy("place").limit(20).select("doc_id", "score")


@query("rank_blocked_terms", "WITH " + DOCS_SQL + " SELECT doc_id FROM docs WHERE NOT regexp_matches(lower(title || ' ' || content || ' ' || url), 'clown|trash')")
def rank_blocked_terms(spark, sf):
    from seekloom.operators.understanding import blocked

    d = web_documents(spark, sf)
    return d.where(~blocked(F.concat_ws(" ", "title", "content", "url"), ("clown", "trash"))).select("doc_id")


@query("rank_presentation", "WITH " + DOCS_SQL + r" SELECT doc_id, replace(regexp_replace(url, '^https?://', ''), '/', ' > ') AS crumb, CASE WHEN qna >= 70 THEN 'easy' WHEN qna >= 40 THEN 'medium' WHEN qna > 0 THEN 'hard' ELSE '' END AS reading, CASE WHEN load <= 0 THEN '' WHEN load < 1 THEN 'fast' WHEN load < 2.5 THEN 'medium' ELSE 'slow' END AS speed FROM docs")
def rank_presentation(spark, sf):
    return web_documents(spark, sf).select("doc_id", breadcrumb(F.col("url")).alias("crumb"), reading_level(F.col("qna")).alias("reading"), load_label(F.col("load")).alias("speed"))


#: The rules, peers' hits and link scores of the end-to-end query.
_E2E_RULES = [(1, "boost", "src1.example.com", "", 3.0), (1, "downrank", "src2.example.com", "", 1.0), (2, "path", "", "/d/1", 1.2), (2, "discard", "src3.example.com", "", 1.0)]
_E2E_SQL = _sql({"a": "with", "b": "when"}, ", " + _ASSIGNED + r""",
hits AS (
  SELECT 'FTS' AS engine, doc_id, score FROM (SELECT doc_id, round(8 * (a.s + b.s), 6) AS score FROM a JOIN b USING (doc_id) ORDER BY score DESC, doc_id LIMIT 160)
  UNION ALL SELECT 'IVF', vec_id, score FROM (SELECT vec_id, max(round(list_inner_product(x.v, q.v), 6)) AS score FROM assigned x, q WHERE k = 1 AND bucket_id IN (SELECT bucket_id FROM p) GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT 200)
  UNION ALL SELECT 'DEC', doc_id, load FROM docs WHERE source IN ('src1', 'src4')
),
ranked AS (SELECT hits.engine, hits.score AS raw, docs.*, row_number() OVER (PARTITION BY hits.engine ORDER BY hits.score DESC, url) - 1 AS r, CASE hits.engine WHEN 'FTS' THEN 2 WHEN 'IVF' THEN 3 ELSE 5 END AS o FROM hits JOIN docs USING (doc_id)),
fused AS (
  SELECT doc_id, round(sum(CASE engine WHEN 'FTS' THEN 1.7 WHEN 'IVF' THEN 1.6 ELSE 0.9 END::DOUBLE / (60 + r + 1) * CASE WHEN engine <> 'DEC' AND lang <> 'en' THEN 0.1::DOUBLE ELSE 1 END), 9) AS search_score,
         array_to_string(list(DISTINCT engine ORDER BY CASE engine WHEN 'FTS' THEN 2 WHEN 'IVF' THEN 3 ELSE 5 END), ',') AS engines FROM ranked GROUP BY doc_id
),
scored AS (
  SELECT doc_id, url, title, source, engines, round(search_score * (@HAND@) * CASE source WHEN 'src1' THEN 1.45::DOUBLE WHEN 'src2' THEN 0.5 ELSE 1 END * CASE WHEN contains(url, '/d/1') THEN 1 + 0.15::DOUBLE * 1.2::DOUBLE ELSE 1 END, 9) AS score
  FROM fused JOIN docs USING (doc_id) WHERE source <> 'src3'
),
n1 AS (SELECT *, row_number() OVER (ORDER BY score DESC, url) AS rn FROM scored),
s1 AS (SELECT * REPLACE (CASE WHEN rn <= 100 THEN round(score * (1 + (doc_id % 10) / 10.0::DOUBLE), 9) ELSE score END AS score) FROM n1),
n2 AS (SELECT * REPLACE (row_number() OVER (ORDER BY (rn > 100)::INTEGER, CASE WHEN rn <= 100 THEN score END DESC, CASE WHEN rn <= 100 THEN url END, rn) AS rn) FROM s1),
s2 AS (SELECT * REPLACE (CASE WHEN rn <= 30 THEN round(score * (1 / (1 + exp(-(4.0::DOUBLE * (contains(lower(title), 'with')::INTEGER + contains(lower(title), 'when')::INTEGER) / 2.0::DOUBLE - 2.0::DOUBLE)))), 9) ELSE score END AS score) FROM n2),
n3 AS (SELECT * REPLACE (row_number() OVER (ORDER BY (rn > 30)::INTEGER, CASE WHEN rn <= 30 THEN score END DESC, CASE WHEN rn <= 30 THEN url END, rn) AS rn) FROM s2)
SELECT rn::INTEGER AS place, doc_id, url, title, score, engines FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rn) AS c FROM n3) WHERE c <= 5 ORDER BY rn LIMIT 20""".replace("@HAND@", _hand_sql("with when", "en", "us", 5)))
# the leaves' names a and p are taken: the assignment of vectors is called otherwise
_E2E_SQL = _E2E_SQL.replace("\na AS (SELECT vec_id", "\nassigned AS (SELECT vec_id").replace(", c AS (SELECT bucket_id", ", c AS (SELECT bucket_id")


@query("search_end_to_end", _E2E_SQL)
def search_end_to_end(spark, sf):
    from seekloom.operators.rules import SCHEMA

    docs = web_documents(spark, sf)
    peers = docs.where("source in ('src1', 'src4')").select("doc_id", F.col("load").cast("double").alias("score"))
    scores = docs.select(F.col("url").alias("node"), (F.col("doc_id") % 10 / F.lit(10.0)).alias("score"))
    asked = _first_vector(spark, sf)
    found = engine.SearchEngine(spark, sf, embed=lambda _: asked, scores=scores)
    return found.search("with when", lang="en", loc="us", intent=ranking.UNKNOWN, rules=spark.createDataFrame(_E2E_RULES, SCHEMA), peers=peers)
