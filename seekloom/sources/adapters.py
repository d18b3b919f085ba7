"""The search model's tables from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekloom.session import table


def web_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape of the fact table; features absent from the data follow from doc_id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    q = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = d.join(q, "doc_id", "left")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        "doc_id",
        F.concat(F.when(F.col("doc_id") % 3 == 0, "http://").otherwise("https://"), F.coalesce("source", F.lit("none")), F.lit(".example.com/d/"), F.col("doc_id").cast("string")).alias("url"),
        F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"),
        text.alias("content"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.when(F.col("lang") == "de", "de").when(F.col("lang") == "fr", "fr").when(F.col("lang") == "es", "es").otherwise("us").alias("loc"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("safe_s"),
        (F.coalesce("quality", F.lit(0)) * 400.0).alias("qna"),
        (F.col("doc_id") % 60 / 10.0).alias("load"),
        (F.col("doc_id") % 6).cast("int").alias("intent"),
        (F.size(F.split(text, " ")) >= 500).alias("has_500_words"),
        (F.col("doc_id") % 101).cast("double").alias("readability"),
        (F.col("doc_id") % 13 * 100.0).alias("effort"),
        (F.col("doc_id") % 2 == 0).alias("is_mobile"),
        (240000 + (F.col("doc_id") % 12 + 1) * 100 + F.col("doc_id") % 28 + 1).cast("int").alias("date"),
    )


DOCS_SQL = r"""
docs AS (
  SELECT d.doc_id, (CASE WHEN d.doc_id % 3 = 0 THEN 'http://' ELSE 'https://' END) || coalesce(source, 'none') || '.example.com/d/' || d.doc_id AS url,
         split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS content, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CASE lang WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr' WHEN 'es' THEN 'es' ELSE 'us' END AS loc,
         coalesce(toxic, 0) = 0 AS safe_s, coalesce(quality, 0) * 400.0::DOUBLE AS qna, (d.doc_id % 60) / 10.0::DOUBLE AS load,
         (d.doc_id % 6)::INTEGER AS intent, len(string_split(coalesce(text, ''), ' ')) >= 500 AS has_500_words,
         (d.doc_id % 101)::DOUBLE AS readability, (d.doc_id % 13) * 100.0::DOUBLE AS effort, d.doc_id % 2 = 0 AS is_mobile,
         (240000 + (d.doc_id % 12 + 1) * 100 + d.doc_id % 28 + 1)::INTEGER AS date
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) q ON q.doc_id = d.doc_id
)"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): user turns."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, day, visitor, country, stage, us): events as page views and timings."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"), F.col("user_id").alias("visitor"),
        F.concat(F.lit("c"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))).alias("country"), F.col("event_type").alias("stage"), (F.col("value") * 1000).alias("us"),
    )


VISITS_SQL = "v AS (SELECT event_id, ts, ts::DATE AS day, user_id AS visitor, 'c' || coalesce(json_extract_string(props, '$.k'), '0') AS country, event_type AS stage, value * 1000 AS us FROM events)"


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite link graph: customer -> supplier of ordered items, named as URLs."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    pairs = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select("o_custkey", "l_suppkey").distinct()
    return pairs.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))


EDGES_SQL = "edges AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
