"""Registered queries of operational analytics, streams and extensions, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekloom.operators import analytics
from seekloom.session import table
from seekloom.sources.adapters import VISITS_SQL, visits
from seekloom.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_V = "WITH " + VISITS_SQL
_C = _V + ", c AS (SELECT day, stage, count(*)::BIGINT AS n FROM v GROUP BY day, stage)"
_Z = _C + ", g AS (SELECT unnest(generate_series((SELECT min(day) FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY))::DATE AS day), z AS (SELECT g.day, s.stage, coalesce(c.n, 0)::BIGINT AS n FROM g CROSS JOIN (SELECT DISTINCT stage FROM c) s LEFT JOIN c ON c.day = g.day AND c.stage = s.stage)"
_H = _V + ", h AS (SELECT stage, least(400, floor(16 * ln(greatest(1.0, us))))::INTEGER AS bucket, count(*)::BIGINT AS cnt FROM v GROUP BY 1, 2)"


def _counts(spark, sf):
    return analytics.daily_counts(visits(spark, sf))


@query("ana_daily_counts", _C + " SELECT * FROM c")
def ana_daily_counts(spark, sf):
    return _counts(spark, sf)


@query("ana_daily_visitors", _V + " SELECT day, count(DISTINCT visitor)::BIGINT AS visitors, count(*)::BIGINT AS views FROM v GROUP BY day")
def ana_daily_visitors(spark, sf):
    return analytics.daily_visitors(visits(spark, sf))


@query("ana_visitors_by_country", _V + ", f AS (SELECT day, visitor, arg_min(lower(country), (ts, event_id)) AS country FROM v GROUP BY day, visitor) SELECT day, country, count(*)::BIGINT AS visitors FROM f WHERE country <> 'all' GROUP BY day, country")
def ana_visitors_by_country(spark, sf):
    return analytics.visitors_by_country(visits(spark, sf))


@query("ana_zero_filled_series", _Z + " SELECT * FROM z")
def ana_zero_filled_series(spark, sf):
    return analytics.zero_filled(_counts(spark, sf), "stage")


@query("ana_today_vs_yesterday", _Z + ", y AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY stage ORDER BY day), 0)::BIGINT AS yesterday FROM z) SELECT *, CASE WHEN yesterday > 0 THEN round((n - yesterday) * 100.0::DOUBLE / yesterday, 3) ELSE 0.0 END::DOUBLE AS change FROM y")
def ana_today_vs_yesterday(spark, sf):
    return analytics.versus_yesterday(analytics.zero_filled(_counts(spark, sf), "stage"), "stage")


@query("ana_rolling_7d", _Z + " SELECT *, sum(n) OVER (PARTITION BY stage ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS rolling FROM z")
def ana_rolling_7d(spark, sf):
    return analytics.rolling(analytics.zero_filled(_counts(spark, sf), "stage"), "stage", 7)


@query("ana_latency_hist", _H + " SELECT * FROM h")
def ana_latency_hist(spark, sf):
    return analytics.histogram(visits(spark, sf), "stage")


_P = "SELECT {k}sum(cnt)::BIGINT AS n, min(CASE WHEN cum >= greatest(1, ceil(total * 0.5)) THEN bucket END) AS p50, min(CASE WHEN cum >= greatest(1, ceil(total * 0.95)) THEN bucket END) AS p95, min(CASE WHEN cum >= greatest(1, ceil(total * 0.99)) THEN bucket END) AS p99 FROM r GROUP BY {g}"


@query("ana_latency_percentiles", _H + ", r AS (SELECT *, sum(cnt) OVER (PARTITION BY stage ORDER BY bucket) AS cum, sum(cnt) OVER (PARTITION BY stage) AS total FROM h) " + _P.format(k="stage, ", g="stage"))
def ana_latency_percentiles(spark, sf):
    return analytics.percentiles(analytics.histogram(visits(spark, sf), "stage"), "stage")


@query("ana_latency_daily", _V + ", h AS (SELECT day, least(400, floor(16 * ln(greatest(1.0, us))))::INTEGER AS bucket, count(*)::BIGINT AS cnt FROM v GROUP BY 1, 2), r AS (SELECT *, sum(cnt) OVER (PARTITION BY day ORDER BY bucket) AS cum, sum(cnt) OVER (PARTITION BY day) AS total FROM h) " + _P.format(k="day, ", g="day"))
def ana_latency_daily(spark, sf):
    return analytics.percentiles(analytics.histogram(visits(spark, sf), "day"), "day")


@query("ana_latency_merge", _H + " SELECT bucket, sum(cnt)::BIGINT AS cnt, round(exp((bucket + 0.5) / 16) / 1000, 6) AS ms FROM h GROUP BY bucket")
def ana_latency_merge(spark, sf):
    h = analytics.histogram(visits(spark, sf), "stage").groupBy("bucket").agg(F.sum("cnt").alias("cnt"))
    return h.withColumn("ms", F.round(analytics.bucket_ms(F.col("bucket")), 6))


@query("ana_latency_dist_bins", _V + " SELECT CASE " + " ".join(f"WHEN us / 1000 < {e} THEN {k}" for k, e in enumerate(analytics.EDGES)) + f" ELSE {len(analytics.EDGES)} END AS bin, count(*)::BIGINT AS n FROM v GROUP BY 1")
def ana_latency_dist_bins(spark, sf):
    return analytics.edge_bins(visits(spark, sf))


@query("ana_retention_30d", _C + " SELECT * FROM c WHERE day > (SELECT max(day) FROM c) - INTERVAL 30 DAY")
def ana_retention_30d(spark, sf):
    return analytics.retained(_counts(spark, sf))


@query("ana_yield_ratio", _V + " SELECT day, sum((stage <> 'error')::INTEGER)::BIGINT AS ok, count(*)::BIGINT AS n, round(sum((stage <> 'error')::INTEGER) * 100.0::DOUBLE / count(*), 3) AS success, (count(*) // nullif(count(DISTINCT visitor), 0))::BIGINT AS avg_batch FROM v GROUP BY day")
def ana_yield_ratio(spark, sf):
    per = visits(spark, sf).groupBy("day", "visitor").agg(F.count("*").alias("n"), F.sum((F.col("stage") != "error").cast("long")).alias("ok"))
    d = per.groupBy("day").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n"), F.count("*").alias("_v"))
    return d.select("day", "ok", "n", F.round(F.col("ok") * 100.0 / F.col("n"), 3).alias("success"), F.floor(F.col("n") / F.col("_v")).alias("avg_batch"))


@query("ana_fx_summary", "SELECT event_type, round(min(value), 6) AS low, round(max(value), 6) AS high, round((min(value) + max(value)) / 2, 6) AS mid, round(arg_max(value, (ts, event_id)), 6) AS last FROM events GROUP BY event_type")
def ana_fx_summary(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))
    return e.select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round((F.col("low") + F.col("high")) / 2, 6).alias("mid"), F.round("last", 6).alias("last"))


@query("ana_top_countries", _V + " SELECT country, count(DISTINCT visitor)::BIGINT AS visitors FROM v GROUP BY country ORDER BY visitors DESC, country LIMIT 10")
def ana_top_countries(spark, sf):
    d = visits(spark, sf).select("country", "visitor").distinct().groupBy("country").agg(F.count("*").alias("visitors"))
    return d.orderBy(F.col("visitors").desc(), "country").limit(10)


@query("ana_daily_quota", _V + " SELECT day, visitor, count(*)::BIGINT AS used, count(*) > 25 AS refused FROM v GROUP BY day, visitor")
def ana_daily_quota(spark, sf):
    return visits(spark, sf).groupBy("day", "visitor").agg(F.count("*").alias("used")).withColumn("refused", F.col("used") > 25)


# ------------------------------------------------------------------ streams


@query("stream_daily_visitors", "SELECT ts::DATE AS day, count(DISTINCT user_id)::BIGINT AS visitors FROM events GROUP BY 1")
def stream_daily_visitors(spark, sf):
    return jobs.daily_visitors(spark, sf)


@query("stream_tumbling_counts", "SELECT ts::DATE AS day, event_type AS stage, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark, sf):
    return jobs.tumbling_counts(spark, sf)


@query("stream_quota", "SELECT ts::DATE AS day, user_id AS visitor, least(count(*), 25)::BIGINT AS admitted FROM events GROUP BY 1, 2")
def stream_quota(spark, sf):
    return jobs.quota(spark, sf)


# --------------------------------------------------------------- extensions


@query("ext_session_window", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, count(*)::BIGINT AS n FROM s GROUP BY user_id, g")
def ext_session_window(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n")).select("user_id", "n")


@query("ext_cube_rollup", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube_rollup(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("ext_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def ext_intersect(spark, sf):
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "labels").select("doc_id"))


@query("ext_approx_distinct")
def ext_approx_distinct(spark, sf):
    return visits(spark, sf).groupBy("day").agg(F.approx_count_distinct("visitor", 0.02).alias("visitors"))
