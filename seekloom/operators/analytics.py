"""Operational analytics: counters, visitors, log histograms, percentiles, series, retention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, PER_E = 400, 16
#: Upper edges in ms of the dashboard's histogram.
EDGES = (1, 5, 10, 25, 50, 100, 250, 500, 1000)


def daily_counts(rows: DataFrame, key: str = "stage") -> DataFrame:
    return rows.groupBy("day", key).agg(F.count("*").alias("n"))


def daily_visitors(rows: DataFrame) -> DataFrame:
    """Exact distinct visitors and all page views per day; distinct pairs are reduced before the shuffle."""
    return rows.groupBy("day", "visitor").agg(F.count("*").alias("n")).groupBy("day").agg(F.count("*").alias("visitors"), F.sum("n").alias("views"))


def visitors_by_country(rows: DataFrame) -> DataFrame:
    """Distinct visitors per day and country; a visitor's country is that of the day's first hit; "all" is left out."""
    first = rows.groupBy("day", "visitor").agg(F.min_by(F.lower("country"), F.struct("ts", "event_id")).alias("country"))
    return first.where("country != 'all'").groupBy("day", "country").agg(F.count("*").alias("visitors"))


def fingerprint(*parts: Column, salt: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(salt), *parts), 256)


def latency_bucket(us: Column) -> Column:
    return F.least(F.lit(BUCKETS), F.floor(PER_E * F.ln(F.greatest(F.lit(1.0), us)))).cast("int")


def bucket_ms(bucket: Column) -> Column:
    return F.exp((bucket + 0.5) / PER_E) / 1000


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys.., bucket, cnt): mergeable by summing cnt."""
    return rows.groupBy(*keys, latency_bucket(F.col("us")).alias("bucket")).agg(F.count("*").alias("cnt"))


def percentiles(hist: DataFrame, *keys: str, at=(0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest rank over buckets: the first bucket whose running count reaches ceil(p * total)."""
    run = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    h = hist.groupBy(*keys, "bucket").agg(F.sum("cnt").alias("cnt")).withColumn("_cum", F.sum("cnt").over(run)).withColumn("_all", F.sum("cnt").over(whole))
    return h.groupBy(*keys).agg(F.sum("cnt").alias("n"), *[F.min(F.when(F.col("_cum") >= F.greatest(F.lit(1), F.ceil(F.col("_all") * p)), F.col("bucket"))).alias(f"p{round(p * 100)}") for p in at])


def edge_bins(rows: DataFrame, edges=EDGES) -> DataFrame:
    """(bin, n): values in ms below each edge, the last bin open."""
    ms = F.col("us") / 1000
    b = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        b = F.when(ms < edges[k], k).otherwise(b)
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def zero_filled(counts: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Every day from the first to the last for every key, 0 where nothing happened."""
    span = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    grid = counts.select(key).distinct().crossJoin(F.broadcast(span))
    return grid.join(counts, ["day", key], "left").select("day", key, F.coalesce(value, F.lit(0)).alias(value))


def versus_yesterday(series: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Percent change on the row a day before, 0 where that is 0 or absent."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy("day"))
    return series.withColumn("yesterday", F.coalesce(before, F.lit(0))).withColumn("change", F.when(F.col("yesterday") > 0, F.round((F.col(value) - F.col("yesterday")) * 100.0 / F.col("yesterday"), 3)).otherwise(F.lit(0.0)))


def rolling(series: DataFrame, key: str, days: int, value: str = "n") -> DataFrame:
    """Sums over the last so many days of a zero-filled series."""
    w = Window.partitionBy(key).orderBy("day").rowsBetween(1 - days, 0)
    return series.withColumn("rolling", F.sum(value).over(w))


def retained(counts: DataFrame, days: int = 30) -> DataFrame:
    """Rows of the last so many days before the newest."""
    last = counts.agg(F.max("day").alias("_last"))
    return counts.crossJoin(F.broadcast(last)).where(F.col("day") > F.date_sub("_last", days)).drop("_last")


def expected_bucket(us: float) -> int:
    return min(BUCKETS, math.floor(PER_E * math.log(max(1.0, us))))


def index_size(segments: DataFrame, deletes: DataFrame, key: str = "doc_id", segment: str = "segment") -> DataFrame:
    """(segment, live): documents of each segment without the deleted ones."""
    return segments.join(deletes.select(key).distinct(), key, "left_anti").groupBy(segment).agg(F.count("*").alias("live"))


def flushed(counters: DataFrame, buffered: DataFrame, *keys: str) -> DataFrame:
    """Counters after one flush of buffered increments: both are (keys.., n)."""
    both = counters.select(*keys, "n").unionByName(buffered.groupBy(*keys).agg(F.sum("n").alias("n")))
    return both.groupBy(*keys).agg(F.sum("n").alias("n"))


def ratio(part: Column, whole: Column, digits: int = 1) -> Column:
    """A percentage as text, a dash where there is nothing to divide by."""
    return F.when(whole > 0, F.concat(F.format_number(100.0 * part / whole, digits), F.lit("%"))).otherwise(F.lit("-"))


def _fixed(x: Column, digits: int) -> Column:
    """A number with so many digits, halves to the even one."""
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def sparkline(values: Column, width: float, height: float) -> Column:
    """An SVG path through an array of numbers; under two of them, or equal ones, a level line."""
    low, high, n = F.array_min(values), F.array_max(values), F.size(values)
    step, plain = F.lit(float(width)) / (n - 1), lambda x: repr(int(x)) if float(x).is_integer() else repr(x)

    def point(v: Column, i: Column) -> Column:
        y = F.lit(float(height)) - ((v - low) / (high - low) * (height - 10.0) + 5.0)
        return F.concat(F.when(i == 0, "M ").otherwise("L "), _fixed(i * step, 1), F.lit(","), _fixed(y, 1))

    level = F.lit(f"M 0,{plain(height / 2)} L {plain(width)},{plain(height / 2)}")
    return F.when((n < 2) | (high <= low), level).otherwise(F.array_join(F.transform(values, point), " "))


def polyline(values: Column, counts: Column, most: Column) -> Column:
    """SVG points of a daily series; days without a count leave no point."""
    n = F.size(values)
    step = F.when(n > 1, F.lit(300.0) / (n - 1)).otherwise(F.lit(0.0))
    points = F.zip_with(values, counts, lambda v, c: F.struct(v.alias("v"), c.alias("c")))
    drawn = F.transform(points, lambda p, i: F.when(p["c"] > 0, F.concat(_fixed(i * step, 1), F.lit(","), _fixed(F.lit(96.0) - p["v"] / most * 92.0, 1))))
    return F.array_join(F.filter(drawn, lambda x: x.isNotNull()), " ")


def bars(counts: Column) -> Column:
    """array<struct<x, w, y, h, last>>: bars of a chart 300 by 100."""
    n, most = F.greatest(F.size(counts), F.lit(1)), F.greatest(F.array_max(counts), F.lit(1))
    slot = F.lit(300.0) / n

    def bar(c: Column, i: Column) -> Column:
        h = F.greatest(c / most * 96.0, F.when(c > 0, 2.0).otherwise(0.6))
        return F.struct(_fixed(i * slot + slot * 0.15, 2).alias("x"), _fixed(slot * 0.70, 2).alias("w"), _fixed(100.0 - h, 2).alias("y"), _fixed(h, 2).alias("h"), (i + 1 == F.size(counts)).alias("last"))

    return F.transform(counts, bar)


def series_summary(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, first, last, low, high, change): a rate series in brief, change in percent of the first value."""
    ends = rows.groupBy(key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.min(value).alias("low"), F.max(value).alias("high"))
    return ends.withColumn("change", F.when(F.col("first") != 0, F.round((F.col("last") - F.col("first")) * 100.0 / F.col("first"), 2)).otherwise(F.lit(0.0)))
