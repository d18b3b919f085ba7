"""Mixing sources to target weights by capped water-filling, DataFrame operations only.

Every source gets a share of the budget in proportion to its weight, but at
most ``max_epochs`` times its own size; what a capped source cannot take is
shared again by weight among the others until no source is above its cap. In
closed form: sort sources by cap / weight; the capped ones are a prefix.

A target of r times a source's size takes every document floor(r) times and a
seeded choice of documents once more: those of the smallest hashes whose sizes
add up to the rest, found by sums per hash bucket and one small window over
the bucket that the limit falls into, never by a window over a whole source.

Defined cases: a null text has size 0, a null source is a source of its own and
comes last, an empty table gives an empty result, documents of size 0 are never
counted as taken words, repeated rows are mixed one by one, columns of the
input with the names used here do not disturb.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, save

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Hex digits of the hash that name a bucket: 4,096 buckets a source.
DIGITS = 3
#: The table of sources is broadcast up to so many rows; beyond, it is joined by shuffle.
BROADCAST_ROWS = 50_000
#: Likewise the table of repeats per document (some 25 MB) in mix().
BROADCAST_CHOICES = 400_000


def order_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> and target. One row per source, so the windows see few rows."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    w = sources.withColumn("_w", F.get(pattern, ((F.row_number().over(named) - 1) % len(weights)).cast("int")))
    w = w.withColumn("_cap", (F.col("source_size") * max_epochs).cast("double"))
    filling = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = (
        w.withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("_all_w", F.sum("_w").over(everything))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.col("_all_w") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
        .withColumn("_open", F.col("_cap") > F.col("_level") * F.col("_w"))
    )
    # the level of the first source that stays under its cap holds for all after it
    level = F.min(F.when(F.col("_open"), F.struct((F.col("_cap") / F.col("_w")).alias("a"), F.col("_level").alias("level")))).over(everything)["level"]
    return w.withColumn("_final", level).select("source", "source_size", F.when(F.col("_open"), F.col("_final") * F.col("_w")).otherwise(F.col("_cap")).alias("target"))


def plan(sized: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """(doc_id, source, size) rows -> and source_size, target, repeats (whole and fractional copies).

    ``sized`` is read twice: give a written table.
    """
    keyed = sized.select("doc_id", "source", "size", order_key(F.col("doc_id"), seed).alias("_key")).withColumn("_b", F.substring("_key", 1, DIGITS))
    buckets = keyed.groupBy("source", "_b").agg(F.sum("size").alias("_sum"))
    sources = save(targets(buckets.groupBy("source").agg(F.sum("_sum").alias("source_size")), **shares), "mix-targets")
    few = sources.count() <= BROADCAST_ROWS
    dim = F.broadcast(sources) if few else sources
    dim = dim.select(F.col("source").alias("_s"), "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("_whole"))
    dim = dim.withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size"))
    so_far = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        buckets.withColumn("_before", F.coalesce(F.sum("_sum").over(so_far), F.lit(0)))
        .join(dim.select("_s", "_need"), F.col("source").eqNullSafe(F.col("_s")))
        .where((F.col("_before") <= F.col("_need")) & (F.col("_before") + F.col("_sum") > F.col("_need")))
        .groupBy("_s").agg(F.min(F.struct("_b", "_before")).alias("_edge"))
    )
    edge = save(edge, "mix-edges")
    edge = (F.broadcast(edge) if few else edge).select(F.col("_s").alias("_e"), F.col("_edge._b").alias("_edge_b"), F.col("_edge._before").alias("_edge_before"))
    rows = keyed.join(dim, F.col("source").eqNullSafe(F.col("_s"))).join(edge, F.col("source").eqNullSafe(F.col("_e")), "left")
    at_edge = F.col("_b") == F.col("_edge_b")
    within = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    split = rows.where(at_edge).withColumn("_cum", F.col("_edge_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    split = split.withColumn("_more", (F.col("_cum") + F.col("size") / 2.0 <= F.col("_need")).cast("long"))
    rest = rows.where(~at_edge | F.col("_edge_b").isNull()).withColumn("_more", F.when(F.col("_need") <= 0, 0).when(F.col("_edge_b").isNull() | (F.col("_b") < F.col("_edge_b")), 1).otherwise(0).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", (F.col("_whole") + F.col("_more")).alias("repeats")]
    return split.select(*columns).unionByName(rest.select(*columns))


def op9_mix(docs: DataFrame) -> DataFrame:
    """Contract query: doc_id, size, source_size, target, taken."""
    sized = save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    return plan(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def mix(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """The mixed corpus itself: every row of docs as often as the mix takes it, same columns.

    Rows are told apart by doc_id, source and size, so equal rows share one count
    and are repeated alike.
    """
    names = docs.columns
    tagged = docs.withColumn("__mix_size", n_words(F.col("text")))
    sized = save(tagged.select("doc_id", "source", F.col("__mix_size").alias("size")), "mix-sizes")
    chosen = plan(sized, seed, **shares).groupBy("doc_id", "source", "size").agg(F.max("repeats").alias("__mix_n")).where("__mix_n > 0")
    chosen = chosen.select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_sz"), "__mix_n")
    chosen = save(chosen, "mix-chosen")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_CHOICES else chosen
    same = F.col("doc_id").eqNullSafe(F.col("__mix_id")) & F.col("source").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_size") == F.col("__mix_sz"))
    return tagged.join(chosen, same).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_n")))).select(*names)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, (2 * source_size)::DOUBLE AS cap,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY (2 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY (2 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s
), t AS (
  SELECT *, cap > level * w AS open FROM f
), l AS (
  SELECT source, source_size, CASE WHEN open THEN (SELECT arg_min(level, cap / w) FROM t WHERE open) * w ELSE cap END AS target FROM t
), x AS (
  SELECT doc_id, size, source_size, target, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS whole,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum
  FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN target - whole * source_size > 0 AND cum + size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
