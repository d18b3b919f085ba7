"""Ingest of delimited dumps: validation, first-wins uniqueness, upserts, integrity, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DELIMITER = "<-->"
#: The fields of a dump line in order.
FIELDS = ("url", "title", "description", "content", "favicon", "image", "keywords", "safe_s", "html", "lang", "loc", "points", "load", "date", "intent", "is_mobile", "has_500_words", "vector")


def to_lines(docs: DataFrame, dim: int = 8) -> DataFrame:
    """(value): dump lines; columns that docs lacks are empty, the vector is zero (peer export)."""
    have = set(docs.columns)
    zero = F.lit(",".join(["0"] * dim))
    parts = [F.col(f).cast("string") if f in have else F.lit("0,0,0,0") if f == "points" else zero if f == "vector" else F.lit("") for f in FIELDS]
    return docs.select(F.concat_ws(DELIMITER, *[F.coalesce(p, F.lit("")) for p in parts]).alias("value"))


def parse_lines(lines: DataFrame, dim: int = 8) -> DataFrame:
    """(value) -> typed rows of valid lines: 18 fields, a vector of dim numbers, 4 points; others are dropped."""
    p = F.split("value", DELIMITER)
    d = lines.select("*", p.alias("_p")).where(F.size("_p") == len(FIELDS))
    numbers = lambda k: F.transform(F.split(F.get("_p", F.lit(k)), ","), lambda x: x.try_cast("double"))
    text = [F.get("_p", F.lit(k)).alias(f) for k, f in enumerate(FIELDS) if f in ("url", "title", "description", "content", "favicon", "image", "keywords", "html", "lang", "loc")]
    flag = lambda k: (F.lower(F.get("_p", F.lit(k))) == "true")
    rest = [c for c in lines.columns if c != "value"]
    d = d.select(
        *rest, *text, flag(7).alias("safe_s"), numbers(11).alias("points"), F.coalesce(F.get("_p", F.lit(12)).try_cast("double"), F.lit(0.0)).alias("load"),
        F.coalesce(F.get("_p", F.lit(13)).try_cast("int"), F.lit(0)).alias("date"), F.coalesce(F.get("_p", F.lit(14)).try_cast("int"), F.lit(5)).alias("intent"),
        flag(15).alias("is_mobile"), flag(16).alias("has_500_words"), numbers(17).alias("vector"),
    )
    good = lambda c, n: (F.size(c) == n) & F.forall(c, lambda x: x.isNotNull())
    return d.where(good("vector", dim) & good("points", 4))


def first_wins(rows: DataFrame, stored: DataFrame | None = None, key: str = "url", order: str = "line") -> DataFrame:
    """New rows only: not stored yet, and the first line of each key."""
    if stored is not None:
        rows = rows.join(stored.select(key), key, "left_anti")
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def orphans(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows without a stored document."""
    return rows.join(stored.select(key).distinct(), key, "left_anti")


def within_quota(sizes: DataFrame, limit_gb: float) -> bool:
    """Whether the stores' bytes stay within the limit; a write is refused beyond it."""
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return total <= limit_gb * 2**30
