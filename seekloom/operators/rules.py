"""Rule sets: text form to rows and back, quick-tune lists, refresh decisions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekloom.functions.urls import domain

SCHEMA = "goggle_id long, kind string, domain string, pattern string, weight double"


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text and not re.search(r"[_\s]", text) else None
    except ValueError:
        return None


def parse(goggle_id: int, text: str, paths: bool = False) -> list[tuple]:
    """Rows of SCHEMA, one for each (kind, domain): the last line wins.

    Text before $ is ignored unless paths; of the options after it discard beats
    downrank beats boost, and downrank takes the number of boost= too; important
    stands beside them as a row of its own. A line without site= has no effect,
    but for a bare $discard.
    """
    rows: dict[tuple, tuple] = {}

    def put(kind: str, domain: str, pattern: str, weight: float) -> None:
        rows[kind, domain, pattern] = (goggle_id, kind, domain, pattern, weight)

    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("!") or "$" not in line:
            continue
        if line == "$discard":
            put("discard_default", "", "", 1.0)
            continue
        pattern, _, body = line.partition("$")
        options = [p.partition("=") for p in body.split(",")]
        flags = {k for k, eq, _ in options if not eq}
        values = {k: v for k, eq, v in options if eq}
        number = next((_number(v) for k, eq, v in reversed(options) if eq and k in ("boost", "downrank")), None)
        kind = "discard" if "discard" in flags else "downrank" if "downrank" in flags or "downrank" in values else "boost" if number is not None else None
        site = values.get("site")
        if site is not None:
            domain = site.lower()
            if "important" in flags:
                put("important", domain, "", 1.0)
            if kind:
                put(kind, domain, "", 1.0 if kind == "discard" or number is None else number)
        elif paths and pattern and kind == "boost":
            put("path", "", pattern, number)
    return list(rows.values())


def metadata(text: str) -> dict[str, str]:
    """Values of the lines "! key: value"."""
    return {k.strip(): v.strip() for line in text.splitlines() if line.startswith("!") and ":" in line for k, _, v in [line[1:].partition(":")]}


def quick_tune(boost: list[str], downrank: list[str], discard: list[str], goggle_id: int = -1) -> list[tuple]:
    """Preferences as a rule set of weight 3; a domain without www. stands for both."""
    kinds = (("boost", boost), ("downrank", downrank), ("discard", discard))
    names = lambda d: (d,) if d.startswith("www.") else (d, f"www.{d}")
    return [(goggle_id, kind, name, "", 3.0) for kind, domains in kinds for d in dict.fromkeys(domains) for name in names(d)]


def tuned_domains(results: DataFrame, prefs: DataFrame) -> DataFrame:
    """(place, url) of results and (domain, kind) of preferences -> (ord, domain, boosted, downranked, discarded).

    The results' domains in order of their first place, then saved domains that are not shown, by name.
    """
    shown = results.select(domain(F.col("url")).alias("domain"), "place").where("domain != ''").groupBy("domain").agg(F.min("place").alias("ord"))
    saved = prefs.select(F.regexp_replace("domain", r"^www[.]", "").alias("domain"), "kind").groupBy("domain").agg(*[F.max((F.col("kind") == k).cast("int")).alias(n) for k, n in (("boost", "boosted"), ("downrank", "downranked"), ("discard", "discarded"))])
    flag = lambda n: (F.coalesce(n, F.lit(0)) == 1).alias(n)
    return shown.join(saved, "domain", "full").select("ord", "domain", flag("boosted"), flag("downranked"), flag("discarded"))


def visible(sets: DataFrame, owner: str | None = None) -> DataFrame:
    """(goggle_id, owner, public, ..): the public rule sets and one owner's."""
    return sets.where(F.col("public") | (F.col("owner") == owner) if owner is not None else F.col("public"))


def touch(sets: DataFrame, goggle_id: int, now: Column) -> DataFrame:
    """The table with one set's fetched_at set anew; written as a whole it replaces the old one."""
    return sets.withColumn("fetched_at", F.when(F.col("goggle_id") == goggle_id, now).otherwise(F.col("fetched_at")))


def delete(sets: DataFrame, goggle_id: int) -> DataFrame:
    return sets.where(F.col("goggle_id") != goggle_id)


def export(rules: DataFrame) -> DataFrame:
    """(goggle_id, value): one line per rule."""
    kind = F.when(F.col("kind") == "discard_default", F.lit("$discard")).when(
        F.col("kind").isin("boost", "downrank"), F.concat(F.lit("$"), F.col("kind"), F.lit("="), F.col("weight").cast("int").cast("string"), F.lit(",site="), F.col("domain"))
    ).otherwise(F.concat(F.lit("$"), F.col("kind"), F.lit(",site="), F.col("domain")))
    return rules.select("goggle_id", kind.alias("value"))


def refresh_action(age_seconds: Column, status: Column, same_hash: Column) -> Column:
    """keep, delete, touch or store for a fetched rule set."""
    return F.when(age_seconds <= 86400, "keep").when(status.isin(404, 410), "delete").when(status != 200, "keep").when(same_hash, "touch").otherwise("store")
