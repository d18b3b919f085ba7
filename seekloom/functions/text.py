"""Text columns: terms, sanitising, truncation, collapsing, labels, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Lower-case letter and digit runs in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def sanitize(text: Column) -> Column:
    return F.translate(text, "\"'", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"[ \t\r\n]+", " ")


def truncate(text: Column, limit: int) -> Column:
    """Beyond limit bytes: the first limit - 3 characters and an ellipsis."""
    return F.when(F.octet_length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def distinct_hits(words: Column, lexicon: list[str]) -> Column:
    """How many distinct words (by their own case) are in the lexicon when lower-cased."""
    known = F.array(*[F.lit(w) for w in lexicon])
    return F.size(F.filter(F.array_distinct(words), lambda w: F.array_contains(known, F.lower(w))))


def reading_level(score: Column) -> Column:
    return F.when(score >= 70, "easy").when(score >= 40, "medium").when(score > 0, "hard").otherwise("")


def load_label(seconds: Column) -> Column:
    return F.when(seconds <= 0, "").when(seconds < 1, "fast").when(seconds < 2.5, "medium").otherwise("slow")


def breadcrumb(url: Column) -> Column:
    """host > segment > segment, without scheme, query and fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"[?#].*", ""), r"^[A-Za-z]+://", ""), r"/$", "")
    return F.replace(bare, F.lit("/"), F.lit(" > "))


def thousands(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(F.round(n / 1e6, 1).cast("string"), F.lit("M"))).when(n >= 1000, F.concat(F.round(n / 1e3, 1).cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def byte_size(n: Column) -> Column:
    step = lambda unit, name: F.concat(F.round(n / unit, 1).cast("string"), F.lit(" " + name))
    return F.when(n >= 1 << 30, step(1 << 30, "GB")).when(n >= 1 << 20, step(1 << 20, "MB")).when(n >= 1 << 10, step(1 << 10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


#: What a search may be after.
INTENTS = ("informational", "navigational", "transactional", "commercial", "local")


def intent_label(intent: Column) -> Column:
    """The name of an intent's number, "" for an unknown one."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in INTENTS]), intent.cast("int")), F.lit(""))
