"""Quality rules, line first: drop the lines that fail, then the texts that lose too much.

DataFrame operations only. Each line with a word is judged on its own:

* punctuation: without closing punctuation;
* navigation: bars or other symbols make up a third of its words or more, or
  it only shouts (three words or more, no lower-case letter), or it repeats
  (six words or more, each word three times and more on average);
* boilerplate: it holds one of PHRASES as whole words.

A text is kept if the base rules pass and the lines that stay hold at least
KEEP of its words. Repeated passages are found per text as windows of WINDOW
word hashes; the sorting step runs only where two windows are equal.

Defined cases: a null or empty text has no words and fails; a text of one very
long line is one line; repeated rows are judged one by one; an empty table gives
an empty result; other columns are kept by clean() and ignored by op5_quality().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

LEAST_WORDS = 20
WINDOW = 8
#: A text fails if more than this percentage of its words is in repeated windows.
REPEAT_PERCENT = 30
#: Share of the words that must stay.
KEEP = 0.5
SYMBOLS = r"[#*$%&|<>]"
SPACE = " \t\n\x0b\x0c\r"
#: Lower-case phrases of boilerplate lines, by language (fixed values).
PHRASES = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "use cookies", "cookie policy", "enable javascript", "click here", "sign up",
    "log in to", "subscribe to our", "read more", "share this", "copyright ©", "powered by", "skip to content",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookies verwenden", "hier klicken", "jetzt anmelden", "newsletter abonnieren", "zum inhalt springen",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "utilise des cookies", "cliquez ici", "lire la suite", "se connecter", "aller au contenu",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "utiliza cookies", "haga clic aquí", "leer más", "iniciar sesión", "saltar al contenido",
)
CLOSED = r"[.!?…:;\x22'”’»)\]。！？][\x20\x09-\x0D]*$"
PHRASE = r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(PHRASES) + r")(?:[^\p{L}\p{N}]|$)"


def line_fails(line: Column) -> Column:
    """Whether one line is dropped; null and blank lines are not judged here."""
    words = F.regexp_count(line, F.lit(WORD))
    unfinished = ~F.regexp_like(line, F.lit(CLOSED))
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) * 3 >= words
    shouts = (words >= 3) & (line == F.upper(line)) & (line != F.lower(line))
    repeats = (words >= 6) & (F.size(F.array_distinct(F.split(line, r"[\x20\x09-\x0D]+"))) * 3 <= words)
    phrase = F.regexp_like(F.lower(line), F.lit(PHRASE))
    return unfinished | symbols | shouts | repeats | phrase


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))


def measure(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_words, kept.

    Columns of docs with these names are replaced; names starting with _q are used within.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_words", "kept"]
    own = [F.col(c) for c in docs.columns if c not in added]
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    none = F.array().cast("array<string>")
    # every step is a projection of its own, so that nothing is computed twice
    d = docs.select(*own, F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(none).alias("_q_words"), _lines(text).alias("_q_lines"),
                    (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    rest = ["word_chars", "n_symbols", "n_words", "n_dup_lines", "kept_words"]
    d = d.select(*own, "word_chars", "n_symbols", F.size("_q_words").cast("long").alias("n_words"), F.transform("_q_words", lambda w: F.xxhash64(w)).alias("_q_hash"),
                 (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
                 F.aggregate(F.filter("_q_lines", lambda x: ~line_fails(x)), F.lit(0).cast("long"), lambda a, x: a + F.regexp_count(x, F.lit(WORD))).alias("kept_words"))
    # get() reads one element; slice() would copy the whole array for each window
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>"))
    d = d.select(*own, *rest, F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("_q_hash"), i + k) for k in range(WINDOW)])).alias("_q_windows"))
    repeated = F.size(F.array_distinct("_q_windows")) < F.size("_q_windows")
    pairs = F.sort_array(F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.select(*own, *rest, F.when(repeated, pairs).alias("_q_pairs"))
    pair = lambda i: F.get(F.col("_q_pairs"), i)["h"]
    twice = F.filter(F.transform("_q_pairs", lambda x, i: F.when((pair(i - 1) == x["h"]) | (pair(i + 1) == x["h"]), x["i"])), lambda x: x.isNotNull())
    d = d.select(*own, *rest, F.sort_array(twice).alias("_q_at"))
    cover = F.aggregate("_q_at", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda acc, x: F.struct((x + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - x)).alias("n")), lambda acc: acc["n"])
    d = d.select(*own, *rest, F.coalesce(cover, F.lit(0).cast("long")).alias("n_repeat_words"))
    d = d.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("kept_words") >= KEEP * F.col("n_words"))).select(*own, *added)


def clean(docs: DataFrame) -> DataFrame:
    """Kept rows with the failing lines taken out of their text; same columns, n_chars set anew."""
    # a condition on a row number is not pushed below the projections, which would repeat their work in it many times over
    judged = measure(docs).withColumn("_q_row", F.monotonically_increasing_id()).where((F.col("_q_row") >= 0) & F.col("kept")).select(*docs.columns)
    stay = F.filter(F.split("text", "\n"), lambda x: ~F.regexp_like(x, F.lit(WORD)) | ~line_fails(x))
    out = judged.withColumn("text", F.array_join(stay, "\n"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_quality(docs: DataFrame) -> DataFrame:
    """Contract query: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_words."""
    return measure(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
x AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: {'i': i, 'h': hash(w[i:i + 7])})) AS z FROM w WHERE len(w) >= 8),
g AS (SELECT doc_id, z.i AS i, count(*) OVER (PARTITION BY doc_id, z.h) AS n FROM x),
r AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g WHERE n > 1) GROUP BY doc_id),
u AS (SELECT doc_id, unnest(l) AS x FROM w),
k AS (
  SELECT doc_id, sum(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS n FROM u
  WHERE regexp_matches(x, '@CLOSED@')
    AND NOT (len(regexp_extract_all(x, '[#*$%&|<>]')) * 3 >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
    AND NOT (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 3 AND x = upper(x) AND x <> lower(x))
    AND NOT (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 6 AND len(list_distinct(regexp_split_to_array(x, '[\x20\x09-\x0D]+'))) * 3 <= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
    AND NOT regexp_matches(lower(x), '@PHRASES@')
  GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(k.n, 0)::BIGINT AS kept_words
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kept_words >= 0.5 * n_words AS kept FROM m
""".replace("@PHRASES@", PHRASE.replace("'", "''")).replace("@CLOSED@", CLOSED.replace("'", "''"))
