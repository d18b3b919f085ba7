"""Full-text search: a query language compiled to one scan with column expressions.

A query becomes a boolean expression over leaves (terms, phrases, ranges). Per
document the scan counts each leaf in each field by one pass of a pattern, without
an array of words, and keeps a few numbers a document; a global aggregate over
these gives the BM25 statistics (one row, broadcast). No token is ever exploded, so
a search costs one pass over the searched columns and shuffles only its result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekloom.functions.text import terms
from seekloom.session import checkpoints

K1, B = 1.2, 0.75
#: A character of a word, and what stands between words.
TOKEN, GAP = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]+"
FIELDS = ("title", "content")
#: Candidates that one engine passes on.
CANDIDATES = 160


@dataclass(frozen=True)
class Leaf:
    """Words in order (one: a term), in one field or the default ones, or an open range of a column."""

    words: tuple[str, ...] = ()
    field: str | None = None
    low: str | None = None
    high: str | None = None
    inclusive: bool = False


@dataclass
class Node:
    kind: str  # leaf, and, or, not, boost
    parts: list = field(default_factory=list)
    leaf: Leaf | None = None
    boost: float = 1.0


_LEX = re.compile(r'\s*(?:(\()|(\))|(\^)([0-9.]+)|(AND|OR|NOT)(?=[\s()]|$)|([+-])(?=\S)|(?:([A-Za-z_]+):)?(?:"([^"]*)"|([\[{])\s*(\S+)\s+TO\s+(\S+?)\s*([\]}])|([^\s()^"]+)))')


def parse(query: str) -> Node:
    """Grammar: term, "phrase", field:x, +x, -x, AND, OR, NOT, (..), x^boost, [a TO b], {a TO b}; default AND."""
    lexed = []
    at = 0
    query = query.rstrip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m:
            raise ValueError(f"cannot parse {query[at:]!r}")
        lexed.append(m)
        at = m.end()
    place = 0

    def peek():
        return lexed[place] if place < len(lexed) else None

    def take():
        nonlocal place
        place += 1
        return lexed[place - 1]

    def either() -> Node:
        parts = [both()]
        while (m := peek()) and m[5] == "OR":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", parts)

    def both() -> Node:
        parts = []
        while (m := peek()) and m[5] != "OR" and not m[2]:
            if m[5] == "AND":
                take()
                continue
            parts.append(single())
        if not parts:
            raise ValueError("an operand is missing")
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def single() -> Node:
        m = take()
        if m[5] == "NOT" or m[6] == "-":
            return Node("not", [single()])
        if m[6] == "+":
            return single()
        if m[1]:
            node = either()
            if not (peek() and take()[2]):
                raise ValueError("a parenthesis is open")
        elif m[9]:
            node = Node("leaf", leaf=Leaf((), m[7], None if m[10] == "*" else m[10], None if m[11] == "*" else m[11], m[9] == "["))
        else:
            words = tuple(re.findall(r"[^\W_]+", (m[8] if m[8] is not None else m[13] or "").lower()))
            node = Node("leaf", leaf=Leaf(words, m[7]))
        if (m := peek()) and m[3]:
            node = Node("boost", [node], boost=float(take()[4]))
        return node

    tree = either()
    if place < len(lexed):
        raise ValueError("more text than query")
    return tree


def leaves(node: Node) -> list[Leaf]:
    own = [node.leaf] if node.leaf else []
    return list(dict.fromkeys(own + [x for p in node.parts for x in leaves(p)]))


def _pattern(words: tuple[str, ...]) -> str:
    """Matches once at each place where the words stand one after the other; what follows the first is only looked at, so places may overlap."""
    first, rest = words[0], words[1:]
    return rf"(?<!{TOKEN}){first}" + (rf"(?={GAP}" + GAP.join(rest) + rf"(?!{TOKEN}))" if rest else rf"(?!{TOKEN})")


def search(docs: DataFrame, query: str, fields=FIELDS, keep=("doc_id",), where: Column | None = None) -> DataFrame:
    """(keep.., score) of the documents that match, by BM25; where: a MUST clause on other columns, pushed to the scan."""
    tree = parse(query)
    found = leaves(tree)
    counted = [x for x in found if x.words]
    names = {}
    for k, leaf in enumerate(counted):
        for f in [leaf.field] if leaf.field else fields:
            names[leaf, f] = f"_n{k}_{f}"
    own_fields = list(dict.fromkeys([*fields, *[f for _, f in names]]))
    count = lambda f, p: F.coalesce(F.regexp_count(f"_t_{f}", F.lit(p)), F.lit(0))
    columns = [count(f, f"{TOKEN}+").alias(f"_len_{f}") for f in own_fields]
    columns += [count(f, _pattern(leaf.words)).alias(n) for (leaf, f), n in names.items()]
    ranged = [x.field for x in found if not x.words and x.field]
    needed = list(dict.fromkeys([*keep, *ranged]))
    lowered = docs.select(*needed, *[F.lower(F.col(f)).alias(f"_t_{f}") for f in own_fields], *([where.alias("_ok")] if where is not None else []))
    # a few numbers a document, counted once for the statistics and the scores
    checkpoints(docs.sparkSession)
    counts = lowered.select(*needed, *columns, *(["_ok"] if where is not None else [])).checkpoint()
    # statistics of the whole corpus, one row
    stats = counts.agg(F.count("*").cast("double").alias("_docs"), *[(F.sum(f"_len_{f}") / F.count("*")).alias(f"_avg_{f}") for f in own_fields], *[F.sum((F.col(n) > 0).cast("long")).alias(f"_df{n}") for n in names.values()])
    scored = counts.where(F.col("_ok")) if where is not None else counts

    def leaf_of(leaf: Leaf) -> tuple[Column, Column]:
        if not leaf.words:
            column, ok = F.col(leaf.field), F.lit(True)
            if leaf.low is not None:
                ok &= (column >= int(leaf.low)) if leaf.inclusive else (column > int(leaf.low))
            if leaf.high is not None:
                ok &= (column <= int(leaf.high)) if leaf.inclusive else (column < int(leaf.high))
            return ok, F.lit(0.0)
        present, score = F.lit(False), F.lit(0.0)
        for f in [leaf.field] if leaf.field else fields:
            n = names[leaf, f]
            tf, df, docs_n = F.col(n).cast("double"), F.col(f"_df{n}"), F.col("_docs")
            idf = F.ln(1 + (docs_n - df + 0.5) / (df + 0.5))
            score += F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"_len_{f}") / F.col(f"_avg_{f}")))).otherwise(F.lit(0.0))
            present |= tf > 0
        return present, score

    def compiled(node: Node) -> tuple[Column, Column]:
        if node.kind == "leaf":
            return leaf_of(node.leaf)
        parts = [compiled(p) for p in node.parts]
        if node.kind == "boost":
            return parts[0][0], parts[0][1] * node.boost
        if node.kind == "not":
            return ~parts[0][0], F.lit(0.0)
        match, score = parts[0]
        for m, s in parts[1:]:
            match, score = (match & m if node.kind == "and" else match | m), score + s
        return match, score

    match, score = compiled(tree)
    return scored.crossJoin(F.broadcast(stats)).where(match).select(*keep, F.round(score, 6).alias("score"))


def top(hits: DataFrame, k: int = CANDIDATES, tie: str = "doc_id") -> DataFrame:
    return hits.orderBy(F.col("score").desc(), F.col(tie)).limit(k)


def postings(docs: DataFrame, fields=FIELDS) -> DataFrame:
    """(field, term, doc_id, tf, positions): the inverted index as a table."""
    per_field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("t")) for f in fields])).alias("x")
    tokens = docs.select("doc_id", per_field).select("doc_id", "x.field", F.posexplode("x.t").alias("pos", "term"))
    return tokens.groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def delete_by_term(index: DataFrame, field_name: str, term: str) -> DataFrame:
    """postings() without the documents that have a term in a field."""
    gone = index.where((F.col("field") == field_name) & (F.col("term") == term)).select("doc_id").distinct()
    return index.join(gone, "doc_id", "left_anti")


def add(index: DataFrame, docs: DataFrame, fields=FIELDS) -> DataFrame:
    """postings() with documents added; those of a doc_id that is there already replace the old ones."""
    return index.join(docs.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(postings(docs, fields).select(*index.columns))


def commit(index: DataFrame, path: str, buckets: int = 256) -> None:
    """Write an index by term bucket, so that a search reads the buckets of its terms; a new path a version."""
    index.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, words: list[str], buckets: int = 256) -> DataFrame:
    """The postings of some words of a committed index; other buckets are not read."""
    asked = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.pmod(F.xxhash64("w"), F.lit(buckets)).cast("int")).distinct().collect()]  # a number a word
    return spark.read.parquet(path).where(F.col("bucket").isin(asked) & F.col("term").isin(words)).drop("bucket")


def any_of(hits: DataFrame, lengths: DataFrame, fields=FIELDS) -> DataFrame:
    """(doc_id, score): BM25 of the documents that hold any of the words looked up.

    lengths: (doc_id, field, len) of every document and field.
    """
    n = lengths.select("doc_id").distinct().agg(F.count("*").cast("double").alias("_n"))
    means = lengths.groupBy("field").agg(F.sum("len").alias("_sum")).crossJoin(F.broadcast(n)).select(F.col("field").alias("_f"), (F.col("_sum") / F.col("_n")).alias("_avg"), "_n")
    df = hits.groupBy("field", "term").agg(F.count("*").cast("double").alias("_df"))
    rows = hits.where(F.col("field").isin(list(fields))).join(F.broadcast(df), ["field", "term"]).join(F.broadcast(means), F.col("field") == F.col("_f")).join(lengths, ["doc_id", "field"])  # a row a word, and a row a field
    tf = F.col("tf").cast("double")
    part = F.ln(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("_avg")))
    return rows.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))
