"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

A dimension is a term, a vector's non-zero integer component a weighted posting.
Candidates are dealt into blocks of at most about BLOCK rows, queries into blocks
of QUERY_BLOCK; every pair of blocks is one task-sized group. There the block's
postings are built once per term, and each query scatters its weights times the
postings of its terms into a dense score array of the block. A partition picks
the k best of the block, and the blocks' picks are merged per query.

Defined cases: vectors that are null or hold a null or non-finite component, and
rows with a null id, take no part; components beyond the shorter vector count as
0; a query's own row is every row of its id; equal query rows are one query,
equal candidate rows are a candidate each and take a rank each; fewer than k
candidates give as many ranks; quantized components and scores beyond the range
of a long stay at its ends; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

SCALE = 1024
K = 10
QUERY_MODULUS = 100
BLOCK = 8_192
#: Candidates are copied once for each block of queries, so these are large; scores are kept for SCORED queries at a time.
QUERY_BLOCK = 8_192
SCORED = 64
_LONG = (-(2**63), 2**63 - 1)


def quantized(column: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as array<long>; null for unusable vectors."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(column.isNotNull() & fine, F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def block_scores(candidates: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Scores of every query over one block of candidates, term at a time."""
    terms = min(candidates.shape[1], queries.shape[1])
    largest = lambda m: max((abs(int(x)) for x in (m.max(), m.min())), default=0) if m.size else 0
    if terms * largest(candidates) * largest(queries) > _LONG[1]:
        # beyond 64 bits: whole numbers of Python, cut off at the ends
        exact = queries[:, :terms].astype(object) @ candidates[:, :terms].astype(object).T
        return np.clip(exact, *_LONG).astype(np.int64)
    postings = []
    for t in range(terms):
        rows = np.flatnonzero(candidates[:, t])
        postings.append((rows, candidates[rows, t]))
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for q, row in enumerate(scores):
        for t in np.flatnonzero(queries[q, :terms]):
            rows, weights = postings[t]
            row[rows] += queries[q, t] * weights
    return scores


def _matrix(vectors) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def best(ids: np.ndarray, own: int, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, the query's own id left out."""
    allowed = np.flatnonzero(ids != own)
    s = scores[allowed]
    if len(s) > k:
        limit = np.partition(s, len(s) - k)[len(s) - k]
        sure, tied = allowed[s > limit], allowed[s == limit]
        tied = tied[np.argsort(ids[tied], kind="stable")][: k - len(sure)]
        allowed = np.concatenate([sure, tied])
    return allowed[np.lexsort((ids[allowed], -scores[allowed]))]


def search(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(vec_id, v array<long>) -> (query_id, rank, vec_id, score) of the rows that is_query holds for."""
    # equal rows are counted once and counted out again at the end: no more than k of them can have a rank
    usable = save(vectors.where("vec_id is not null and v is not null").groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("copies")), "vectors")
    queries = usable.where(is_query).drop("copies")
    n, n_queries = usable.count(), queries.count()
    # a power of the number of rows does not enter: blocks have a fixed size, their number grows
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    place = lambda parts, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(parts)).cast("int")
    left = usable.withColumn("block", place(blocks, 1)).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumn("qblock", place(query_blocks, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def pair(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "qv": [], "vec_id": [], "score": [], "copies": []}
        if len(rows) and len(asked):
            ids, copies, matrix = rows["vec_id"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64), _matrix(rows["v"].tolist())
            for at in range(0, len(asked), SCORED):
                part = asked.iloc[at : at + SCORED]
                scores = block_scores(matrix, _matrix(part["v"].tolist()))
                for q, own, key in zip(range(len(part)), part["vec_id"], part["key"], strict=True):
                    places = best(ids, own, scores[q], k)
                    out["query_id"] += [own] * len(places)
                    out["qv"] += [key] * len(places)
                    out["vec_id"] += ids[places].tolist()
                    out["score"] += scores[q][places].tolist()
                    out["copies"] += copies[places].tolist()
        return pd.DataFrame({c: pd.Series(v, dtype="int64") for c, v in out.items()})

    right = right.withColumn("key", F.xxhash64("v"))
    picks = left.groupBy("block", "qblock").cogroup(right.groupBy("block", "qblock")).applyInPandas(pair, "query_id long, qv long, vec_id long, score long, copies long")
    picks = picks.select("query_id", "qv", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"))
    order = Window.partitionBy("query_id", "qv").orderBy(F.col("score").desc(), F.col("vec_id"))
    return picks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(embeddings: DataFrame) -> DataFrame:
    """Contract query: query_id, rank, vec_id, score."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding")).alias("v"))
    return search(vectors, F.pmod(F.col("vec_id"), F.lit(QUERY_MODULUS)) == 0)


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.v AS q, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
