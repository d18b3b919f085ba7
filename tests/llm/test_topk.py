import math
import random

from pyspark.sql import functions as F

from seekloom.llm import topk


def brute(rows, k=10):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in usable if i % 100 == 0}:
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(5)
    rows = [(k, [r.choice([0.0, r.uniform(-1, 1)]) for _ in range(8)]) for k in range(350)]
    rows += [(400, None), (500, [None] * 8), (600, [float("nan")] * 8), (None, [1.0] * 8), (7, rows[7][1]), (900, [0.0] * 8), (901, []), (1000, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted(tuple(x) for x in topk.op2_topk(frame).collect())
    assert got == brute(rows)
    vectors = frame.select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    small = topk.search(vectors, F.col("vec_id") % 100 == 0, block=16, query_block=2)
    assert sorted(tuple(x) for x in small.collect()) == got


def test_ties_and_few_candidates(spark):
    frame = spark.createDataFrame([(k, [1.0, 0.0]) for k in (0, 3, 2, 1)], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in topk.op2_topk(frame).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    assert topk.op2_topk(frame.limit(0)).count() == 0


def test_repeated_candidates_take_a_rank_each(spark):
    rows = [(0, [1.0, 0.0])] * 2 + [(5, [3.0, 1.0])] * 3 + [(7, [2.0, 0.0])] * 40 + [(8, [1.0, 9.0])]
    got = topk.op2_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(k + 1, 5 if k < 3 else 7) for k in range(10)]


def test_scores_beyond_a_long_stay_at_its_ends(spark):
    rows = [(0, [1e15, 1e15, 1.0]), (1, [1e15, 1e15, 0.0]), (2, [-1e15, -1e15, 0.0]), (3, [0.0, 0.0, 2.0])]
    got = {r.vec_id: r.score for r in topk.op2_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 2**63 - 1, 2: -(2**63), 3: 1024 * 2048}
