"""Connected components as alternating stars over an edge table, nothing on the driver.

Each round hangs every node on the smallest node it knows; groups are reduced by
partial aggregation before the shuffle. The joins back on a hot centre are against
one row a node: broadcast while these are few, else plain equi joins whose result
goes through no aggregate in the same stage, which adaptive execution can split.
Every round is a table in the shared folder, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, remove, save_at


#: One row a node (16 bytes) is broadcast up to so many edges (each has two nodes at most).
BROADCAST_EDGES = 500_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) of any ordered type -> (node, root): root is the smallest node reachable.

    Only nodes with an edge to another node appear. Nulls are ignored.
    """
    spark = edges.sparkSession
    clean = edges.select("a", "b").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, path = save_at(clean, "cc")
    n = current.count()
    seen = None
    for _ in range(most_rounds):
        held = F.broadcast if n <= BROADCAST_EDGES else lambda x: x
        # large star: neighbours above a node hang on the smallest of its neighbourhood
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(held(smallest), F.col("a") == F.col("n")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, large_path = save_at(few(large, n), "cc")
        # small star: a node and its smaller neighbours hang on the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        moved = large.join(held(low), F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        new, new_path = save_at(few(moved, n), "cc")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        remove(spark, path)
        remove(spark, large_path)
        current, path = new, new_path
        n = state[0]
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
