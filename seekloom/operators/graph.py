"""Link graph: edge import, dense node ids, degrees, PageRank (batch and incremental).

Edges joined with out-degrees are written once to the shared folder; each
iteration is one join and one partial aggregation by destination. Lineage is cut
by checkpoint() every few rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekloom.session import checkpoints

DAMPING, EPSILON, MOST_ROUNDS, CUT_EVERY = 0.85, 1e-6, 100, 5


def parse_edges(lines: DataFrame) -> DataFrame:
    """(value) lines "from->to", split at the first arrow; others are skipped; self loops go."""
    at = F.instr("value", "->")
    src, dst = F.trim(F.substring(F.col("value"), F.lit(1), at - 1)), F.trim(F.substring(F.col("value"), at + 2, F.length("value")))
    return lines.where(at > 0).select(src.alias("src"), dst.alias("dst")).where("src != dst").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def assign_ids(found: DataFrame, known: DataFrame | None = None, buckets: int = 256) -> DataFrame:
    """(node) -> (node, node_id): dense ids in node order, continuing after the known ones.

    Two levels: ids within each bucket by its own window, plus the sizes of the
    buckets before, so that no window spans all nodes.
    """
    start = 0
    if known is not None:
        found = found.join(known.select("node"), "node", "left_anti")
        start = known.agg(F.coalesce(F.max("node_id") + 1, F.lit(0))).first()[0]
    checkpoints(found.sparkSession)
    # saved once: both branches below see one dealing of the nodes, also after a lost executor
    parts = found.repartitionByRange(buckets, "node").withColumn("_p", F.spark_partition_id()).checkpoint()
    sizes = parts.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_p").orderBy("node")
    new = parts.join(F.broadcast(before), F.col("_p") == F.col("_q")).select("node", (F.row_number().over(w) - 1 + F.col("_before") + F.lit(start)).cast("long").alias("node_id"))
    return new if known is None else known.select("node", "node_id").unionByName(new)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree)."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return both.groupBy("x.node").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def csr_offsets(degree: DataFrame, width: int = 8, block: int = 1 << 16) -> DataFrame:
    """(node_id, in_degree) -> and the byte offset of each node's in-neighbours.

    Two levels as in assign_ids(): sums within blocks of ids, plus the sums of the blocks before.
    """
    blocks = degree.withColumn("_p", F.floor(F.col("node_id") / block).cast("long"))
    sums = blocks.groupBy("_p").agg(F.sum("in_degree").alias("n"))
    before = sums.select(F.col("_p").alias("_q"), F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a block
    w = Window.partitionBy("_p").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.join(before, F.col("_p") == F.col("_q")).withColumn("offset", ((F.coalesce(F.sum("in_degree").over(w), F.lit(0)) + F.col("_before")) * width).cast("long"))
    return out.select(*degree.columns, "offset")


def pagerank(edges: DataFrame, rounds: int | None = None, tol: float = EPSILON, damping: float = DAMPING, start: DataFrame | None = None) -> DataFrame:
    """(src, dst) -> (node, score). rounds: exactly so many; None: until no score moves by tol.

    start: scores of an earlier run, for the nodes that it has (incremental).
    """
    spark = edges.sparkSession
    checkpoints(spark)
    edges = edges.distinct()
    out = edges.groupBy(F.col("src").alias("_s")).agg(F.count("*").alias("_out"))
    links = edges.join(out, F.col("src") == F.col("_s")).select("src", "dst", "_out").checkpoint()
    every = nodes(edges).join(out, F.col("node") == F.col("_s"), "left").select("node", F.col("_out").isNull().alias("dangling")).checkpoint()
    n = every.count()
    if not n:
        return every.select("node", F.lit(0.0).alias("score"))
    scores = every.select("node", "dangling", F.lit(1.0 / n).alias("score"))
    if start is not None:
        old = start.select(F.col("node").alias("_n"), F.col("score").alias("_old"))
        scores = every.join(old, F.col("node") == F.col("_n"), "left").select("node", "dangling", F.coalesce("_old", F.lit(1.0 / n)).alias("score"))
    for k in range(rounds or MOST_ROUNDS):
        lost = scores.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0)).alias("_lost"))
        given = links.join(scores, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("score") / F.col("_out")).alias("_in"))
        new = scores.select("node", "dangling", F.col("score").alias("_was")).join(given, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(lost))
        new = new.select("node", "dangling", (F.lit((1 - damping) / n) + damping * F.col("_lost") / n + damping * F.coalesce("_in", F.lit(0.0))).alias("score"), "_was")
        if (k + 1) % CUT_EVERY == 0:
            new = new.checkpoint()
            # one look at convergence per cut; a few more rounds only come closer
            if rounds is None and new.agg(F.max(F.abs(F.col("score") - F.col("_was")))).first()[0] < tol:
                scores = new.drop("_was")
                break
        scores = new.drop("_was")
    return scores.select("node", "score")
