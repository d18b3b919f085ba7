"""Inverted-file vector search: centroids, assignment, probing, search, k-means.

Vectors live in buckets by nearest centroid. A query ranks the few centroids,
takes the best probes and reads only their buckets: with vectors stored by
bucket_id that is partition pruning. Centroids are a model of fixed size and are
broadcast; vectors are not moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekloom.functions.vectors import dot, is_nonzero, l2_normalize

PROBES, CANDIDATES = 4, 200
#: Centroids in one broadcast: some 60 MB at 384 dimensions.
CENTROID_ROWS = 20_000


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(bucket_id, centroid): the normalised mean of each label's vectors."""
    parts = vectors.where("embedding is not null").select(F.col(label).cast("int").alias("bucket_id"), F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("bucket_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = mean.groupBy("bucket_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))  # one entry a dimension
    return rows.select("bucket_id", l2_normalize(F.col("m")).alias("centroid"))


def assign(vectors: DataFrame, centers: DataFrame, most: int = CENTROID_ROWS) -> DataFrame:
    """vectors with bucket_id of the best centroid, the lowest id on ties; all-zero vectors are not indexed.

    Centroids are broadcast in parts of at most most rows, each against the best so far.
    """
    n = centers.count()
    usable = vectors.where(F.col("embedding").isNotNull() & is_nonzero(F.col("embedding"))).withColumn("_u", l2_normalize(F.col("embedding")))
    out = usable.withColumn("_best", F.struct(F.lit(-2.0).alias("s"), F.lit(-1).alias("b")))
    parts = max(1, -(-n // most))
    for k in range(parts):
        part = centers.where(F.pmod(F.col("bucket_id"), F.lit(parts)) == k) if parts > 1 else centers
        packed = part.agg(F.sort_array(F.collect_list(F.struct("bucket_id", "centroid"))).alias("_c"))
        scores = F.transform("_c", lambda c: F.struct((-F.round(dot(F.col("_u"), c["centroid"]), 9)).alias("d"), c["bucket_id"].alias("b")))
        out = out.crossJoin(F.broadcast(packed)).withColumn("_m", F.array_min(scores)).drop("_c")
        better = F.col("_m").isNotNull() & ((-F.col("_m.d") > F.col("_best.s")) | ((-F.col("_m.d") == F.col("_best.s")) & (F.col("_m.b") < F.col("_best.b"))))
        out = out.withColumn("_best", F.when(better, F.struct((-F.col("_m.d")).alias("s"), F.col("_m.b").alias("b"))).otherwise(F.col("_best"))).drop("_m")
    return out.withColumn("bucket_id", F.col("_best.b")).drop("_best", "_u")


def probes(centers: DataFrame, query: list[float], n: int = PROBES) -> DataFrame:
    """(bucket_id, sim) of the n best centroids, lowest id on ties."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return centers.select("bucket_id", F.round(dot(F.col("centroid"), q), 6).alias("sim")).orderBy(F.col("sim").desc(), "bucket_id").limit(n)


def search(indexed: DataFrame, bucket_ids: list[int] | None, query: list[float], k: int = CANDIDATES) -> DataFrame:
    """(vec_id, score): best k by dot product in the probed buckets (None: everywhere), the best of each id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = indexed if bucket_ids is None else indexed.where(F.col("bucket_id").isin(bucket_ids))
    scored = rows.select("vec_id", F.round(dot(F.col("embedding"), q), 6).alias("score"))
    return scored.groupBy("vec_id").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(k)


def merge_bucket(old: DataFrame, staging: DataFrame, key: str = "vec_id", order: str = "offset") -> DataFrame:
    """Staging replaces old rows of its ids; the last staged record of an id wins."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    new = staging.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", order)
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def train_centroids(vectors: DataFrame, k: int, seed: int = 7, rounds: int = 20) -> DataFrame:
    """Spherical k-means: (bucket_id, centroid)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.where("embedding is not null").select(array_to_vector(l2_normalize(F.col("embedding"))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds).fit(data)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]  # k rows of the model
    return vectors.sparkSession.createDataFrame(rows, "bucket_id int, centroid array<double>").withColumn("centroid", l2_normalize(F.col("centroid")))
