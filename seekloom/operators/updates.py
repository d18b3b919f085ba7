"""Resumable rewrites of stored documents, and their progress as merged id ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_ranges(ranges: DataFrame, key: str = "update_id") -> DataFrame:
    """(key, start, end) inclusive -> overlapping or adjacent ones merged (gaps and islands)."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(F.col("start") <= reach + 1, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def first_unprocessed(ranges: DataFrame, ceilings: DataFrame, key: str = "update_id") -> DataFrame:
    """(key, ceiling) -> the first id in [0, ceiling] that no range covers, null when finished."""
    head = merge_ranges(ranges, key).where("start <= 0").groupBy(key).agg((F.max("end") + 1).alias("_next"))
    out = ceilings.join(head, key, "left").withColumn("next_id", F.coalesce("_next", F.lit(0)))
    return out.select(key, "ceiling", F.when(F.col("next_id") <= F.col("ceiling"), F.col("next_id")).alias("next_id"))


def apply_updates(docs: DataFrame, updates: list[Callable[[pd.DataFrame], pd.Series]], schema=None) -> DataFrame:
    """Run row updates in order; each changes its batch in place and returns unchanged, modified or deleted per row.

    Adds action; a deleted row is kept with its action so that every store can drop it.
    """
    schema = schema or docs.withColumn("action", F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            action = pd.Series("unchanged", index=batch.index)
            for update in updates:
                live = action != "deleted"
                part = batch[live].copy()
                said = update(part)
                batch.loc[live, part.columns] = part
                action[live] = said.where(said != "unchanged", action[live])
            yield batch.assign(action=action)

    return docs.mapInPandas(run, schema)


def next_batch(docs: DataFrame, progress: DataFrame, update_id: str, size: int, key: str = "doc_id") -> DataFrame:
    """The next rows by id that an update has not covered, below its ceiling."""
    row = progress.where(F.col("update_id") == update_id).first()
    if row is None or row.next_id is None:
        return docs.limit(0)
    return docs.where((F.col(key) >= row.next_id) & (F.col(key) <= row.ceiling)).orderBy(key).limit(size)


def save_progress(progress: DataFrame, done: DataFrame, path: str, key: str = "update_id") -> DataFrame:
    """Merge newly done ranges (key, start, end) into the saved ones and write them to path as a new version; returns what is saved.

    Versions are folders numbered upwards; the last complete one counts, so a
    killed job resumes from the last save.
    """
    spark = progress.sparkSession
    merged = merge_ranges(progress.select(key, "start", "end").unionByName(done.select(key, "start", "end")), key)
    version = _versions(spark, path)[-1:] or [-1]
    merged.write.parquet(f"{path}/v{version[0] + 1}")
    return load_progress(spark, path, merged.schema)


def _versions(spark, path: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath() for s in files.listStatus(root)]
    return sorted(int(p.getName()[1:]) for p in names if p.getName()[1:].isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def load_progress(spark, path: str, schema) -> DataFrame:
    versions = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v{versions[-1]}") if versions else spark.createDataFrame([], schema)
