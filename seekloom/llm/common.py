"""Shared pieces: the words of a text, and tables in the folder all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekloom.session import shared_folder

#: A word is a run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of one batch between the JVM and Python; Spark's own setting of 64 MB costs several times that in either.
BATCH_BYTES = 4_000_000
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df, of a session whose Arrow batches hold BATCH_BYTES at most, so that long texts do not add up in one."""
    spark = df.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCHES)) > BATCH_BYTES:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir), with its scheme, so that Spark and Arrow mean the same store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/seekloom/{name}-{uuid.uuid4().hex}"


def few(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df in partitions that follow a known number of rows, eight at least: small tables are not dealt into hundreds of files."""
    return df.coalesce(max(8, -(-rows // each)))


def save(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    The table outlives any executor, so a lost one costs its running tasks only.
    """
    return save_at(df, name, codec)[0]


def save_at(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table written by save_at once no plan reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_of(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo modulus; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus
