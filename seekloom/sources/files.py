"""File sources and sinks: zip dumps, edge text, tar.gz blobs, vector buckets, blobs."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Archives below so many bytes hold nothing.
LEAST_ARCHIVE = 100
LINES_PER_BATCH = 10_000


def zip_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, line, value): the lines of all .txt members of the zip files in a folder, members streamed."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    n = 0
                    for member in sorted(x for x in archive.namelist() if x.endswith(".txt")):
                        rows = []
                        with io.TextIOWrapper(archive.open(member), "utf-8", "replace", newline="\n") as text:
                            for value in text:
                                rows.append((path, n, value.rstrip("\r\n")))
                                n += 1
                                if len(rows) >= LINES_PER_BATCH:
                                    yield pd.DataFrame(rows, columns=["path", "line", "value"])
                                    rows = []
                        yield pd.DataFrame(rows, columns=["path", "line", "value"]).astype({"line": "int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")
    return files.mapInPandas(run, "path string, line long, value string")


def edge_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(value): the lines of every file of a folder, for graph.parse_edges()."""
    return spark.read.text(folder)


def edge_stream(spark: SparkSession, folder: str, done: str | None = None) -> DataFrame:
    """The same as a stream; consumed files are archived in done."""
    reader = spark.readStream.format("text").schema("value string")
    if done:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", done)
    return reader.load(folder)


def tar_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """(id, value): .zst members with flag 1, .txt members with flag 0; the id is the numeric file stem."""

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                    for member in archive:
                        stem, _, kind = member.name.rpartition("/")[2].rpartition(".")
                        if member.isfile() and stem.isdigit() and kind in ("zst", "txt"):
                            rows.append((int(stem), bytes([kind == "zst"]) + archive.extractfile(member).read()))
                yield pd.DataFrame(rows, columns=["id", "value"]).astype({"id": "int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(folder)
    return files.where(F.col("length") >= LEAST_ARCHIVE).select("content").mapInPandas(run, "id long, value binary")


def write_buckets(indexed: DataFrame, path: str, mode: str = "append") -> None:
    """Vectors by bucket_id, so that a search of few probes reads few folders."""
    indexed.repartition("bucket_id").write.partitionBy("bucket_id").mode(mode).parquet(path)


def read_buckets(spark: SparkSession, path: str, bucket_ids: list[int]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("bucket_id").isin(bucket_ids))


def write_lines(lines: DataFrame, path: str) -> None:
    """Dump lines as compressed text (the peers' export form)."""
    lines.select("value").write.mode("overwrite").option("compression", "gzip").text(path)
