"""Session defaults that every entry point shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def local_session(cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and bench.py; a cluster passes its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seekloom")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data set directory, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share (spark.checkpoint.dir). A temporary one only in local mode, where there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="seekloom-")
    return _own[app]


def checkpoints(spark: SparkSession) -> None:
    """Name the shared folder for checkpoint() where the session has not."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
