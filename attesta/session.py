"""Session defaults and table access."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cores: str = "8", app: str = "attesta", memory: str = "12g") -> SparkSession:
    """A local session for tests and benches. On a cluster, use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


# Tables whose rows are long texts: scanning them is bound by the CPU, not by reading.
TEXT_TABLES = ("documents", "pages", "conversations")


#: Rows of a text table that one task gets.
TASK_ROWS = 2048


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores, and to so many tasks that none gets much more than ``TASK_ROWS`` rows.

    The number of splits does not tell how many tasks get rows: a Parquet file is only cut between its row groups, and
    a split without the middle of one is empty. The rows are counted from the files' footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // TASK_ROWS)))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(table) if name in TEXT_TABLES else table


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's checkpoint folder.

    Only when none is configured, as in tests, a local one is set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="attesta-", dir=os.environ.get("TMPDIR"))
    spark.sparkContext.setCheckpointDir(folder)
    return folder
