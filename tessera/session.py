"""Spark sessions for local use, and the package's place for Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, with as many shuffle partitions as cores."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    reach_package(spark)
    return spark


#: Rows of an Arrow batch, which holds whole texts.
ARROW_ROWS = 1000


def reach_package(spark: SparkSession) -> None:
    """Tell this machine's Python workers where the package is; on a cluster it is installed or sent with --py-files. Texts go to them in small batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's own default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    env, home = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [home, env.get("PYTHONPATH")]))


#: Bytes of a file that are worth a task of their own.
SPREAD_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` as it is, or dealt over all cores where its files give fewer tasks than there are cores though they are large enough.

    A file of one row group can't be split by the reader. Large inputs have many files and are never dealt anew.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    worth = min(cores, size // SPREAD_BYTES)
    return df.repartition(worth) if size <= cores << 28 and 1 < worth and df.rdd.getNumPartitions() < worth else df
