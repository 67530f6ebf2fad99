"""Helpers shared by the corpus operators: reading tables, the shared work folder, written intermediate tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import spread

#: Rows of an Arrow batch.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a data folder.

    Python workers on this machine are told where the package is, should the session not have been started beside it;
    on a cluster it is installed or sent with ``--py-files``. Rows go to Python in batches of ARROW_ROWS, since they hold whole texts.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's own default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    env, home = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [home, env.get("PYTHONPATH")]))
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset (local tests), a temporary
    folder takes its place, which is right only because driver and executors are then one process.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tessera.work.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.tessera.work.dir", root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, merge: int = 1) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    With ``merge`` k the rows are dealt out anew before they are written, so that a file holds those of k shuffle partitions.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    if merge > 1:
        df = df.repartition(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // merge))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """``materialize`` for tables of a few numbers a row, in few files."""
    return materialize(df, "kept", merge=32)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a work path that no later result reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of what is directly below a path; none if it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def drop(*tables: DataFrame) -> None:
    """Delete written tables that no later result reads."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            discard(t.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what has been written and is no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
