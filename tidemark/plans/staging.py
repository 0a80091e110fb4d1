"""Cutting lineage, and the shared folder that intermediate tables live in.

The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local session without that
setting gets a folder of its own; on a cluster a machine-local folder would not survive the loss
of an executor, so the setting is required there.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if folder:
        return folder.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Materialise a frame that several jobs read and forget how it was computed."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`stage`, but as a parquet table: readers prune columns and push filters down."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.staged_at = path
    return stored


def drop_table(stored: DataFrame) -> None:
    """Delete a table of :func:`stage_table` that nothing will read any more."""
    sc = stored.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(stored.staged_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that stored tables have made superfluous.

    Spark deletes them when the driver collects its garbage, which an idle heap does seldom.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
