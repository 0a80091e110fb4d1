"""Running a stream over what has arrived, so that it can be stopped and resumed.

A job owns a folder: its checkpoint (offsets, watermark, state) and its output lie below it. A
later run with the same folder continues where the last one ended and reads nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.sources.readings import read_optional

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, on disk, instead of the Java heap."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def output_path(folder: str) -> str:
    return f"{folder}/output"


def run_available(stream: DataFrame, folder: str) -> None:
    """Process everything that has arrived and append the results to the job's output."""
    with rocksdb_state(stream.sparkSession):
        job = (
            stream.writeStream.outputMode("append")
            .format("parquet")
            .option("path", output_path(folder))
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    job.awaitTermination()


def run_batches(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None]) -> None:
    """Process everything that has arrived, batch by batch.

    A batch that is repeated after a failure has the same number and rows: ``step`` replaces what
    it wrote before (:func:`write_batch`).
    """
    job = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()


def write_batch(df: DataFrame, table: str, batch: int) -> None:
    """Store a batch's rows as the partition ``batch`` of a table."""
    df.write.mode("overwrite").parquet(f"{table}/batch={batch}")


def read_batches(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """All batches written so far, with their number; none yet, no rows."""
    return read_optional(spark, table, StructType([*schema.fields, StructField("batch", LongType())]))


def read_output(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(output_path(folder))
