"""Event stream to hourly readings, closing an hour once the watermark has passed it.

Two jobs in a row. The first sorts arriving events into those in time and those that are late,
which are kept in a table of their own instead of vanishing. The second takes each event in time
once, whatever number of times it was delivered, and sums the hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import time as T
from tidemark.plans.series import METER
from tidemark.sources import events as E
from tidemark.streaming.job import read_batches, read_output, run_available, run_batches, write_batch

LATENESS = "2 hours"


def hourly_stream(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Hourly channel sums per meter of a stream of meter events with an event time ``ts``.

    Watermarks need an instant, so wall-clock times are read as UTC. An event counts once however
    often it is delivered within ``lateness``. Events that come more than ``lateness`` after the
    newest one are dropped, as an hour is emitted only once; :func:`run_hours` lists them.
    """
    timed = events.withColumn("ts", T.utc_instant(F.col("ts"))).withWatermark("ts", lateness)
    once = timed.dropDuplicatesWithinWatermark(["event_id"])
    hours = E.aggregate_hours(once, METER, F.window("ts", "1 hour").alias("w"))
    start = F.unix_seconds("w.start") / 3600
    return hours.select(METER, T.hour_from_number(start).alias("ts"), *hours.columns[2:])


def _paths(folder: str) -> dict[str, str]:
    return {name: f"{folder}/{name}" for name in ("sort", "in-time", "late", "seen", "hours")}


def run_hours(
    spark: SparkSession, path: str, folder: str, schema: StructType, lateness: str = LATENESS
) -> None:
    """Take in the raw events that have arrived below ``path`` since the last run.

    An event is late if it is older by ``lateness`` or more than the newest event of all earlier
    batches. That is the watermark of the second job or later, so that job drops nothing more.
    """
    at = _paths(folder)

    def sort(batch: DataFrame, number: int) -> None:
        seen = read_batches(spark, at["seen"], StructType.fromDDL("newest timestamp_ntz"))
        newest = seen.where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        limit = T.wall_clock(newest) - F.expr(f"INTERVAL {lateness}")
        judged = batch.withColumn("_late", F.coalesce(F.col("ts") <= limit, F.lit(False)))
        write_batch(judged.where("_late").drop("_late"), at["late"], number)
        write_batch(judged.where("NOT _late").drop("_late"), at["in-time"], number)
        latest = batch.agg(F.max("ts").alias("newest"))
        if newest is not None:
            latest = latest.select(F.greatest("newest", T.wall_clock(newest)).alias("newest"))
        write_batch(latest, at["seen"], number)

    run_batches(spark.readStream.schema(schema).parquet(path), at["sort"], sort)
    in_time = spark.readStream.schema(schema).parquet(f"{at['in-time']}/batch=*")
    run_available(hourly_stream(E.as_meter_events(in_time), lateness), at["hours"])


def closed_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Hours that the job has closed so far."""
    return read_output(spark, _paths(folder)["hours"])


def late_events(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Events that came too late, with the ``batch`` that brought them."""
    return read_batches(spark, _paths(folder)["late"], schema)
