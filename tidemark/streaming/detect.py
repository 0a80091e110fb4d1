"""Scoring hours as they arrive, each against the baseline that was valid at that hour.

A baseline is published as a version that holds from an hour on, until the next one. Versions can
be published while the job runs: every batch reads those that exist then. No state is kept, as a
decision depends on the hour and its baseline slot only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import time as T
from tidemark.operators import detect as D
from tidemark.operators.baseline import STATISTICS
from tidemark.params import DEFAULTS, Params
from tidemark.plans.series import METER
from tidemark.streaming.job import output_path, read_batches, run_batches, write_batch

SIGMAS = ("global_sigma_delta", "global_sigma_ratio")


def publish_baseline(baseline: DataFrame, path: str, valid_from: str) -> None:
    """Add a version: the baseline of its meters from the hour ``valid_from`` on.

    Publishing for the same hour again replaces that version.
    """
    slots = baseline.select(METER, "how", *STATISTICS, *SIGMAS)
    since = valid_from.replace(":", "").replace(" ", "T")
    slots.withColumn("valid_from", F.lit(valid_from).cast("timestamp_ntz")).write.mode(
        "overwrite"
    ).parquet(f"{path}/since={since}")


def baseline_versions(spark: SparkSession, path: str) -> DataFrame:
    """All slots with the hours they are valid: ``valid_from`` and before ``valid_to``.

    A meter's version ends where its next one begins; the last has no end.
    """
    slots = spark.read.parquet(path).drop("since")
    versions = slots.select(METER, "valid_from").distinct()
    following = F.lead("valid_from").over(Window.partitionBy(METER).orderBy("valid_from"))
    return slots.join(versions.withColumn("valid_to", following), [METER, "valid_from"])


def run_scoring(
    spark: SparkSession, path: str, baselines: str, folder: str, params: Params = DEFAULTS
) -> None:
    """Score the processed hours that have arrived below ``path`` since the last run.

    Hours before a meter's first version have no z-scores.
    """
    schema = spark.read.parquet(path).schema

    def step(batch: DataFrame, number: int) -> None:
        # Only versions that reach into the batch's hours take part in the join.
        low, high = batch.agg(F.min("ts"), F.max("ts")).first()
        versions = baseline_versions(spark, baselines).where(
            (F.col("valid_from") <= T.wall_clock(high))
            & F.coalesce(F.col("valid_to") > T.wall_clock(low), F.lit(True))
        )
        write_batch(D.detect_hours(batch, versions, params), output_path(folder), number)

    run_batches(spark.readStream.schema(schema).parquet(path), folder, step)


def scored_hours(spark: SparkSession, folder: str) -> DataFrame:
    """The decisions so far."""
    schema = spark.read.parquet(output_path(folder)).drop("batch").schema
    return read_batches(spark, output_path(folder), schema).drop("batch")
