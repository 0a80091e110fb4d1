"""Hourly readings derived from an event table.

A meter stands for a building of thirty flats (``user_id div 30``), so the fleet grows with the
number of users while every meter keeps the same density. Volumes are whole cents over 8192: a
power of two keeps sums, medians and comparisons exact in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import time as T
from tidemark.plans.series import HOURLY, METER, Layout, core

FLATS_PER_BUILDING = 30
VOLUME_SCALE = 8192.0
SERIES_EPOCH = "2024-01-01"


def event_volume(cents: Column, keep: Column) -> Column:
    return F.sum(F.when(keep, cents)).cast("double") / F.lit(VOLUME_SCALE)


def meter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_meter_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_meter_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.floor(F.col("user_id") / FLATS_PER_BUILDING).cast("bigint").alias(METER),
        "ts",
        "event_id",
        "event_type",
        F.rint(F.col("value") * 100).cast("bigint").alias("cents"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def aggregate_hours(events: DataFrame, *keys: Column | str) -> DataFrame:
    """Channel volumes and temperatures per key; partial sums run before the shuffle."""
    kind, cents = F.col("event_type"), F.col("cents")
    return events.groupBy(*keys).agg(
        event_volume(cents, kind.isin("view", "click")).alias("xvs_m3"),
        event_volume(cents, kind.isin("purchase", "signup")).alias("gvs_m3"),
        event_volume(cents, (kind == "error") & (F.col("event_id") % 2 == 0)).alias("supply_m3"),
        event_volume(cents, (kind == "error") & (F.col("event_id") % 2 == 1)).alias("return_m3"),
        F.max("k").cast("double").alias("t1"),
        F.min("k").cast("double").alias("t2"),
        F.min("k").cast("double").alias("weather"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per meter and hour that saw an event."""
    events = meter_events(spark, sf_dir).withColumn("hour_ts", T.hour_floor(F.col("ts")))
    hours = aggregate_hours(events, METER, "hour_ts").withColumnRenamed("hour_ts", "ts")
    return hours.withColumn("weekday", F.weekday("ts") + 1)


def raw_texts(hours: DataFrame) -> DataFrame:
    """Readings as they are delivered: date and hour interval as text."""
    hour = F.hour("ts")
    return hours.select(
        METER,
        F.date_format(T.day_of(F.col("ts")), "dd.MM.yyyy").alias("date_raw"),
        F.concat(hour.cast("string"), F.lit("-"), (hour + 1).cast("string")).alias("hour_raw"),
        "supply_m3",
        "return_m3",
        "gvs_m3",
        "xvs_m3",
        "t1",
        "t2",
        "weather",
        "weekday",
    )


def inject_faults(grid: DataFrame) -> DataFrame:
    """A stuck and a dead house meter for two days in every fourth building."""
    day = F.datediff("day", F.lit(SERIES_EPOCH).cast("date")) + 1
    kind = F.pmod(F.col(METER), F.lit(4))
    return grid.withColumn(
        "gvs_m3",
        F.when((kind == 3) & day.between(10, 11), F.lit(0.5))
        .when((kind == 2) & day.between(20, 21), F.lit(0.0))
        .otherwise(F.col("gvs_m3")),
    )


def hourly_grid(spark: SparkSession, sf_dir: str, layout: Layout = HOURLY) -> DataFrame:
    """Gap-free grid of all meters with the injected faults."""
    return core(hourly_grid_parts(spark, sf_dir, layout), layout)


def hourly_grid_parts(spark: SparkSession, sf_dir: str, layout: Layout) -> DataFrame:
    from tidemark.operators.grid import hourly_parts

    return inject_faults(hourly_parts(readings(spark, sf_dir), layout))
