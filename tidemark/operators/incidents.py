"""Merging consecutive anomalous hours of one cause into incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import time as T
from tidemark.operators.detect import lookup_text
from tidemark.params import CAUSE_LABEL, DEFAULTS, Params
from tidemark.plans.series import HOURLY, METER, Layout, last_seen, over_series, window

INCIDENT_COLUMNS = (
    METER,
    "start",
    "end",
    "duration_h",
    "cause_en",
    "cause_ru",
    "confidence",
    "delta_m3_sum",
    "delta_m3_mean",
    "worst_z",
    "hours",
)


def incident_islands(
    decisions: DataFrame, params: Params = DEFAULTS, layout: Layout = HOURLY
) -> DataFrame:
    """Add ``island_start``: where the current stretch of equal flag and cause began.

    A change of flag or cause or a gap in time starts a new island. The start hour identifies the
    island, so no running number over the whole series is needed.
    """
    layout = layout.needing(before=1)

    def body(parts: DataFrame) -> DataFrame:
        order = window(layout)
        hour = T.hour_number(F.col("ts"))
        compared = parts.select(
            "*",
            F.lag("is_anomaly").over(order).alias("_flag"),
            F.lag("top_cause").over(order).alias("_cause"),
            F.lag(hour).over(order).alias("_hour"),
        )
        same = (
            (F.col("is_anomaly") == F.col("_flag"))
            & (F.col("top_cause") == F.col("_cause"))
            & (hour - F.col("_hour") <= params.incident_gap_h)
        )
        starts = compared.select(
            *parts.columns, F.when(~F.coalesce(same, F.lit(False)), F.col("ts")).alias("_start")
        )
        return last_seen(starts, {"island_start": "_start"}, layout).drop("_start")

    return over_series(decisions, layout, body)


def island_incidents(islands: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One row per anomalous island of at least the minimum duration."""
    merged = (
        islands.where("is_anomaly")
        .groupBy(METER, "island_start", F.col("top_cause").alias("cause_en"))
        .agg(
            F.min("ts").alias("start"),
            F.max("ts").alias("end"),
            F.count(F.lit(1)).alias("hours"),
            F.median("top_cause_prob").alias("confidence"),
            F.sum("delta_m3").alias("delta_m3_sum"),
            F.avg("delta_m3").alias("delta_m3_mean"),
            F.max(F.abs("z_delta")).alias("worst_z"),
        )
        .where(F.col("hours") >= params.min_duration_h)
    )
    return merged.select(
        METER,
        "start",
        "end",
        F.col("hours").alias("duration_h"),
        "cause_en",
        lookup_text(F.col("cause_en"), CAUSE_LABEL, F.col("cause_en")).alias("cause_ru"),
        N.round_half_even(F.col("confidence"), 3).alias("confidence"),
        N.round_half_even(F.col("delta_m3_sum"), 4).alias("delta_m3_sum"),
        N.round_half_even(F.col("delta_m3_mean"), 4).alias("delta_m3_mean"),
        N.round_half_even(F.col("worst_z"), 2).alias("worst_z"),
        "hours",
    )


def incidents(
    decisions: DataFrame, params: Params = DEFAULTS, layout: Layout = HOURLY
) -> DataFrame:
    """Incidents of post-processed decisions; an empty table if nothing lasted long enough."""
    return island_incidents(incident_islands(decisions, params, layout), params)
