"""Feature tables for forecasting: labels, calendar terms, lags and rolling statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tidemark.functions import numeric as N
from tidemark.functions import time as T
from tidemark.operators.detect import QUALITY_FLAGS
from tidemark.operators.grid import with_series_bounds
from tidemark.params import DEFAULTS, Params
from tidemark.plans.series import DAILY, HOURLY, METER, Layout, over, over_series, window

HOURLY_BASES = ("delta_m3", "ratio", "rel_diff", *QUALITY_FLAGS)
DAILY_BASES = (
    "itp_xvs_m3",
    "odpu_gvs_m3",
    "delta_m3_sum",
    "delta_m3_mean",
    "ratio_mean",
    "rel_diff_mean",
    "bad_hours_share",
    "day_idx",
    "week_sin",
    "week_cos",
)

# Rolling statistics by the name they get in a column.
AGGREGATES = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}

# Numeric and boolean columns of the processed table that models may use, in order.
HOURLY_RAW_FEATURES = (
    "hour_idx",
    "supply_m3",
    "return_m3",
    "gvs_m3",
    "xvs_m3",
    "t1",
    "t2",
    "weather",
    "weekday",
    "odpu_proxy_net",
    "rel_diff",
    "diff_m3",
    "flag_over10",
    *[
        f"{prefix}_{suffix}"
        for prefix in ("itp_xvs", "odpu_gvs")
        for suffix in ("zero", "zero_run", "zero_anomaly", "flat", "flat_run", "flat_anomaly", "spike")
    ],
    "delta_m3",
    "ratio",
    "dow",
    "hour",
    "how",
)
DAILY_RAW_FEATURES = (
    "itp_xvs_m3",
    "odpu_gvs_m3",
    "delta_m3_sum",
    "delta_m3_mean",
    "ratio_mean",
    "rel_diff_mean",
    "hours",
    "bad_hours",
    "dow",
    "bad_hours_share",
    "day_idx",
    "dow_cat",
    "week_sin",
    "week_cos",
)


# --------------------------------------------------------------------------- labels and base


def label_join(hours: DataFrame, decisions: DataFrame) -> DataFrame:
    """``label`` from final decisions; hours without a decision are negative."""
    known = decisions.select(METER, "ts", "is_anomaly_final")
    return hours.join(known, [METER, "ts"], "left").withColumn(
        "label", F.coalesce("is_anomaly_final", F.lit(False))
    )


def label_match_stats(labelled: DataFrame) -> DataFrame:
    """How many hours found a decision, and how many labels are positive."""
    return labelled.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("is_anomaly_final").alias("n_matched"),
        F.count_if("label").alias("n_ones"),
    )


def flow_features(processed: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Unclipped difference, ratio and relative difference (overwriting the clipped one)."""
    xvs, gvs = F.col("xvs_m3"), F.col("gvs_m3")
    return processed.withColumns(
        {
            "delta_m3": xvs - gvs,
            "ratio": N.finite(gvs / N.at_least(xvs, params.eps)),
            "rel_diff": N.relative_difference(gvs, xvs, params.eps),
        }
    )


def calendar_features(df: DataFrame) -> DataFrame:
    """Weekday (Monday 0), hour, and hour of the week."""
    dow, hour = T.monday_weekday(F.col("ts")), F.hour("ts")
    return df.withColumns({"dow": dow, "hour": hour, "how": dow * 24 + hour})


def hourly_base(
    processed: DataFrame,
    decisions: DataFrame | None = None,
    params: Params = DEFAULTS,
) -> DataFrame:
    """The hourly table with flows, label and calendar.

    Final decisions label the hours: those of the rows themselves, or else of a table of
    decisions. Without any, an hour over the relative limit is positive.
    """
    flows = flow_features(processed, params)
    usable = decisions is not None and "is_anomaly_final" in decisions.columns
    if params.use_online_labels and "is_anomaly_final" in flows.columns:
        labelled = flows.withColumn("label", F.coalesce("is_anomaly_final", F.lit(False)))
    elif params.use_online_labels and usable:
        labelled = label_join(flows, decisions)
    else:
        over = F.col("rel_diff") > params.rel_diff_limit
        labelled = flows.withColumn("label", F.coalesce(over, F.lit(False)))
    return calendar_features(labelled)


# --------------------------------------------------------------------------- lags and rolling


def lag_and_rolling(
    df: DataFrame,
    bases: tuple[str, ...],
    lags: tuple[int, ...],
    windows: tuple[int, ...],
    unit: str,
    layout: Layout,
    *,
    differences: bool = False,
) -> DataFrame:
    """All lags and rolling statistics in one pass over one window specification.

    A rolling statistic is NULL with fewer than ``max(2, width // 2)`` values.
    """
    bases = tuple(b for b in bases if b in df.columns)
    layout = layout.needing(before=max((*lags, *(w - 1 for w in windows), 1)))

    def body(parts: DataFrame) -> DataFrame:
        booleans = {f.name for f in parts.schema if isinstance(f.dataType, t.BooleanType)}
        numbers = parts.selectExpr(
            "*",
            *[
                f"CAST({f'CAST({b} AS INT)' if b in booleans else b} AS DOUBLE) AS _{b}"
                for b in bases
            ],
        )
        row = over(layout)
        out: list[str] = []
        for b in bases:
            out += [f"lag(_{b}, {n}) {row} AS {b}_lag{n}{unit}" for n in lags]
            for w in windows:
                rows = over(layout, f"ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW")
                out += [
                    f"IF(count(_{b}) {rows} >= {max(2, w // 2)}, {call}(_{b}) {rows}, NULL)"
                    f" AS {b}_roll{w}{unit}_{stat}"
                    for stat, call in AGGREGATES.items()
                ]
            if differences:
                out.append(f"_{b} - lag(_{b}, 1) {row} AS {b}_diff1")
        return numbers.selectExpr(*parts.columns, *out)

    return over_series(df, layout, body)


def hourly_lags(df: DataFrame, params: Params = DEFAULTS, layout: Layout = HOURLY) -> DataFrame:
    return lag_and_rolling(df, HOURLY_BASES, params.lags_hours, (), "h", layout)


def hourly_rolling(df: DataFrame, params: Params = DEFAULTS, layout: Layout = HOURLY) -> DataFrame:
    return lag_and_rolling(df, HOURLY_BASES, (), params.roll_windows_h, "h", layout)


def cyclic_week(df: DataFrame) -> DataFrame:
    angle = F.col("how") * (2 * math.pi) / 168.0
    return df.withColumns({"sin_how": F.sin(angle), "cos_how": F.cos(angle)})


def hourly_features(
    base: DataFrame, params: Params = DEFAULTS, layout: Layout = HOURLY
) -> DataFrame:
    """Lags, rolling statistics and week harmonics on top of the hourly base."""
    return cyclic_week(
        lag_and_rolling(
            base, HOURLY_BASES, params.lags_hours, params.roll_windows_h, "h", layout
        )
    )


# --------------------------------------------------------------------------- days


def daily_table(base: DataFrame) -> DataFrame:
    """Daily sums, means and the share of positive hours, with calendar terms."""
    base = with_series_bounds(base)
    zero = F.lit(0.0)
    days = base.groupBy(METER, T.day_of(F.col("ts")).alias("day")).agg(
        F.coalesce(F.sum("xvs_m3"), zero).alias("itp_xvs_m3"),
        F.coalesce(F.sum("gvs_m3"), zero).alias("odpu_gvs_m3"),
        F.coalesce(F.sum("delta_m3"), zero).alias("delta_m3_sum"),
        F.avg("delta_m3").alias("delta_m3_mean"),
        F.avg("ratio").alias("ratio_mean"),
        F.avg("rel_diff").alias("rel_diff_mean"),
        F.count(F.lit(1)).alias("hours"),
        F.count_if("label").alias("bad_hours"),
        F.min("series_start").alias("series_start"),
        F.max("series_end").alias("series_end"),
    )
    return cyclic_day(days.withColumn("bad_hours_share", F.col("bad_hours") / F.col("hours")))


def cyclic_day(days: DataFrame) -> DataFrame:
    """Weekday, running day number of the series and week harmonics.

    The grid has no missing days, so the day number is a date difference, not a row number.
    """
    angle = F.weekday("day") / 7.0 * (2 * math.pi)
    return days.withColumns(
        {
            "dow": F.weekday("day"),
            "day_idx": F.datediff("day", T.day_of(F.col("series_start"))),
            "dow_cat": F.weekday("day"),
            "week_sin": F.sin(angle),
            "week_cos": F.cos(angle),
        }
    )


def daily_features(
    days: DataFrame, params: Params = DEFAULTS, layout: Layout = DAILY
) -> DataFrame:
    """Lags, rolling statistics and first differences of the daily table."""
    return lag_and_rolling(
        days, DAILY_BASES, params.lags_days, params.roll_windows_d, "d", layout, differences=True
    )


# --------------------------------------------------------------------------- horizons


def hour_horizon_labels(
    base: DataFrame,
    horizons: tuple[int, ...] = DEFAULTS.hour_horizons,
    layout: Layout = HOURLY,
) -> DataFrame:
    """``y_<h>``: the label ``h`` hours later, 0 beyond the end of the series."""
    layout = layout.needing(after=max(horizons))

    def body(parts: DataFrame) -> DataFrame:
        order = window(layout)
        y = F.col("label").cast("int")
        return parts.select(
            "*", *[F.lead(y, h, 0).over(order).alias(f"y_{h}") for h in horizons]
        )

    return over_series(base, layout, body)


def day_labels(base: DataFrame) -> DataFrame:
    """1 for a day with at least one positive hour."""
    return base.groupBy(METER, T.day_of(F.col("ts")).alias("day")).agg(
        F.max(F.col("label").cast("int")).alias("day_label")
    )


def day_horizon_labels(
    labels: DataFrame,
    horizons: tuple[int, ...] = DEFAULTS.day_horizons,
    layout: Layout = DAILY,
) -> DataFrame:
    """``y_<d>``: the day label ``d`` days later, 0 beyond the end of the series."""
    layout = layout.needing(after=max(horizons))

    def body(parts: DataFrame) -> DataFrame:
        order = window(layout)
        return parts.select(
            "*", *[F.lead("day_label", d, 0).over(order).alias(f"y_{d}") for d in horizons]
        )

    return over_series(labels, layout, body)


def align_day_labels(days: DataFrame, labels: DataFrame) -> DataFrame:
    """Day labels next to the feature row of the same meter and day; 0 where none exists."""
    ys = [c for c in labels.columns if c.startswith("y_")]
    joined = days.join(labels.select(METER, "day", *ys), [METER, "day"], "left")
    return joined.withColumns({y: F.coalesce(y, F.lit(0)) for y in ys})


def shift_features(
    df: DataFrame, features: list[str], steps: int, layout: Layout = HOURLY
) -> DataFrame:
    """Replace every feature by its value ``steps`` rows earlier.

    The features travel as one struct, so the shift is a single window function.
    """
    if steps == 0:
        return df
    layout = layout.needing(before=steps)

    def body(parts: DataFrame) -> DataFrame:
        shifted = parts.select(
            *[c for c in parts.columns if c not in features],
            F.lag(F.struct(*features), steps).over(window(layout)).alias("_row"),
        )
        return shifted.select(
            *[c for c in shifted.columns if c != "_row"],
            *[F.col(f"_row.{c}").alias(c) for c in features],
        )

    return over_series(df, layout, body)


# --------------------------------------------------------------------------- feature lists


def rolled_names(
    bases: tuple[str, ...], lags: tuple[int, ...], windows: tuple[int, ...], unit: str,
    differences: bool = False,
) -> list[str]:
    names = []
    for b in bases:
        names += [f"{b}_lag{n}{unit}" for n in lags]
        names += [f"{b}_roll{w}{unit}_{s}" for w in windows for s in AGGREGATES]
        if differences:
            names.append(f"{b}_diff1")
    return names


def hourly_feature_names(df: DataFrame, params: Params = DEFAULTS) -> list[str]:
    """Ordered model inputs of the hourly table: no keys, times, texts or labels."""
    wanted = [
        *HOURLY_RAW_FEATURES,
        *rolled_names(HOURLY_BASES, params.lags_hours, params.roll_windows_h, "h"),
        "sin_how",
        "cos_how",
    ]
    return [c for c in wanted if c in df.columns]


def daily_feature_names(df: DataFrame, params: Params = DEFAULTS) -> list[str]:
    wanted = [
        *DAILY_RAW_FEATURES,
        *rolled_names(DAILY_BASES, params.lags_days, params.roll_windows_d, "d", True),
    ]
    return [c for c in wanted if c in df.columns]


def numeric_features(df: DataFrame, keys: tuple[str, ...] = (METER, "ts")) -> DataFrame:
    """Keys and every numeric or boolean column, booleans as 0/1; other columns drop out."""
    out = []
    for field in df.schema.fields:
        if field.name in keys:
            out.append(F.col(field.name))
        elif isinstance(field.dataType, t.BooleanType):
            out.append(F.col(field.name).cast("int").alias(field.name))
        elif isinstance(field.dataType, t.NumericType):
            out.append(F.col(field.name))
    return df.select(*out)
