"""Channel quality flags, balance, hints, alerts and the daily report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.params import DEFAULTS, HINT_SEPARATOR, HINTS, LOW_DELTA_T_HINT, Params
from tidemark.plans.series import HOURLY, METER, Layout, over_series, run_lengths, window

CHANNELS = {"xvs_m3": "itp_xvs", "gvs_m3": "odpu_gvs"}

ALERT_COLUMNS = (
    METER,
    "day",
    "hour_idx",
    "ts",
    "xvs_m3",
    "gvs_m3",
    "diff_m3",
    "rel_diff",
    "itp_xvs_zero_anomaly",
    "odpu_gvs_zero_anomaly",
    "itp_xvs_flat_anomaly",
    "odpu_gvs_flat_anomaly",
    "itp_xvs_spike",
    "odpu_gvs_spike",
    "reason_hint",
)


def is_zero(value: Column) -> Column:
    """A missing hour counts as zero."""
    return F.coalesce(value, F.lit(0.0)) == 0


def unchanged(value: Column, previous: Column) -> Column:
    """Equal to the hour before; a missing hour equals nothing."""
    return F.coalesce(value == previous, F.lit(False))


def outside_iqr(value: Column, neighbours: Column, params: Params) -> Column:
    """True where a value is further than ``k`` interquartile ranges from the median of its
    (sorted) neighbourhood. Too few neighbours or a zero range decide nothing."""
    q1, q2, q3 = (N.quantile_of_sorted(neighbours, q) for q in (0.25, 0.5, 0.75))
    reach = (q3 - q1) * params.spike_iqr_k
    decided = (F.size(neighbours) >= params.spike_min_values) & (reach != 0)
    return F.coalesce(decided & ((value > q2 + reach) | (value < q2 - reach)), F.lit(False))


def quality_halo(params: Params) -> tuple[int, int]:
    """Hours a row needs before and after it for the spike and flatline tests."""
    half = params.spike_window_hours // 2
    return half, params.spike_window_hours - half - 1


def quality_flags(
    df: DataFrame,
    channels: dict[str, str] | None = None,
    params: Params = DEFAULTS,
    layout: Layout = HOURLY,
) -> DataFrame:
    """Zero runs, flatlines and spikes of every channel.

    Per channel prefix: ``_zero``, ``_zero_run``, ``_zero_anomaly``, ``_flat``, ``_flat_run``,
    ``_flat_anomaly`` and ``_spike``. Channels that are absent are skipped.
    """
    channels = {c: p for c, p in (channels or CHANNELS).items() if c in df.columns}
    before, after = quality_halo(params)
    layout = layout.needing(before, after)

    def flag(parts: DataFrame) -> DataFrame:
        order = window(layout)
        nearby = order.rowsBetween(-before, after)
        keep = parts.columns
        seen = parts.select(
            "*",
            *[F.lag(c).over(order).alias(f"_{p}_previous") for c, p in channels.items()],
            *[F.collect_list(c).over(nearby).alias(f"_{p}_nearby") for c, p in channels.items()],
        )
        states = seen.select(
            *keep,
            *[is_zero(F.col(c)).alias(f"_{p}_zero") for c, p in channels.items()],
            *[
                unchanged(F.col(c), F.col(f"_{p}_previous")).alias(f"_{p}_flat")
                for c, p in channels.items()
            ],
            *[F.sort_array(f"_{p}_nearby").alias(f"_{p}_nearby") for p in channels.values()],
        ).select(
            *keep,
            *[f"_{p}_{kind}" for p in channels.values() for kind in ("zero", "flat")],
            *[
                outside_iqr(F.col(c), F.col(f"_{p}_nearby"), params).alias(f"{p}_spike")
                for c, p in channels.items()
            ],
        )
        runs = run_lengths(
            states,
            {
                f"{p}_{kind}_run": f"_{p}_{kind}"
                for p in channels.values()
                for kind in ("zero", "flat")
            },
            layout,
            warmup=1,  # the first halo row has no previous value to compare with
        )
        least = {"zero": params.zero_anomaly_hours, "flat": params.flatline_hours}
        flags = []
        for p in channels.values():
            for kind in ("zero", "flat"):
                flags += [
                    F.col(f"_{p}_{kind}").cast("int").alias(f"{p}_{kind}"),
                    F.col(f"{p}_{kind}_run"),
                    (F.col(f"{p}_{kind}_run") >= least[kind]).alias(f"{p}_{kind}_anomaly"),
                ]
            flags.append(F.col(f"{p}_spike"))
        return runs.select(*keep, *flags)

    return over_series(df, layout, flag)


def balance(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``rel_diff``, ``diff_m3`` and ``flag_over10`` from the non-negative parts of both flows."""
    xvs, gvs = N.at_least(F.col("xvs_m3"), 0.0), N.at_least(F.col("gvs_m3"), 0.0)
    rel_diff = N.relative_difference(gvs, xvs, params.eps)
    return df.withColumns(
        {
            "rel_diff": rel_diff,
            "diff_m3": gvs - xvs,
            "flag_over10": F.coalesce(rel_diff > params.rel_diff_limit, F.lit(False)),
        }
    )


def reason_hint(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Explanations of an over-limit hour joined to one text; empty for all other hours."""
    hints = [F.when(F.col(c), text) for c, text in HINTS.items() if c in df.columns]
    if {"t1", "t2"} <= set(df.columns):
        hints.append(F.when(F.col("t1") - F.col("t2") < params.low_delta_t, LOW_DELTA_T_HINT))
    text = F.concat_ws(HINT_SEPARATOR, *hints)
    return df.withColumn("reason_hint", F.when(F.col("flag_over10"), text).otherwise(F.lit("")))


def balance_and_flags(
    df: DataFrame, params: Params = DEFAULTS, layout: Layout = HOURLY
) -> DataFrame:
    """The processed hourly table: balance, quality flags and hints."""
    return reason_hint(quality_flags(balance(df, params), None, params, layout), params)


def alerts(processed: DataFrame) -> DataFrame:
    """Hours over the limit or with a zero or flat anomaly (spikes alone do not alert).

    Order it where it is written; sorting here would only add a shuffle to every consumer.
    """
    suspicious = F.col("flag_over10")
    for column in (c for c in processed.columns if c.endswith("_anomaly")):
        suspicious = suspicious | F.col(column)
    return processed.where(suspicious).select(
        *[c for c in ALERT_COLUMNS if c in processed.columns]
    )


def daily_report(processed: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Daily sums of both flows, their relative difference and the share of hours over the limit."""
    zero = F.lit(0.0)
    days = processed.groupBy(METER, "day").agg(
        F.coalesce(F.sum("xvs_m3"), zero).alias("itp_xvs_m3"),
        F.coalesce(F.sum("gvs_m3"), zero).alias("odpu_gvs_m3"),
        F.count(F.lit(1)).alias("hours_total"),
        F.count_if("flag_over10").alias("hours_over10"),
    )
    gap = F.abs(F.col("odpu_gvs_m3") - F.col("itp_xvs_m3"))
    largest = F.greatest(F.col("odpu_gvs_m3"), F.col("itp_xvs_m3"), F.lit(params.eps))
    return days.withColumn("daily_rel_diff", gap / largest).withColumns(
        {
            "daily_rel_diff_pct": N.round_half_even(F.col("daily_rel_diff") * 100, 1),
            "hours_over10_pct": N.round_half_even(
                F.col("hours_over10") / F.col("hours_total") * 100, 1
            ),
        }
    )


def run_length(df: DataFrame, flag: Column, name: str, layout: Layout = HOURLY) -> DataFrame:
    """Length of the current run of hours for which ``flag`` holds."""

    def body(parts: DataFrame) -> DataFrame:
        flagged = parts.withColumn("_flag", F.coalesce(flag, F.lit(False)))
        return run_lengths(flagged, {name: "_flag"}, layout).drop("_flag")

    return over_series(df, layout, body)

