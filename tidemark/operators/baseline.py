"""The robust hour-of-week baseline of every meter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import time as T
from tidemark.params import DEFAULTS, Params
from tidemark.plans.series import METER

#: What a baseline counts in each hour of the week.
COUNTED = ("itp", "odpu", "weather")
SERIES = {"itp": "itp", "odpu": "odpu", "delta": "delta", "ratio": "ratio"}
STATISTICS = (
    *[f"mu_{s}" for s in SERIES],
    *[f"sigma_{s}" for s in SERIES],
    "p_low_delta",
    "p_high_delta",
    "p_low_ratio",
    "p_high_ratio",
    "w_med",
    "beta_delta_w",
    "beta_ratio_w",
)


def baseline_inputs(train: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Non-negative flows, their difference and ratio, and the hour of the week."""
    flows = train.select(
        METER,
        "ts",
        N.at_least(F.col("xvs_m3"), 0.0).alias("itp"),
        N.at_least(F.col("gvs_m3"), 0.0).alias("odpu"),
        (F.col("weather") if "weather" in train.columns else F.lit(None))
        .cast("double")
        .alias("weather"),
        (F.col("weekday_norm") if "weekday_norm" in train.columns else F.lit(None))
        .cast("int")
        .alias("weekday_norm"),
    )
    return flows.select(
        METER,
        T.hour_of_week(F.col("weekday_norm"), F.col("ts")).alias("how"),
        "itp",
        "odpu",
        (F.col("itp") - F.col("odpu")).alias("delta"),
        (F.col("odpu") / N.at_least(F.col("itp"), params.eps)).alias("ratio"),
        "weather",
    )


def value_counts(hours: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """How often each triple of flows and weather occurs in an hour of the week: all that a
    baseline depends on. Counts of different days add up and can be taken back (:func:`refit`)."""
    return baseline_inputs(hours, params).groupBy(METER, "how", *COUNTED).agg(
        F.count(F.lit(1)).alias("n")
    )


def refit(
    counts: DataFrame, add: DataFrame, drop: DataFrame | None = None, params: Params = DEFAULTS
) -> DataFrame:
    """The counts after the hours ``add`` came into the training window and ``drop`` left it.

    Whole numbers only, so however many days have come and gone the counts are those of a fresh
    fit. Taking back hours that were never counted is an error.
    """
    changes = value_counts(add, params)
    if drop is not None:
        gone = value_counts(drop, params)
        changes = changes.unionByName(gone.withColumn("n", -F.col("n")))
    total = counts.unionByName(changes).groupBy(METER, "how", *COUNTED).agg(F.sum("n").alias("n"))
    unknown = F.raise_error(F.lit("hours leave the baseline that were never in it"))
    checked = F.when(F.col("n") < 0, unknown.cast("bigint")).otherwise(F.col("n"))
    return total.withColumn("n", checked).where("n > 0")


def _flows(counts: DataFrame, params: Params) -> DataFrame:
    """Difference and ratio of counted flows."""
    return counts.withColumns(
        {
            "delta": F.col("itp") - F.col("odpu"),
            "ratio": F.col("odpu") / N.at_least(F.col("itp"), params.eps),
        }
    )


def _median(value: Column) -> Column:
    """Exact median of counted values: NULLs do not count."""
    return F.percentile(value, F.lit(0.5), F.col("n"))


def _sigma(median_deviation: Column, params: Params) -> Column:
    return median_deviation * params.mad_scale + params.sigma_floor


def weather_slope(y: str, params: Params) -> Column:
    """Least-squares slope through the origin of ``y`` on centred weather; 0 with few pairs."""
    paired = F.col(y).isNotNull() & F.col("wc").isNotNull()
    numerator = F.sum(F.col("wc") * F.col(y) * F.col("n"))
    denominator = F.sum(F.when(paired, F.col("wc") * F.col("wc") * F.col("n")))
    pairs = F.sum(F.when(paired, F.col("n")))
    usable = (pairs >= params.beta_min_points) & (denominator > 0)
    return F.when(usable, numerator / denominator).otherwise(F.lit(0.0))


def slots_of_counts(counts: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Statistics of the hours of the week that have counts, and the meter's overall deviations
    ``global_sigma_delta`` / ``global_sigma_ratio``.

    Quantiles are taken from the counts by weight. Groups are bounded by the training window: a
    meter has at most ``24 * train_days`` hours and one hour of the week at most one hour per week
    of it. One shuffle by meter serves the overall medians and the slots alike.
    """
    meter, slot = Window.partitionBy(METER), Window.partitionBy(METER, "how")
    centred = _flows(counts, params).select(
        "*",
        _median(F.col("weather")).over(meter).alias("_w_center"),
        *[_median(F.col(s)).over(meter).alias(f"_center_{s}") for s in ("delta", "ratio")],
        *[_median(F.col(s)).over(slot).alias(f"mu_{s}") for s in SERIES],
    )
    measured = centred.select(
        "*",
        (F.col("weather") - F.col("_w_center")).alias("wc"),
        *[
            _median(F.abs(F.col(s) - F.col(f"_center_{s}"))).over(meter).alias(f"_mad_{s}")
            for s in ("delta", "ratio")
        ],
    )
    return measured.groupBy(METER, "how").agg(
        *[F.first(f"mu_{s}").alias(f"mu_{s}") for s in SERIES],
        *[
            _sigma(_median(F.abs(F.col(s) - F.col(f"mu_{s}"))), params).alias(f"sigma_{s}")
            for s in SERIES
        ],
        *[
            F.percentile(s, F.lit(q), F.col("n")).alias(f"{name}_{s}")
            for s in ("delta", "ratio")
            for name, q in (("p_low", params.q_low), ("p_high", params.q_high))
        ],
        _median(F.col("weather")).alias("w_med"),
        weather_slope("delta", params).alias("beta_delta_w"),
        weather_slope("ratio", params).alias("beta_ratio_w"),
        *[
            _sigma(F.first(f"_mad_{s}"), params).alias(f"global_sigma_{s}")
            for s in ("delta", "ratio")
        ],
    )


def baseline_slots(train: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """:func:`slots_of_counts` of hours, each counted once."""
    return slots_of_counts(baseline_inputs(train, params).withColumn("n", F.lit(1)), params)


def fill_week(slots: DataFrame) -> DataFrame:
    """All 168 hours of the week; gaps take the previous hour's value, leading gaps the next."""
    # At most 168 slots per meter: they fit one row, which densifies without a join.
    meters = slots.groupBy(METER).agg(
        F.map_from_entries(F.collect_list(F.struct("how", F.struct(*STATISTICS)))).alias("slots"),
        *[F.max(f"global_sigma_{s}").alias(f"global_sigma_{s}") for s in ("delta", "ratio")],
    )
    hours = F.sequence(F.lit(0), F.lit(T.HOURS_PER_WEEK - 1))
    full = meters.select(
        METER,
        "global_sigma_delta",
        "global_sigma_ratio",
        F.posexplode(
            F.transform(hours, lambda h: F.try_element_at(F.col("slots"), h))
        ).alias("how", "slot"),
    ).select(METER, "how", "slot.*", "global_sigma_delta", "global_sigma_ratio")
    order = Window.partitionBy(METER).orderBy("how")
    back = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return full.select(
        METER,
        "how",
        *[
            F.coalesce(
                F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)
            ).alias(c)
            for c in STATISTICS
        ],
        "global_sigma_delta",
        "global_sigma_ratio",
    )


def fit_baseline(train: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """168 rows per meter: medians, deviations, corridors and weather slopes."""
    return fill_week(baseline_slots(train, params))


def baseline_of_counts(counts: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The baseline of :func:`fit_baseline` from stored counts."""
    return fill_week(slots_of_counts(counts, params))


def global_sigma(train: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Overall deviations of a meter's difference and ratio in the training window."""
    meter = Window.partitionBy(METER)
    hours = baseline_inputs(train, params).withColumn("n", F.lit(1))
    centred = hours.select(
        "*", *[_median(F.col(s)).over(meter).alias(f"_center_{s}") for s in ("delta", "ratio")]
    )
    return centred.groupBy(METER).agg(
        *[
            _sigma(_median(F.abs(F.col(s) - F.col(f"_center_{s}"))), params).alias(
                f"global_sigma_{s}"
            )
            for s in ("delta", "ratio")
        ]
    )
