"""From raw readings to a gap-free hourly grid in common units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import time as T
from tidemark.params import DEFAULTS, Params
from tidemark.plans.series import HOURLY, METER, PART, Layout, core

VOLUMES = ("xvs_m3", "gvs_m3", "supply_m3", "return_m3")


def parse_reading_times(raw: DataFrame) -> DataFrame:
    """Text date and hour interval to ``date``, ``hour_idx`` (1..24) and ``ts``.

    Rows whose date or hour cannot be read are dropped.
    """
    parsed = raw.select(
        "*",
        T.parse_date(F.col("date_raw")).alias("date"),
        T.parse_hour_bound(F.col("hour_raw")).alias("hour_idx"),
    )
    return filter_valid_hours(parsed).withColumn(
        "ts", T.hour_start(F.col("date"), F.col("hour_idx"))
    )


def filter_valid_hours(parsed: DataFrame) -> DataFrame:
    """Keep rows with a date and an hour number in 1..24."""
    return parsed.where(F.col("date").isNotNull() & F.col("hour_idx").between(1, 24))


def duplicate_hours(readings: DataFrame) -> DataFrame:
    """Hours that were delivered more than once, with their number of rows."""
    return (
        readings.groupBy(METER, "ts")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def _merged(column: str, on_duplicate: str, order_by: str | None) -> Column:
    if on_duplicate == "sum" and column in VOLUMES:
        return F.sum(column)
    if on_duplicate == "last":
        return F.max_by(column, order_by)
    return F.max(column)


def hourly_parts(
    readings: DataFrame,
    layout: Layout = HOURLY,
    *,
    on_duplicate: str = "raise",
    order_by: str | None = None,
) -> DataFrame:
    """The gap-free grid of every meter, laid out in parts with their halo.

    Readings and empty grid hours are united and shuffled once, by part. The aggregation that
    merges them and every later window over the parts reuse that shuffle.
    """
    if on_duplicate not in ("raise", "sum", "last"):
        raise ValueError(f"unknown duplicate policy {on_duplicate!r}")
    if on_duplicate == "last" and order_by is None:
        raise ValueError("policy 'last' needs order_by: a distributed scan has no arrival order")
    values = [c for c in readings.columns if c not in (METER, "ts", "day", "hour_idx", order_by)]
    hour = T.hour_number(F.col("ts"))
    facts = readings.select(
        METER, hour.alias("hour_no"), *values, *([order_by] if order_by else []),
        F.lit(1).alias("is_reading"),
    )

    # One row per meter, then one per part, then one per hour: no row grows with the history.
    weekday_range = (
        [F.min("weekday").alias("weekday_low"), F.max("weekday").alias("weekday_high")]
        if "weekday" in values
        else []
    )
    profile = facts.groupBy(METER).agg(
        F.min("hour_no").alias("first_hour"), F.max("hour_no").alias("last_hour"), *weekday_range
    )
    extra = ["weekday_low", "weekday_high"] if weekday_range else []
    # "chunk" only splits the generation of hours; the halo decides about parts further down.
    chunk = F.explode(
        F.sequence(F.floor(F.col("first_hour") / layout.size), F.floor(F.col("last_hour") / layout.size))
    )
    start = F.col("chunk") * layout.size
    empty_hours = (
        profile.select("*", chunk.alias("chunk"))
        .repartition(METER, "chunk")
        .select(
            METER,
            F.explode(
                F.sequence(
                    F.greatest(F.col("first_hour"), start),
                    F.least(F.col("last_hour"), start + layout.size - 1),
                )
            ).alias("hour_no"),
            "first_hour",
            "last_hour",
            *extra,
        )
    )
    united = facts.unionByName(empty_hours, allowMissingColumns=True)
    united = united.withColumn("ts", T.hour_from_number(F.col("hour_no")))
    placed = united.select("*", F.explode(layout.memberships()).alias(PART)).drop("ts")
    merged = (
        placed.repartition(METER, PART)
        .groupBy(METER, PART, "hour_no")
        .agg(
            F.count("is_reading").alias("n_readings"),
            *[_merged(c, on_duplicate, order_by).alias(c) for c in values],
            F.max("first_hour").alias("first_hour"),
            F.max("last_hour").alias("last_hour"),
            *[F.max(c).alias(c) for c in extra],
        )
    )
    hour_no = F.col("hour_no")
    if on_duplicate == "raise":
        message = F.concat(
            F.lit("duplicate hour "), T.hour_from_number(hour_no).cast("string"),
            F.lit(" of meter "), F.col(METER).cast("string"),
        )
        hour_no = F.when(F.col("n_readings") > 1, F.raise_error(message)).otherwise(hour_no)
    return merged.select(
        METER,
        PART,
        T.hour_from_number(hour_no).alias("ts"),
        *values,
        T.hour_from_number(F.col("first_hour")).alias("series_start"),
        T.hour_from_number(F.col("last_hour")).alias("series_end"),
        *extra,
    ).select(
        METER,
        PART,
        "ts",
        T.day_of(F.col("ts")).alias("day"),
        (F.hour("ts") + 1).alias("hour_idx"),
        *values,
        "series_start",
        "series_end",
        *extra,
    )


def hourly_gap_fill(readings: DataFrame, layout: Layout = HOURLY, **duplicates) -> DataFrame:
    """One row per meter and hour from its first to its last reading; gaps are NULL.

    ``series_start`` and ``series_end`` travel with every row: row numbers, tails and folds follow
    from them by arithmetic instead of another window.
    """
    return core(hourly_parts(readings, layout, **duplicates), layout)


def with_series_bounds(df: DataFrame) -> DataFrame:
    """Add ``series_start`` / ``series_end`` to a grid that lost them."""
    if "series_start" in df.columns:
        return df
    bounds = df.groupBy(METER).agg(
        F.min("ts").alias("series_start"), F.max("ts").alias("series_end")
    )
    return df.join(bounds, METER)


def harmonize_units(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Numbers in common units; text that is no number becomes NULL; absent columns are skipped."""
    factors = {
        "xvs_m3": params.xvs_factor,
        "gvs_m3": params.gvs_factor,
        "supply_m3": params.supply_factor,
        "return_m3": params.return_factor,
    }
    types = dict(df.dtypes)
    return df.withColumns(
        {
            c: (N.parse_number(F.col(c)) if types[c] == "string" else N.finite(F.col(c).cast("double")))
            * F.lit(float(k))
            for c, k in factors.items()
            if c in types
        }
    )


def recirculation_proxy(
    df: DataFrame,
    *,
    enabled: bool = False,
    proxy_column: str = "odpu_proxy_net",
    use_if_missing: bool = True,
    override: bool = False,
    gvs_present: bool = True,
) -> DataFrame:
    """Net flow ``max(supply - return, 0)`` as a stand-in for the house meter.

    ``gvs_present`` tells whether the delivered file had the house-meter column at all; gaps
    inside an existing column are not filled.
    """
    if not enabled:
        return df
    if not {"supply_m3", "return_m3"} <= set(df.columns):
        return df.withColumn(proxy_column, F.lit(None).cast("double"))
    out = df.withColumn(proxy_column, N.at_least(F.col("supply_m3") - F.col("return_m3"), 0.0))
    if override or (use_if_missing and not (gvs_present and "gvs_m3" in df.columns)):
        out = out.withColumn("gvs_m3", F.col(proxy_column))
    return out


def weekday_normalize(df: DataFrame, *, rule: str = "series") -> DataFrame:
    """Add ``weekday_norm`` in 0..6 (Monday 0), NULL if the delivered numbers fit no convention.

    Rule ``series`` looks at the range a whole series uses. Rule ``row`` judges every row alone,
    which reads 1..6 as already zero-based.
    """
    if "weekday" not in df.columns:
        return df.withColumn("weekday_norm", F.lit(None).cast("int"))
    if rule == "row":
        value = F.col("weekday")
        return df.withColumn("weekday_norm", T.weekday_to_zero_based(value, value, value))
    if "weekday_low" not in df.columns:
        ranges = df.groupBy(METER).agg(
            F.min("weekday").alias("weekday_low"), F.max("weekday").alias("weekday_high")
        )
        df = df.join(ranges, METER)
    return df.withColumn(
        "weekday_norm",
        T.weekday_to_zero_based(F.col("weekday"), F.col("weekday_low"), F.col("weekday_high")),
    ).drop("weekday_low", "weekday_high")


def train_test_tail(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Mark the last ``train_days + test_days`` of every meter: ``is_train`` and ``is_test``.

    A history shorter than both windows makes them overlap. Older rows carry neither mark.
    """
    df = with_series_bounds(df)
    train, test = params.train_days * 24, params.test_days * 24
    from_end = T.hour_number(F.col("series_end")) - T.hour_number(F.col("ts")) + 1
    total = T.hour_number(F.col("series_end")) - T.hour_number(F.col("series_start")) + 1
    tail = F.least(total, F.lit(train + test))
    return df.withColumns(
        {
            "is_train": (from_end <= tail) & (tail - from_end < train),
            "is_test": from_end <= F.least(tail, F.lit(test)),
        }
    )


def latest_per_meter(df: DataFrame, time: str = "ts") -> DataFrame:
    """The newest row of every meter, by a map-side combining aggregation."""
    return df.groupBy(METER).agg(
        F.max_by(F.struct(*df.columns), time).alias("row")
    ).select("row.*")
