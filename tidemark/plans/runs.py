"""The three complete runs: detection, training and forecasting.

Runs exchange stored tables: processed hours, baseline, decisions and models. A lost executor
therefore repeats at most the tables that were being written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import baseline as B
from tidemark.operators import detect as D
from tidemark.operators import features as X
from tidemark.operators import grid as G
from tidemark.operators import incidents as I
from tidemark.operators import metrics as M
from tidemark.operators import models as ML
from tidemark.operators import quality as Q
from tidemark.params import DEFAULTS, Params
from tidemark.plans.series import HOURLY, Layout, core
from tidemark.sources import sinks
from tidemark.sources.readings import parse_ts

# Spikes look 12 hours back and 11 ahead, persistence and incidents a few hours further back.
RUN_LAYOUT = HOURLY.needing(before=24, after=24)


def processed_parts(
    grid_parts: DataFrame,
    params: Params = DEFAULTS,
    layout: Layout = RUN_LAYOUT,
    *,
    recirculation: bool = False,
    gvs_present: bool = True,
) -> DataFrame:
    """Units, proxy, balance and quality flags of a grid that is laid out in parts."""
    numbers = G.recirculation_proxy(
        G.harmonize_units(grid_parts, params), enabled=recirculation, gvs_present=gvs_present
    )
    if "weekday_norm" not in numbers.columns:
        numbers = G.weekday_normalize(numbers)
    return Q.balance_and_flags(numbers, params, layout)


def processed_hours(
    readings: DataFrame,
    params: Params = DEFAULTS,
    layout: Layout = RUN_LAYOUT,
    **options,
) -> DataFrame:
    """From readings (``meter_id``, ``ts``, channels) to the processed hourly table."""
    return core(
        processed_parts(G.hourly_parts(readings, layout), params, layout, **options), layout
    )


def run_detection(
    spark: SparkSession,
    readings: DataFrame,
    outdir: str,
    params: Params = DEFAULTS,
    **options,
) -> DataFrame:
    """Process, report, fit, score and merge; returns the run summary."""
    paths = {
        n: f"{outdir}/{n}"
        for n in (
            "processed_hourly", "alerts", "daily_report", "baseline", "online_decisions",
            "online_decisions_full", "events", "current_decision", "summary",
        )
    }
    processed = processed_hours(readings, params, **options)
    sinks.write_days(processed, paths["processed_hourly"], whole=True)
    hours = sinks.read_days(spark, paths["processed_hourly"])
    sinks.write_table(Q.alerts(hours), paths["alerts"])
    sinks.write_days(Q.daily_report(hours, params), paths["daily_report"], whole=True)

    windows = G.train_test_tail(hours, params)
    sinks.write_table(B.fit_baseline(windows.where("is_train"), params), paths["baseline"])
    baseline = spark.read.parquet(paths["baseline"])
    for name, scope in (
        ("online_decisions", windows.where("is_test")),
        ("online_decisions_full", hours),
    ):
        decided = D.detect_hours(scope, baseline, params)
        sinks.write_days(D.decision_postprocess(decided, params), paths[name], whole=True)
    decisions = sinks.read_days(spark, paths["online_decisions"])
    sinks.write_table(I.incidents(decisions, params), paths["events"])
    sinks.write_json(D.latest_decision(decisions), paths["current_decision"])
    summary = run_summary(
        hours, spark.read.parquet(paths["alerts"]), sinks.read_days(spark, paths["daily_report"]), params
    )
    sinks.write_json(summary, paths["summary"])
    return summary


def run_summary(
    hours: DataFrame, alerts: DataFrame, daily: DataFrame, params: Params = DEFAULTS
) -> DataFrame:
    """Row, alert and day counts with the window sizes, as (name, value) rows."""

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("name"), "value")

    sizes = hours.sparkSession.createDataFrame(
        [("training_days_used", params.train_days), ("test_days_used", params.test_days)],
        "name string, value bigint",
    )
    return (
        sizes.unionByName(count(hours, "rows_processed"))
        .unionByName(count(alerts, "alerts_count"))
        .unionByName(count(daily, "days"))
    )


def stored_base(spark: SparkSession, indir: str, params: Params = DEFAULTS) -> DataFrame:
    """Hourly base of a finished detection run; decisions are optional."""
    hours = parse_ts(sinks.read_days(spark, f"{indir}/processed_hourly"))
    try:
        decisions = sinks.read_days(spark, f"{indir}/online_decisions_full")
    except FileNotFoundError:
        decisions = None
    return X.hourly_base(hours, decisions, params)


def run_training(
    spark: SparkSession, indir: str, outdir: str, params: Params = DEFAULTS
) -> DataFrame:
    """Backtest and train hourly and daily models; returns the mean metrics."""
    base = stored_base(spark, indir, params)
    tables = {
        ML.HOURS: ML.labelled_hours(base, params),
        ML.DAYS: ML.labelled_days(base, params),
    }
    means = []
    for kind, table in tables.items():
        path = f"{outdir}/backtest_{kind.name}"
        sinks.write_table(ML.backtest(table, kind, params), path)
        mean = M.metric_means(spark.read.parquet(path), kind.horizon)
        means.append(
            mean.select(
                F.lit(kind.name).alias("granularity"),
                F.col(kind.horizon).alias("horizon"),
                "f1",
                "roc_auc",
            )
        )
        ML.save_bundle(ML.train_models(table, kind, params), f"{outdir}/models")
    metrics = ML.concat_horizons(means)
    sinks.write_json(metrics, f"{outdir}/metrics")
    return metrics


def run_forecast(
    spark: SparkSession, indir: str, outdir: str, params: Params = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """Hourly and daily forecasts from stored models."""
    base = G.with_series_bounds(stored_base(spark, indir, params))
    tables = {
        ML.HOURS: X.hourly_features(base, params),
        ML.DAYS: X.daily_features(X.daily_table(base), params),
    }
    results = []
    for kind, table in tables.items():
        bundle = ML.load_bundle(f"{outdir}/models", kind)
        path = f"{outdir}/pred_{kind.name}"
        sinks.write_table(ML.forecast(table, bundle, params), path)
        results.append(spark.read.parquet(path))
    return results[0], results[1]

