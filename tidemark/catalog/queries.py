"""One query per operator, each over the whole given tables.

``queries()`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``oracle_sql()`` maps the same name
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import oracle as O
from tidemark.functions import numeric as N
from tidemark.functions import time as T
from tidemark.operators import baseline as B
from tidemark.operators import detect as D
from tidemark.operators import features as X
from tidemark.operators import grid as G
from tidemark.operators import incidents as I
from tidemark.operators import metrics as M
from tidemark.operators import models as ML
from tidemark.operators import quality as Q
from tidemark.operators import splits as P
from tidemark.params import CAUSE_LABEL, CAUSE_PRIOR, CAUSE_RULE, DEFAULTS, UNKNOWN_LABEL, Params
from tidemark.plans import runs
from tidemark.plans.layout import store_parts
from tidemark.plans.series import HOURLY, METER, core, spread
from tidemark.plans.staging import scratch_path, stage, stage_table
from tidemark.sources import events as E
from tidemark.sources import readings as R
from tidemark.sources import sinks
from tidemark.streaming import detect as SD
from tidemark.streaming import hourly as SH
from tidemark.streaming import incidents as SI

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

KEYS = (METER, "ts")
POST_TEXTS = ("cause_label", "cause_rule", "anomaly")
PERCENTS = tuple(f"pct_{c}" for c in CAUSE_PRIOR)
CHANNELS = ("xvs_m3", "gvs_m3", "supply_m3", "return_m3", "t1", "t2", "weather", "weekday")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = O.with_ctes(sql)
        return fn

    return register


def stable(c: str) -> Column:
    """Six decimals, or nine to ten significant digits of huge values: what two engines agree on."""
    v = F.col(c)
    return (
        F.when(F.abs(v) < 1e6, F.rint(v * 1e6) / 1e6).otherwise(F.rint(v / 1e3) * 1e3) + F.lit(0.0)
    ).alias(c)


def comma(*names: str) -> str:
    return ", ".join(names)


# --------------------------------------------------------------------------- shared inputs


def grid(spark: SparkSession, d: str) -> DataFrame:
    """The hourly grid as a table: the events are scanned once, however many branches follow."""
    return G.weekday_normalize(stage_table(E.hourly_grid(spark, d), "grid"))


def processed_parts(hours: DataFrame) -> DataFrame:
    return runs.processed_parts(spread(hours, runs.RUN_LAYOUT))


def processed(spark: SparkSession, d: str) -> DataFrame:
    return core(processed_parts(grid(spark, d)), runs.RUN_LAYOUT)


def fitted(hours: DataFrame) -> DataFrame:
    return B.fit_baseline(G.train_test_tail(hours).where("is_train"))


def train(spark: SparkSession, d: str) -> DataFrame:
    return G.train_test_tail(grid(spark, d)).where("is_train")


def baseline(spark: SparkSession, d: str) -> DataFrame:
    return fitted(grid(spark, d))


def decided_parts(hours: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Scored hours that still hold their inputs. Quality flags, scoring and whatever windows
    follow share the layout and therefore one shuffle."""
    return D.decide_hours(G.train_test_tail(processed_parts(hours)), fitted(hours), params)


def decided(spark: SparkSession, d: str) -> DataFrame:
    return core(decided_parts(grid(spark, d)), runs.RUN_LAYOUT)


def detected(spark: SparkSession, d: str, params: Params = DEFAULTS) -> DataFrame:
    """Processed columns and post-processed decisions of all hours."""
    layout = runs.RUN_LAYOUT
    parts = decided_parts(grid(spark, d), params)
    return core(D.decision_postprocess(parts, params, layout), layout)


def decisions_full(spark: SparkSession, d: str) -> DataFrame:
    return detected(spark, d).select(*D.DECISION_COLUMNS, *POST_TEXTS, *PERCENTS)


def decisions_test(spark: SparkSession, d: str, basic: bool = False) -> DataFrame:
    test = decided(spark, d).where("is_test").select(*D.DECISION_COLUMNS)
    return D.decision_postprocess(test, basic=basic)


def base(spark: SparkSession, d: str, params: Params = DEFAULTS) -> DataFrame:
    """The labelled hourly base, from a stored detection result, whose rows hold their label."""
    stored = stage_table(detected(spark, d, params), "detected")
    hours = stored.select(*PROCESSED.split(", "), "series_start", "series_end", "is_anomaly_final")
    return X.hourly_base(hours)


PROCESSED = comma(
    "meter_id", "ts", "day", "hour_idx", *CHANNELS, "rel_diff", "diff_m3", "flag_over10",
    O.QUALITY_COLUMNS, "reason_hint",
)


def processed_columns(df: DataFrame) -> DataFrame:
    return df.select(*PROCESSED.split(", "))


# --------------------------------------------------------------------------- 2.1 scans and sinks

RAW = comma("meter_id", "date_raw", "hour_raw", *CHANNELS)


def _write_raw_csv(spark: SparkSession, d: str) -> str:
    path = scratch_path(spark, "readings-csv")
    E.raw_texts(E.readings(spark, d)).write.option("header", True).csv(path)
    return path


@query("scan_readings_csv", f"SELECT {RAW} FROM raw_text")
def scan_readings_csv(spark, d):
    return R.read_readings_csv(spark, _write_raw_csv(spark, d)).select(*RAW.split(", "))


@query(
    "scan_encoding_fallback",
    f"SELECT {RAW.replace('hour_raw', 'replace(hour_raw, chr(45), chr(8211)) AS hour_raw')} FROM raw_text",
)
def scan_encoding_fallback(spark, d):
    """A folder of three kinds of files, read without naming an encoding: UTF-8, the Cyrillic code
    page with its own headers, and the code page under a header of plain ASCII."""
    path = scratch_path(spark, "readings-mixed")
    headers = {v: k for k, v in R.CSV_HEADERS.items()}
    texts = stage_table(
        E.raw_texts(E.readings(spark, d)).withColumn("hour_raw", F.translate("hour_raw", "-", "–")),
        "raw-texts",
    )
    kind = F.pmod(F.day(F.to_date("date_raw", "dd.MM.yyyy")), F.lit(3))
    for n, cyrillic, known in ((0, False, True), (1, True, True), (2, True, False)):
        part = texts.where(kind == n)
        names = {c: headers.get(c, c) if known else c for c in texts.columns}
        if cyrillic:
            # The code page's bytes as the Latin-1 characters of the same numbers.
            part = part.withColumn("hour_raw", F.translate("hour_raw", R.CP1251_CHARS, R.LATIN1_CHARS))
            names = {c: x.encode("cp1251").decode("latin-1") for c, x in names.items()}
        part.select(*[F.col(c).alias(x) for c, x in names.items()]).write.mode("append").csv(
            path, header=True, encoding="ISO-8859-1" if cyrillic else "UTF-8"
        )
    return R.read_readings_csv(spark, path).select(*RAW.split(", "))


@query("scan_processed_hourly", f"SELECT {PROCESSED} FROM proc")
def scan_processed_hourly(spark, d):
    path = scratch_path(spark, "processed")
    sinks.write_days(processed(spark, d), path)
    return processed_columns(R.parse_ts(sinks.read_days(spark, path)))


@query(
    "scan_decisions_optional",
    "SELECT 'present' AS source, count(*) AS n_rows, count(*) FILTER (WHERE is_anomaly_final) AS n_final "
    "FROM post_full UNION ALL SELECT 'absent', 0, 0",
)
def scan_decisions_optional(spark, d):
    path = scratch_path(spark, "decisions")
    table = decisions_full(spark, d)
    absent = R.read_optional(spark, path, table.schema)
    sinks.write_table(table, path)
    present = R.read_optional(spark, path, table.schema)
    return ML.concat_horizons(
        [
            df.agg(
                F.count(F.lit(1)).alias("n_rows"), F.count_if("is_anomaly_final").alias("n_final")
            ).select(F.lit(name).alias("source"), "n_rows", "n_final")
            for name, df in (("present", present), ("absent", absent))
        ]
    )


def _round_trip(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    sinks.write_table(df, path)
    return spark.read.parquet(path)


def _written_by_day(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A day table after a first write and a rerun of its last day."""
    path = scratch_path(spark, name)
    rows = stage_table(df if "day" in df.columns else df.withColumn("day", T.day_of(F.col("ts"))), name)
    sinks.write_days(rows, path)
    last = rows.agg(F.max("day")).first()[0]
    sinks.write_days(rows.where(F.col("day") == F.lit(last)), path)
    return sinks.read_days(spark, path)


@query("sink_hourly", f"SELECT {PROCESSED} FROM proc")
def sink_hourly(spark, d):
    """All days are written, then the last one again."""
    return processed_columns(_written_by_day(spark, processed(spark, d), "hourly"))


ALERTS = comma(*Q.ALERT_COLUMNS)
ALERT_SQL = (
    f"SELECT {ALERTS} FROM proc WHERE flag_over10 OR itp_xvs_zero_anomaly OR odpu_gvs_zero_anomaly "
    "OR itp_xvs_flat_anomaly OR odpu_gvs_flat_anomaly"
)


@query("sink_alerts", ALERT_SQL)
def sink_alerts(spark, d):
    return _round_trip(spark, Q.alerts(processed(spark, d)), "alerts")


DAILY_SQL = f"""
SELECT *, {O.rnd('daily_rel_diff * 100', 1)} AS daily_rel_diff_pct,
       {O.rnd('CAST(hours_over10 AS DOUBLE) / hours_total * 100', 1)} AS hours_over10_pct
FROM (SELECT *, abs(odpu_gvs_m3 - itp_xvs_m3) / greatest(odpu_gvs_m3, itp_xvs_m3, 1e-12) AS daily_rel_diff
      FROM (SELECT meter_id, day, coalesce(sum(xvs_m3), 0.0::DOUBLE) AS itp_xvs_m3,
                   coalesce(sum(gvs_m3), 0.0::DOUBLE) AS odpu_gvs_m3, count(*) AS hours_total,
                   count(*) FILTER (WHERE flag_over10) AS hours_over10
            FROM bal GROUP BY meter_id, day))"""


def balanced(spark: SparkSession, d: str) -> DataFrame:
    return Q.balance(E.hourly_grid(spark, d))


@query("sink_daily", DAILY_SQL)
def sink_daily(spark, d):
    return _written_by_day(spark, Q.daily_report(balanced(spark, d)), "daily")


DECISIONS_EXACT = (
    "meter_id", "ts", "itp_xvs_m3", "odpu_gvs_m3", "delta_m3", "ratio", "z_delta", "z_ratio",
    "raw_is_anomaly", "severe", "is_anomaly", "is_anomaly_final", "top_cause",
)
DECISIONS_ROUNDED = ("top_cause_prob", *D.PROBABILITIES)
DECISION_SQL = f"{comma(*DECISIONS_EXACT)}, {O.stable_cols(*DECISIONS_ROUNDED)}"
POST_SQL = f"{DECISION_SQL}, {comma(*POST_TEXTS)}"


def decision_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*DECISIONS_EXACT, *[stable(c) for c in DECISIONS_ROUNDED], *more)


@query(
    "sink_decisions",
    f"SELECT 'test' AS scope, {POST_SQL} FROM post_test UNION ALL SELECT 'full', {POST_SQL} FROM post_full",
)
def sink_decisions(spark, d):
    tables = {"test": decisions_test(spark, d), "full": decisions_full(spark, d)}
    return ML.concat_horizons(
        [
            decision_columns(_written_by_day(spark, df, f"decisions-{scope}"), *POST_TEXTS).select(
                F.lit(scope).alias("scope"), "*"
            )
            for scope, df in tables.items()
        ]
    )


@query("sink_incidents", O.incident_sql("isl_full"))
def sink_incidents(spark, d):
    return _round_trip(spark, incidents(spark, d), "events")


@query("sink_forecasts")
def sink_forecasts(spark, d):
    hourly, daily = forecast_hours(spark, d), forecast_days(spark, d)
    both = hourly.select(
        METER, F.lit("hourly").alias("granularity"), F.col("h").alias("horizon"),
        F.col("ts_for"), "p_anomaly", "is_anomaly",
    ).unionByName(
        daily.select(
            METER, F.lit("daily").alias("granularity"), F.col("d").alias("horizon"),
            F.col("day_for").cast("timestamp_ntz").alias("ts_for"), "p_anomaly", "is_anomaly",
        )
    )
    return _round_trip(spark, both, "forecasts")


def _both_backtests(spark: SparkSession, d: str) -> DataFrame:
    """Backtests of hours and days in one table, with the time bounds as text."""
    parts = []
    for name, kind, df in (
        ("hourly", ML.HOURS, backtest_hourly(spark, d)), ("daily", ML.DAYS, backtest_daily(spark, d))
    ):
        bounds = [F.col(c).cast("string").alias(c) for c in ("train_start", "train_end", "test_start", "test_end")]
        parts.append(
            df.select(
                F.lit(name).alias("granularity"), F.col(kind.horizon).alias("horizon"),
                "fold", "f1", "roc_auc", "n_train", "n_test", "n_pos_te", *bounds,
            )
        )
    return ML.concat_horizons(parts)


@query("sink_backtests")
def sink_backtests(spark, d):
    return _round_trip(spark, _both_backtests(spark, d), "backtests")


@query("sink_metrics")
def sink_metrics(spark, d):
    path = scratch_path(spark, "metrics")
    stored = stage_table(_both_backtests(spark, d), "backtests")
    means = [
        M.metric_means(stored.where(F.col("granularity") == name), "horizon").select(
            F.lit(name).alias("granularity"), "*"
        )
        for name in ("hourly", "daily")
    ]
    sinks.write_json(ML.concat_horizons(means), path)
    return spark.read.schema("granularity string, horizon int, f1 double, roc_auc double").json(path)


@query("sink_models")
def sink_models(spark, d):
    """Train, save and load; both score all rows, and equal scores are counted."""
    path = scratch_path(spark, "models")
    table = daily_table(spark, d)
    bundle = ML.train_models(table, ML.DAYS)
    ML.save_bundle(bundle, path)
    loaded = ML.load_bundle(path, ML.DAYS)
    names = sorted({n for own in loaded.features.values() for n in own})
    rows = stage_table(P.impute(table.select(METER, "day", *names), names, ML.DAYS.layout), "scored-rows")
    parts = []
    for h, model in sorted(loaded.models.items()):
        both = ML.probability(bundle.models[h], ML.probability(model, rows, "p_loaded"), "p_saved")
        parts.append(
            both.agg(
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(F.col("p_loaded") == F.col("p_saved")).alias("n_equal"),
                F.round(F.avg("p_loaded"), 6).alias("mean_p"),
            ).select(F.lit(h).alias("horizon_d"), F.lit(len(loaded.features[h])).alias("n_features"), "*")
        )
    if not parts:
        return spark.createDataFrame(
            [], "horizon_d int, n_features int, n_rows bigint, n_equal bigint, mean_p double"
        )
    return ML.concat_horizons(parts)


# --------------------------------------------------------------------------- 2.2 time and units


def raw_texts(spark: SparkSession, d: str) -> DataFrame:
    """Delivered texts in several notations: dotted and ISO dates, three dashes, bad hours."""
    raw = E.raw_texts(E.readings(spark, d))
    first = F.split("hour_raw", "-")
    kind = T.day_number(F.to_date("date_raw", "dd.MM.yyyy")) % 4
    return raw.withColumns(
        {
            "date_raw": F.when(
                kind == 1, F.date_format(F.to_date("date_raw", "dd.MM.yyyy"), "yyyy-MM-dd")
            )
            .when(kind == 2, F.lit("n/a"))
            .otherwise(F.col("date_raw")),
            "hour_raw": F.when(kind == 3, F.concat(F.lit(" "), first[0], F.lit("–"), first[1]))
            .when(kind == 0, F.concat(first[0], F.lit("—"), first[1], F.lit(" ")))
            .otherwise(F.col("hour_raw")),
            "hour_shift": F.when(kind == 1, F.lit(1)).otherwise(F.lit(0)),
        }
    ).withColumn(
        "hour_raw",
        F.when(
            F.col("hour_shift") == 1,
            F.concat(first[1], F.lit("-"), (first[1].cast("int") + 1).cast("string")),
        ).otherwise(F.col("hour_raw")),
    ).drop("hour_shift")


_KIND = "CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) % 4"
TEXTS = f"""(SELECT meter_id, ts AS true_ts,
  CASE {_KIND} WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN 'n/a' ELSE strftime(ts, '%d.%m.%Y') END AS date_raw,
  CASE {_KIND} WHEN 3 THEN ' ' || hour(ts) || chr(8211) || (hour(ts) + 1)
    WHEN 0 THEN hour(ts) || chr(8212) || (hour(ts) + 1) || ' '
    WHEN 1 THEN (hour(ts) + 1) || '-' || (hour(ts) + 2) ELSE hour(ts) || '-' || (hour(ts) + 1) END AS hour_raw,
  xvs_m3 FROM reads)"""
PARSED = f"""(SELECT *, coalesce(try_strptime(date_raw, '%d.%m.%Y'), try_cast(date_raw AS TIMESTAMP)) AS date,
  try_cast(regexp_extract(trim(replace(replace(hour_raw, chr(8211), '-'), chr(8212), '-')),
                          '-(\\d{{1,2}})$', 1) AS INTEGER) AS hour_idx FROM {TEXTS})"""


@query("parse_date", f"SELECT meter_id, date_raw, date, count(*) AS n FROM {PARSED} GROUP BY ALL")
def parse_date(spark, d):
    parsed = raw_texts(spark, d).withColumn("date", T.parse_date(F.col("date_raw")))
    return parsed.groupBy(METER, "date_raw", "date").agg(F.count(F.lit(1)).alias("n"))


@query(
    "parse_hour_interval",
    f"SELECT meter_id, hour_raw, hour_idx, count(*) AS n FROM {PARSED} GROUP BY ALL",
)
def parse_hour_interval(spark, d):
    parsed = raw_texts(spark, d).withColumn("hour_idx", T.parse_hour_bound(F.col("hour_raw")))
    return parsed.groupBy(METER, "hour_raw", "hour_idx").agg(F.count(F.lit(1)).alias("n"))


VALID = f"(SELECT * FROM {PARSED} WHERE date IS NOT NULL AND hour_idx BETWEEN 1 AND 24)"


@query("filter_valid_hours", f"SELECT meter_id, date_raw, hour_raw, date, hour_idx, xvs_m3 FROM {VALID}")
def filter_valid_hours(spark, d):
    return G.parse_reading_times(raw_texts(spark, d)).select(
        METER, "date_raw", "hour_raw", "date", "hour_idx", "xvs_m3"
    )


@query(
    "hour_start_ts",
    f"SELECT meter_id, date, hour_idx, date + INTERVAL 1 HOUR * (hour_idx - 1) AS ts, xvs_m3 FROM {VALID}",
)
def hour_start_ts(spark, d):
    return G.parse_reading_times(raw_texts(spark, d)).select(
        METER, "date", "hour_idx", "ts", "xvs_m3"
    )


GRID = comma("meter_id", "ts", "day", "hour_idx", *CHANNELS, "series_start", "series_end")


@query("hourly_gap_fill", f"SELECT {GRID} FROM plain_grid")
def hourly_gap_fill(spark, d):
    return G.hourly_gap_fill(E.readings(spark, d)).select(*GRID.split(", "))


@query(
    "duplicate_hour_guard",
    "SELECT meter_id, hour_ts AS ts, count(*) AS n_rows FROM ev GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_hour_guard(spark, d):
    """Hours that several events fall into: what the grid refuses to merge silently."""
    hours = E.meter_events(spark, d).select(METER, T.hour_floor(F.col("ts")).alias("ts"))
    return G.duplicate_hours(hours)


@query(
    "harmonize_units",
    "SELECT meter_id, ts, xvs_m3 * 1000 AS xvs_m3, gvs_m3 * 0.5::DOUBLE AS gvs_m3, "
    "supply_m3, return_m3 FROM plain_grid",
)
def harmonize_units(spark, d):
    """Channels that arrive as text, in litres and half cubic metres; bad text becomes NULL."""
    texts = G.hourly_gap_fill(E.readings(spark, d)).select(
        *KEYS, *[F.col(c).cast("string").alias(c) for c in G.VOLUMES]
    )
    marked = texts.withColumns({c: F.coalesce(c, F.lit("bad")) for c in G.VOLUMES})
    return G.harmonize_units(marked, replace(DEFAULTS, xvs_factor=1000.0, gvs_factor=0.5))


_PROXY = O.clip0("(supply_m3 - return_m3)")


@query(
    "recirculation_proxy",
    f"""SELECT 'override' AS variant, meter_id, ts, {_PROXY} AS odpu_proxy_net, {_PROXY} AS gvs_m3 FROM grid
    UNION ALL SELECT 'missing', meter_id, ts, {_PROXY}, {_PROXY} FROM grid
    UNION ALL SELECT 'present', meter_id, ts, {_PROXY}, gvs_m3 FROM grid""",
)
def recirculation_proxy(spark, d):
    hours = E.hourly_grid(spark, d)
    variants = {
        "override": {"override": True},
        "missing": {"gvs_present": False},
        "present": {},
    }
    return ML.concat_horizons(
        [
            G.recirculation_proxy(hours, enabled=True, **options).select(
                F.lit(name).alias("variant"), *KEYS, "odpu_proxy_net", "gvs_m3"
            )
            for name, options in variants.items()
        ]
    )


@query("balance", "SELECT meter_id, ts, rel_diff, diff_m3, flag_over10 FROM bal")
def balance(spark, d):
    return balanced(spark, d).select(*KEYS, "rel_diff", "diff_m3", "flag_over10")


@query("reason_hint", "SELECT meter_id, ts, flag_over10, reason_hint FROM proc")
def reason_hint(spark, d):
    return processed(spark, d).select(*KEYS, "flag_over10", "reason_hint")


@query("alerts", ALERT_SQL)
def alerts(spark, d):
    return Q.alerts(processed(spark, d))


@query(
    "train_test_tail_split",
    "SELECT meter_id, ts, xvs_m3, gvs_m3, is_train, is_test FROM tail WHERE is_train OR is_test",
)
def train_test_tail_split(spark, d):
    return G.train_test_tail(E.hourly_grid(spark, d)).where("is_train OR is_test").select(
        *KEYS, "xvs_m3", "gvs_m3", "is_train", "is_test"
    )


NUMERIC = [
    "hour_idx", *CHANNELS, "rel_diff", "diff_m3", "flag_over10", *O.QUALITY_COLUMNS.split(", "),
]
_BOOLEANS = [c for c in NUMERIC if c.endswith(("_anomaly", "_spike", "over10"))]


@query(
    "numeric_feature_projection",
    "SELECT meter_id, ts, "
    + comma(*[f"CAST({c} AS INTEGER) AS {c}" if c in _BOOLEANS else c for c in NUMERIC])
    + " FROM proc",
)
def numeric_feature_projection(spark, d):
    return X.numeric_features(processed_columns(processed(spark, d)))


@query(
    "feature_column_set",
    "SELECT CAST(pos AS INTEGER) AS pos, name FROM (SELECT unnest(range(len(names))) AS pos, unnest(names) AS name "
    "FROM (SELECT ["
    + comma(
        *[
            f"'{c}'"
            for c in [*O.RAW_FEATURES, *X.rolled_names(X.HOURLY_BASES, (1, 2, 3, 4, 5, 6), (2, 3, 4, 6), "h"),
                      "sin_how", "cos_how"]
        ]
    )
    + "] AS names WHERE (SELECT count(*) FROM events) > 0))",
)
def feature_column_set(spark, d):
    """Names of the hourly feature table, read from the table itself, with data in each of them."""
    table = X.hourly_features(X.hourly_base(processed(spark, d)))
    names = X.hourly_feature_names(table)
    rows = table.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return rows.select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("pos", "name"))


@query("calendar_features", "SELECT meter_id, ts, dow, hour, how FROM base")
def calendar_features(spark, d):
    return X.calendar_features(E.hourly_grid(spark, d)).select(*KEYS, "dow", "hour", "how")


@query(
    "cyclic_features_week",
    f"SELECT meter_id, ts, {O.stable('sin(how * (2 * pi()) / 168)')} AS sin_how, "
    f"{O.stable('cos(how * (2 * pi()) / 168)')} AS cos_how FROM base",
)
def cyclic_features_week(spark, d):
    df = X.cyclic_week(X.calendar_features(E.hourly_grid(spark, d)))
    return df.select(*KEYS, stable("sin_how"), stable("cos_how"))


@query(
    "cyclic_features_dow",
    f"SELECT meter_id, day, dow, dow_cat, day_idx, {O.stable_cols('week_sin', 'week_cos')} FROM days",
)
def cyclic_features_dow(spark, d):
    days = E.hourly_grid(spark, d).groupBy(METER, "day").agg(
        F.min("series_start").alias("series_start")
    )
    return X.cyclic_day(days).select(
        METER, "day", "dow", "dow_cat", "day_idx", stable("week_sin"), stable("week_cos")
    )


@query(
    "weekday_normalize",
    "SELECT 'one_based' AS coding, meter_id, ts, weekday, weekday_norm FROM grid "
    "UNION ALL SELECT 'zero_based', meter_id, ts, weekday - 1, weekday - 1 FROM grid "
    "UNION ALL SELECT 'invalid', meter_id, ts, weekday + 1, NULL FROM grid",
)
def weekday_normalize(spark, d):
    hours = E.hourly_grid(spark, d).drop("weekday_low", "weekday_high")
    codings = {"one_based": 0, "zero_based": -1, "invalid": 1}
    return ML.concat_horizons(
        [
            G.weekday_normalize(hours.withColumn("weekday", F.col("weekday") + shift)).select(
                F.lit(name).alias("coding"), *KEYS, "weekday", "weekday_norm"
            )
            for name, shift in codings.items()
        ]
    )


@query(
    "hour_of_week",
    "SELECT meter_id, ts, weekday_norm, "
    "CAST(coalesce(weekday_norm, isodow(ts) - 1) * 24 + hour(ts) AS INTEGER) AS how FROM grid",
)
def hour_of_week(spark, d):
    how = T.hour_of_week(F.col("weekday_norm"), F.col("ts"))
    return grid(spark, d).select(*KEYS, "weekday_norm", how.alias("how"))


@query(
    "safe_numeric",
    "SELECT event_id, coalesce(try_cast(CASE event_type WHEN 'error' THEN 'x' || value "
    "ELSE CAST(value AS VARCHAR) END AS DOUBLE), -1.0::DOUBLE) AS number, "
    "CASE WHEN event_type <> 'error' THEN value END AS number_or_null FROM ev",
)
def safe_numeric(spark, d):
    text = F.when(
        F.col("event_type") == "error", F.concat(F.lit("x"), F.col("value").cast("string"))
    ).otherwise(F.col("value").cast("string"))
    return spark.read.parquet(f"{d}/events.parquet").select(
        "event_id",
        N.number_or(text, -1.0).alias("number"),
        N.parse_number(text).alias("number_or_null"),
    )


# --------------------------------------------------------------------------- 2.3 joins


@query("label_join", "SELECT meter_id, ts, is_anomaly_final, label FROM base")
def label_join(spark, d):
    """Hours and decisions as two stored tables."""
    stored = stage_table(detected(spark, d), "detected")
    hours = stage_table(processed_columns(stored), "hours")
    decisions = stage_table(stored.select(*D.DECISION_COLUMNS), "decisions")
    return X.hourly_base(hours, decisions).select(*KEYS, "is_anomaly_final", "label")


BASE_ROUNDED = ("beta_delta_w", "beta_ratio_w")
BASE_EXACT = tuple(c for c in B.STATISTICS if c not in BASE_ROUNDED)


@query(
    "baseline_lookup_join",
    f"SELECT meter_id, ts, how, {comma(*BASE_EXACT)}, {O.stable_cols(*BASE_ROUNDED)} FROM found",
)
def baseline_lookup_join(spark, d):
    hours = grid(spark, d)
    return D.baseline_lookup(hours, fitted(hours)).select(
        *KEYS, "how", *BASE_EXACT, *[stable(c) for c in BASE_ROUNDED]
    )


@query(
    "grid_left_join",
    "SELECT meter_id, how, mu_delta IS NOT NULL AS known FROM "
    "(SELECT meter_id, CAST(unnest(range(168)) AS INTEGER) AS how FROM overall) "
    "LEFT JOIN slots USING (meter_id, how)",
)
def grid_left_join(spark, d):
    """The full week of every meter next to the slots its training window contains."""
    slots = B.baseline_slots(train(spark, d)).select(METER, "how", "mu_delta")
    week = slots.select(METER).distinct().select(
        METER, F.explode(F.sequence(F.lit(0), F.lit(167))).alias("how")
    )
    return week.join(slots, [METER, "how"], "left").select(
        METER, "how", F.col("mu_delta").isNotNull().alias("known")
    )


@query(
    "cause_label_lookup",
    f"SELECT event_type, {O.lookup('code', CAUSE_LABEL, repr(UNKNOWN_LABEL))} AS cause_label, "
    f"{O.lookup('code', CAUSE_RULE, repr(UNKNOWN_LABEL))} AS cause_rule, count(*) AS n "
    "FROM (SELECT event_type, CASE event_type WHEN 'view' THEN 'leak' WHEN 'click' THEN 'tech' "
    "WHEN 'error' THEN 'normal' ELSE event_type END AS code FROM ev) GROUP BY ALL",
)
def cause_label_lookup(spark, d):
    code = (
        F.when(F.col("event_type") == "view", "leak")
        .when(F.col("event_type") == "click", "tech")
        .when(F.col("event_type") == "error", "normal")
        .otherwise(F.col("event_type"))
    )
    coded = spark.read.parquet(f"{d}/events.parquet").select("event_type", code.alias("top_cause"))
    return D.cause_texts(coded).groupBy("event_type", "cause_label", "cause_rule").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "horizon_label_align",
    "SELECT meter_id, day, d.itp_xvs_m3, l.y_1, l.y_2, l.y_3 FROM days d JOIN labels_d l USING (meter_id, day)",
)
def horizon_label_align(spark, d):
    b = stage_table(base(spark, d), "base")
    days = X.daily_table(b).select(METER, "day", "itp_xvs_m3")
    return X.align_day_labels(days, X.day_horizon_labels(X.day_labels(b)))


# --------------------------------------------------------------------------- 2.4 aggregations


@query("daily_report", DAILY_SQL)
def daily_report(spark, d):
    return Q.daily_report(balanced(spark, d))


DAYS_EXACT = (
    "meter_id", "day", "itp_xvs_m3", "odpu_gvs_m3", "delta_m3_sum", "hours", "bad_hours", "dow",
    "bad_hours_share",
)
DAYS_ROUNDED = ("delta_m3_mean", "ratio_mean", "rel_diff_mean")


@query(
    "daily_feature_agg",
    f"SELECT {comma(*DAYS_EXACT)}, {O.stable_cols(*DAYS_ROUNDED)} FROM days",
)
def daily_feature_agg(spark, d):
    return X.daily_table(base(spark, d)).select(*DAYS_EXACT, *[stable(c) for c in DAYS_ROUNDED])


@query(
    "robust_mad",
    f"SELECT meter_id, event_type, count(*) AS n, {O.stable(O._mad('v', O.quantile('v', 0.5)))} AS sigma "
    "FROM (SELECT meter_id, event_type, cents, list_sort(list(CAST(cents AS DOUBLE)) OVER "
    "(PARTITION BY meter_id, event_type)) AS v FROM ev) GROUP BY meter_id, event_type, v",
)
def robust_mad(spark, d):
    """Deviation of event amounts per meter and kind, from value counts: a hot group collapses to
    its distinct amounts before anything is ordered."""
    amounts = E.meter_events(spark, d).groupBy(METER, "event_type", "cents").agg(
        F.count(F.lit(1)).alias("n")
    )
    keys = [METER, "event_type"]
    center = amounts.groupBy(*keys).agg(
        F.percentile("cents", 0.5, F.col("n")).alias("center"), F.sum("n").alias("total")
    )
    deviation = F.abs(F.col("cents") - F.col("center"))
    return (
        amounts.join(center, keys)
        .groupBy(*keys)
        .agg(F.max("total").alias("n"), F.percentile(deviation, 0.5, F.col("n")).alias("mad"))
        .select(*keys, "n", (F.col("mad") * DEFAULTS.mad_scale + DEFAULTS.sigma_floor).alias("sigma"))
        .select(*keys, "n", stable("sigma"))
    )


SLOTS = f"meter_id, how, {comma(*BASE_EXACT)}, {O.stable_cols(*BASE_ROUNDED)}"


@query("baseline_fit", f"SELECT {SLOTS} FROM slots")
def baseline_fit(spark, d):
    """Value counts of the training window without its newest day are stored; the refit reads
    that day and adds it."""
    rows = stage_table(train(spark, d), "train")
    age = T.hour_number(F.col("series_end")) - T.hour_number(F.col("ts"))
    newest = age < 24 * (DEFAULTS.test_days + 1)
    counts = stage_table(B.value_counts(rows.where(~newest)), "baseline-counts")
    return B.slots_of_counts(B.refit(counts, rows.where(newest))).select(
        METER, "how", *BASE_EXACT, *[stable(c) for c in BASE_ROUNDED]
    )


@query(
    "weather_beta",
    f"SELECT meter_id, how, {O.stable_cols('w_med', 'beta_delta_w', 'beta_ratio_w')} FROM slots_loose",
)
def weather_beta(spark, d):
    """Slopes with a lower point minimum: a month has at most five points per hour of the week."""
    loose = replace(DEFAULTS, beta_min_points=3)
    return B.baseline_slots(train(spark, d), loose).select(
        METER, "how", stable("w_med"), stable("beta_delta_w"), stable("beta_ratio_w")
    )


@query("baseline_fill_168", f"SELECT {SLOTS} FROM base168")
def baseline_fill_168(spark, d):
    return baseline(spark, d).select(
        METER, "how", *BASE_EXACT, *[stable(c) for c in BASE_ROUNDED]
    )


@query(
    "global_sigma",
    "SELECT meter_id, global_sigma_delta, global_sigma_ratio FROM overall",
)
def global_sigma(spark, d):
    return B.global_sigma(train(spark, d))


ISLAND_LAYOUT = HOURLY.needing(before=1)
FEATURE_LAYOUT = HOURLY.needing(before=max(*DEFAULTS.lags_hours, *DEFAULTS.roll_windows_h))


def island_parts(spark: SparkSession, d: str) -> DataFrame:
    """Islands over stored decisions in parts."""
    parts = store_parts(decisions_full(spark, d), "decisions", ISLAND_LAYOUT)
    return I.incident_islands(parts, layout=ISLAND_LAYOUT)


def flow_parts(spark: SparkSession, d: str) -> DataFrame:
    """Flows of stored processed hours in parts."""
    return store_parts(X.flow_features(processed(spark, d)), "processed", FEATURE_LAYOUT)


@query("incidents", O.incident_sql("isl_full"))
def incidents(spark, d):
    return I.island_incidents(core(island_parts(spark, d), ISLAND_LAYOUT))


@query("label_day_max", "SELECT meter_id, day, day_label FROM day_lab")
def label_day_max(spark, d):
    return X.day_labels(base(spark, d))


# A deterministic score: the relative difference of an hour against the label six hours later.
SCORED_SQL = (
    "(SELECT meter_id, h AS horizon_h, y, coalesce(rel_diff, 0.0::DOUBLE) AS score FROM ("
    + " UNION ALL ".join(f"SELECT meter_id, rel_diff, {h} AS h, y_{h} AS y FROM labels_h" for h in range(1, 7))
    + "))"
)
F1_SQL = (
    "SELECT {keys}, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE "
    "ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1 FROM (SELECT {keys}, "
    "count(*) FILTER (WHERE score >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND y = 0) AS fp, "
    "count(*) FILTER (WHERE score < 0.5 AND y = 1) AS fn FROM {source} GROUP BY {keys})"
)
AUC_SQL = (
    "SELECT {keys}, CASE WHEN pos > 0 AND neg > 0 "
    "THEN (rank_sum - pos * (pos + 1) / 2.0::DOUBLE) / (pos * neg) END AS roc_auc "
    "FROM (SELECT {keys}, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS pos, "
    "CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS neg, "
    "coalesce(sum(mean_rank) FILTER (WHERE y = 1), 0) AS rank_sum FROM (SELECT *, "
    "rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0::DOUBLE "
    "AS mean_rank FROM {source}) GROUP BY {keys})"
)


def scored_hours(spark: SparkSession, d: str) -> DataFrame:
    labels = X.hour_horizon_labels(base(spark, d).select(*KEYS, "rel_diff", "label"))
    long = P.horizon_rows(labels, DEFAULTS.hour_horizons, "horizon_h")
    return long.withColumn("score", F.coalesce("rel_diff", F.lit(0.0)))


METER_H = "meter_id, horizon_h"


@query("metric_f1", F1_SQL.format(keys=METER_H, source=SCORED_SQL))
def metric_f1(spark, d):
    return M.f1_score(scored_hours(spark, d), (METER, "horizon_h"))


@query(
    "metric_roc_auc",
    f"SELECT {METER_H}, {O.stable('roc_auc')} AS roc_auc FROM ({AUC_SQL.format(keys=METER_H, source=SCORED_SQL)})",
)
def metric_roc_auc(spark, d):
    auc = M.roc_auc(scored_hours(spark, d), (METER, "horizon_h"))
    return auc.select(METER, "horizon_h", stable("roc_auc"))


@query(
    "cv_metric_mean",
    f"SELECT horizon_h, {O.rnd('avg(f1)', 4)} AS f1, {O.rnd('avg(roc_auc)', 4)} AS roc_auc "
    f"FROM ({F1_SQL.format(keys=METER_H, source=SCORED_SQL)}) "
    f"JOIN ({AUC_SQL.format(keys=METER_H, source=SCORED_SQL)}) USING (meter_id, horizon_h) GROUP BY horizon_h",
)
def cv_metric_mean(spark, d):
    scored = stage(scored_hours(spark, d))
    keys = (METER, "horizon_h")
    return M.metric_means(
        M.f1_score(scored, keys).join(M.roc_auc(scored, keys), list(keys)), "horizon_h"
    )


SCREENED = [
    "xvs_m3", "gvs_m3", "supply_m3", "return_m3", "t1", "t2", "hour_idx", "itp_xvs_zero",
    "itp_xvs_flat_run", "odpu_gvs_flat_run", "odpu_gvs_zero_run",
]


@query(
    "variance_filter",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature FROM proc HAVING count(DISTINCT coalesce({c}, 0)) > 1" for c in SCREENED
    ),
)
def variance_filter(spark, d):
    hours = processed(spark, d).select(*[F.coalesce(c, F.lit(0)).alias(c) for c in SCREENED])
    return P.varying_features(hours, SCREENED)


@query(
    "run_summary",
    "SELECT 'training_days_used' AS name, CAST(29 AS BIGINT) AS value UNION ALL SELECT 'test_days_used', 1 "
    "UNION ALL SELECT 'rows_processed', count(*) FROM proc "
    f"UNION ALL SELECT 'alerts_count', count(*) FROM ({ALERT_SQL}) "
    f"UNION ALL SELECT 'days', count(*) FROM ({DAILY_SQL})",
)
def run_summary(spark, d):
    hours = stage_table(processed(spark, d), "processed")
    return runs.run_summary(hours, Q.alerts(hours), Q.daily_report(hours))


@query(
    "label_match_stats",
    "SELECT count(*) AS n_rows, count(is_anomaly_final) AS n_matched, "
    "count(*) FILTER (WHERE label) AS n_ones FROM base",
)
def label_match_stats(spark, d):
    return X.label_match_stats(base(spark, d))


# --------------------------------------------------------------------------- 2.5 windows


@query(
    "run_length",
    "SELECT meter_id, ts, CASE WHEN over THEN CAST(sum(CAST(over AS INTEGER)) OVER "
    "(PARTITION BY meter_id, island ORDER BY ts) AS INTEGER) ELSE 0 END AS over_run FROM "
    "(SELECT meter_id, ts, flag_over10 AS over, sum(CASE WHEN flag_over10 THEN 0 ELSE 1 END) "
    "OVER (PARTITION BY meter_id ORDER BY ts) AS island FROM bal)",
)
def run_length(spark, d):
    """Consecutive hours over the balance limit."""
    hours = store_parts(balanced(spark, d).select(*KEYS, "flag_over10"), "balanced", HOURLY)
    runs_of = Q.run_length(hours, F.col("flag_over10"), "over_run")
    return core(runs_of, HOURLY).select(*KEYS, "over_run")


def _quality(kind: str) -> list[str]:
    suffixes = [kind] if kind == "spike" else [kind, f"{kind}_run", f"{kind}_anomaly"]
    return [f"{p}_{s}" for p in Q.CHANNELS.values() for s in suffixes]


def _quality_query(name: str, kind: str) -> None:
    @query(name, f"SELECT meter_id, ts, {comma(*_quality(kind))} FROM flagged")
    def run(spark, d):
        return Q.quality_flags(E.hourly_grid(spark, d)).select(*KEYS, *_quality(kind))


_quality_query("zero_run_flag", "zero")
_quality_query("flatline_flag", "flat")
_quality_query("iqr_spike", "spike")


@query("persistence_filter", "SELECT meter_id, ts, raw_is_anomaly, severe, is_anomaly_final FROM post_full")
def persistence_filter(spark, d):
    parts = D.persistence_filter(decided_parts(grid(spark, d)), layout=runs.RUN_LAYOUT)
    return core(parts, runs.RUN_LAYOUT).select(
        *KEYS, "raw_is_anomaly", "severe", "is_anomaly_final"
    )


@query("persistence_filter_basic", "SELECT meter_id, ts, is_anomaly FROM post_basic")
def persistence_filter_basic(spark, d):
    return D.persistence_filter_basic(decided(spark, d).where("is_test")).select(
        *KEYS, "is_anomaly"
    )


@query("incident_islands", "SELECT meter_id, ts, is_anomaly, top_cause, island_start FROM isl_full")
def incident_islands(spark, d):
    return core(island_parts(spark, d), ISLAND_LAYOUT).select(
        *KEYS, "is_anomaly", "top_cause", "island_start"
    )


@query("hourly_lags", f"SELECT meter_id, ts, {comma(*O.LAGS_H)} FROM lagged")
def hourly_lags(spark, d):
    lags = X.hourly_lags(flow_parts(spark, d), layout=FEATURE_LAYOUT)
    return core(lags, FEATURE_LAYOUT).select(*KEYS, *O.LAGS_H)


@query("hourly_rolling", f"SELECT meter_id, ts, {O.stable_cols(*O.ROLLS_H)} FROM rolled")
def hourly_rolling(spark, d):
    rolled = X.hourly_rolling(flow_parts(spark, d), layout=FEATURE_LAYOUT)
    return core(rolled, FEATURE_LAYOUT).select(*KEYS, *[stable(c) for c in O.ROLLS_H])


def daily_windows(spark: SparkSession, d: str) -> DataFrame:
    return X.daily_features(X.daily_table(base(spark, d)))


@query(
    "daily_lags",
    f"SELECT meter_id, day, {O.stable_cols(*O.LAGS_D)} FROM (SELECT *, "
    f"{comma(*O.lag_sql(X.DAILY_BASES, (1, 2), 'd', 'day'))} FROM days)",
)
def daily_lags(spark, d):
    return daily_windows(spark, d).select(METER, "day", *[stable(c) for c in O.LAGS_D])


@query(
    "daily_rolling",
    f"SELECT meter_id, day, {O.stable_cols(*O.ROLLS_D)} FROM (SELECT *, "
    f"{comma(*O.roll_sql(X.DAILY_BASES, (2, 3), 'd', 'day'))} FROM days)",
)
def daily_rolling(spark, d):
    return daily_windows(spark, d).select(METER, "day", *[stable(c) for c in O.ROLLS_D])


@query(
    "daily_diff",
    f"SELECT meter_id, day, {O.stable_cols(*O.DIFFS_D)} FROM (SELECT *, "
    + comma(
        *[f"{b} - lag({b}, 1) OVER (PARTITION BY meter_id ORDER BY day) AS {b}_diff1" for b in X.DAILY_BASES]
    )
    + " FROM days)",
)
def daily_diff(spark, d):
    return daily_windows(spark, d).select(METER, "day", *[stable(c) for c in O.DIFFS_D])


YS_H = [f"y_{h}" for h in DEFAULTS.hour_horizons]


@query("hour_horizon_labels", f"SELECT meter_id, ts, label, {comma(*YS_H)} FROM labels_h")
def hour_horizon_labels(spark, d):
    return X.hour_horizon_labels(base(spark, d).select(*KEYS, "label"))


@query("day_horizon_labels", "SELECT meter_id, day, day_label, y_1, y_2, y_3 FROM labels_d")
def day_horizon_labels(spark, d):
    return X.day_horizon_labels(X.day_labels(base(spark, d)))


SHIFTED = ["delta_m3", "ratio", "rel_diff", "xvs_m3", "gvs_m3", "itp_xvs_zero_run", "how"]


@query(
    "feature_horizon_shift",
    " UNION ALL ".join(
        f"SELECT {h} AS horizon_h, meter_id, ts, "
        + comma(*[f"lag({c}, {h}) OVER (PARTITION BY meter_id ORDER BY ts) AS {c}" for c in SHIFTED])
        + " FROM base"
        for h in DEFAULTS.hour_horizons
    ),
)
def feature_horizon_shift(spark, d):
    table = stage_table(
        X.hourly_base(processed(spark, d)).select(*KEYS, *SHIFTED), "shift-input"
    )
    return ML.concat_horizons(
        [
            X.shift_features(table, SHIFTED, h).select(
                F.lit(h).alias("horizon_h"), *KEYS, *SHIFTED
            )
            for h in DEFAULTS.hour_horizons
        ]
    )


IMPUTED = ["delta_m3", "ratio", "t1", "supply_m3"]
_GROUP = "PARTITION BY meter_id, fold, role ORDER BY ts ROWS BETWEEN"


@query(
    "ffill_bfill_impute",
    "SELECT meter_id, ts, fold, role, "
    + comma(
        *[
            f"coalesce(last_value({c} IGNORE NULLS) OVER ({_GROUP} UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({c} IGNORE NULLS) OVER ({_GROUP} CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0::DOUBLE) AS {c}"
            for c in IMPUTED
        ]
    )
    + " FROM splits_h",
)
def ffill_bfill_impute(spark, d):
    hours = X.flow_features(E.hourly_grid(spark, d))
    rows = hours.select(*KEYS, "series_start", "series_end", *IMPUTED)
    return P.impute_folds(rows, IMPUTED).select(*KEYS, "fold", "role", *IMPUTED)


@query("expanding_splits", "SELECT meter_id, ts, fold, role FROM splits_h")
def expanding_splits(spark, d):
    return P.expanding_splits(E.hourly_grid(spark, d)).select(*KEYS, "fold", "role")


# --------------------------------------------------------------------------- 2.6 order, top, union


@query("sort_by_ts", ALERT_SQL + " ORDER BY ts, meter_id")
def sort_by_ts(spark, d):
    return Q.alerts(processed(spark, d)).orderBy("ts", METER)


@query(
    "latest_decision",
    f"""SELECT meter_id, ts, is_anomaly, {O.lookup('top_cause', CAUSE_LABEL, 'top_cause')} AS top_cause,
    {O.rnd('top_cause_prob', 3)} AS top_cause_prob, {O.rnd('delta_m3', 4)} AS delta_m3,
    {O.rnd('ratio', 4)} AS ratio, {O.rnd('z_delta', 2)} AS z_delta, {O.rnd('z_ratio', 2)} AS z_ratio
    FROM post_test QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY ts DESC) = 1""",
)
def latest_decision(spark, d):
    return D.latest_decision(decisions_test(spark, d))


@query(
    "latest_feature_row",
    f"SELECT meter_id, ts, {comma(*O.LAGS_H)} FROM lagged "
    "QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY ts DESC) = 1",
)
def latest_feature_row(spark, d):
    lags = X.hourly_lags(X.flow_features(processed(spark, d))).select(*KEYS, *O.LAGS_H)
    return G.latest_per_meter(lags)


@query("argmax_cause", "SELECT meter_id, ts, is_anomaly, top_cause FROM dec")
def argmax_cause(spark, d):
    return decided(spark, d).select(*KEYS, "is_anomaly", D.top_cause().alias("top_cause"))


@query(
    "concat_horizons",
    " UNION ALL ".join(
        f"SELECT CAST({h} AS INTEGER) AS horizon_h, meter_id, count(*) AS n, "
        f"CAST(sum(y_{h}) AS BIGINT) AS n_pos FROM labels_h GROUP BY meter_id"
        for h in DEFAULTS.hour_horizons
    ),
)
def concat_horizons(spark, d):
    labels = stage(X.hour_horizon_labels(base(spark, d).select(*KEYS, "label")))
    return ML.concat_horizons(
        [
            labels.groupBy(METER)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(f"y_{h}").alias("n_pos"))
            .select(F.lit(h).alias("horizon_h"), METER, "n", "n_pos")
            for h in DEFAULTS.hour_horizons
        ]
    )


# --------------------------------------------------------------------------- 2.7 detector


@query(
    "zscores",
    "SELECT meter_id, ts, itp_xvs_m3, odpu_gvs_m3, delta_m3, ratio, z_delta, z_ratio FROM z",
)
def zscores(spark, d):
    hours = grid(spark, d)
    return D.zscores(D.baseline_lookup(hours, fitted(hours))).select(
        *KEYS, "itp_xvs_m3", "odpu_gvs_m3", "delta_m3", "ratio", "z_delta", "z_ratio"
    )


@query("quantile_corridor", "SELECT meter_id, ts, corridor_flag FROM corridor")
def quantile_corridor(spark, d):
    hours = grid(spark, d)
    scored = D.zscores(D.baseline_lookup(hours, fitted(hours)))
    return D.quantile_corridor(scored).select(*KEYS, "corridor_flag")


@query("anomaly_decision", "SELECT meter_id, ts, raw_is_anomaly, severe, is_anomaly FROM decided")
def anomaly_decision(spark, d):
    hours = grid(spark, d)
    scored = D.zscores(D.baseline_lookup(Q.balance(hours), fitted(hours)))
    return D.anomaly_decision(scored).select(*KEYS, "raw_is_anomaly", "severe", "is_anomaly")


LOGS = [f"logp_{c}" for c in CAUSE_PRIOR]


@query("cause_scores", f"SELECT meter_id, ts, {O.stable_cols(*LOGS)} FROM logs")
def cause_scores(spark, d):
    hours = grid(spark, d)
    flagged = core(processed_parts(hours), runs.RUN_LAYOUT)
    scored = D.zscores(D.baseline_lookup(flagged, fitted(hours)))
    return D.cause_scores(scored).select(*KEYS, *[stable(c) for c in LOGS])


@query("tech_signal", "SELECT meter_id, ts, tech_signal FROM decided")
def tech_signal(spark, d):
    hours = E.hourly_grid(spark, d)
    return hours.select(*KEYS, D.tech_signal(hours.columns).alias("tech_signal"))


@query("cause_posteriors", f"SELECT meter_id, ts, {O.stable_cols(*D.PROBABILITIES)} FROM posts")
def cause_posteriors(spark, d):
    return decided(spark, d).select(*KEYS, *[stable(c) for c in D.PROBABILITIES])


@query("detect_hours", f"SELECT {DECISION_SQL} FROM dec")
def detect_hours(spark, d):
    return decision_columns(decided(spark, d))


@query(
    "decision_postprocess",
    f"SELECT 'full' AS variant, {POST_SQL}, {comma(*PERCENTS)} FROM post_full "
    f"UNION ALL SELECT 'basic', {POST_SQL}, {comma(*PERCENTS)} FROM post_basic",
)
def decision_postprocess(spark, d):
    scored = stage_table(decided(spark, d), "decided")
    variants = {
        "full": D.decision_postprocess(scored),
        "basic": D.decision_postprocess(scored.where("is_test"), basic=True),
    }
    return ML.concat_horizons(
        [
            decision_columns(df, *POST_TEXTS, *PERCENTS).select(F.lit(name).alias("variant"), "*")
            for name, df in variants.items()
        ]
    )


# --------------------------------------------------------------------------- 2.8 models


@query(
    "class_weights",
    "SELECT meter_id, ts, y_1 AS y, CASE WHEN y_1 = 1 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM labels_h",
)
def class_weights(spark, d):
    labels = X.hour_horizon_labels(base(spark, d).select(*KEYS, "label"))
    return P.class_weights(labels.select(*KEYS, F.col("y_1").alias("y")))


@query(
    "backtest_fold_facts",
    "SELECT meter_id, horizon_h, fold, count(*) FILTER (WHERE role = 'train') AS n_train, "
    "count(*) FILTER (WHERE role = 'test') AS n_test, "
    "CAST(coalesce(sum(y) FILTER (WHERE role = 'test'), 0) AS BIGINT) AS n_pos_te, "
    "min(ts) FILTER (WHERE role = 'train') AS train_start, max(ts) FILTER (WHERE role = 'train') AS train_end, "
    "min(ts) FILTER (WHERE role = 'test') AS test_start, max(ts) FILTER (WHERE role = 'test') AS test_end FROM ("
    + " UNION ALL ".join(
        f"SELECT s.meter_id, s.ts, fold, role, {h} AS horizon_h, y_{h} AS y "
        "FROM splits_h s JOIN labels_h l ON l.meter_id = s.meter_id AND l.ts = s.ts"
        for h in DEFAULTS.hour_horizons
    )
    + ") GROUP BY meter_id, horizon_h, fold",
)
def backtest_fold_facts(spark, d):
    labels = X.hour_horizon_labels(
        base(spark, d).select(*KEYS, "series_start", "series_end", "label")
    )
    long = P.horizon_rows(P.expanding_splits(labels), DEFAULTS.hour_horizons, "horizon_h")
    return P.fold_facts(long, (METER, "horizon_h"))


# Random volumes give many hour-of-week slots a deviation of almost zero, so by default every day
# has a severe hour and daily labels have one class. Daily models therefore label longer runs only.
LONG_RUNS = replace(DEFAULTS, z_severe=1e7, min_duration_h=8)


def daily_table(spark: SparkSession, d: str) -> DataFrame:
    return ML.labelled_days(base(spark, d, LONG_RUNS))


@query("train_hourly_models")
def train_hourly_models(spark, d):
    table = ML.labelled_hours(base(spark, d))
    return ML.training_log(spark, ML.train_models(table, ML.HOURS))


@query("train_daily_models")
def train_daily_models(spark, d):
    table = daily_table(spark, d)
    return ML.training_log(spark, ML.train_models(table, ML.DAYS))


@query("backtest_hourly")
def backtest_hourly(spark, d):
    return ML.backtest(ML.labelled_hours(base(spark, d)), ML.HOURS)


@query("backtest_daily")
def backtest_daily(spark, d):
    return ML.backtest(daily_table(spark, d), ML.DAYS)


@query("forecast_hours")
def forecast_hours(spark, d):
    table = ML.labelled_hours(base(spark, d))
    return ML.forecast(table, ML.train_models(table, ML.HOURS))


@query("forecast_days")
def forecast_days(spark, d):
    table = daily_table(spark, d)
    return ML.forecast(table, ML.train_models(table, ML.DAYS))


@query("model_factory")
def model_factory(spark, d):
    """Every model the factory offers, fitted on the daily table."""
    table = daily_table(spark, d)
    fitted = [
        ML.training_log(
            spark, ML.train_models(table, ML.DAYS, replace(DEFAULTS, model_name=name))
        ).select(F.lit(name).alias("name"), "*")
        for name in ("gbt", "rf", "logreg")
    ]
    return ML.concat_horizons(fitted)


# --------------------------------------------------------------------------- 2.10 streaming


@query(
    "stream_hourly_readings",
    f"SELECT meter_id, hour_ts AS ts, {O._CHANNELS.strip()} FROM ev GROUP BY meter_id, hour_ts "
    "HAVING hour_ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR",
)
def stream_hourly_readings(spark, d):
    """Two deliveries with the job stopped between them; the second brings the first's last hour
    again, whose events must not count twice."""
    arriving, folder = scratch_path(spark, "events"), scratch_path(spark, "hourly-job")
    events = spark.read.parquet(f"{d}/events.parquet")
    cut = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    border = events.where(F.col("event_id") == cut).agg(F.min("ts")).first()[0]
    border = T.wall_clock(border)
    for delivery in (
        events.where(F.col("ts") < border),
        events.where(F.col("ts") >= border - F.expr("INTERVAL 1 HOUR")),
    ):
        delivery.write.mode("append").parquet(arriving)
        SH.run_hours(spark, arriving, folder, events.schema)
    return SH.closed_hours(spark, folder)


@query("stream_detect_hours", f"SELECT {DECISION_SQL} FROM dec")
def stream_detect_hours(spark, d):
    """Two versions of the baseline; the second is a refit on the same training window and is
    published when half of the hours have been scored."""
    arriving, baselines, folder = (scratch_path(spark, n) for n in ("arriving", "baselines", "scoring-job"))
    hours = grid(spark, d)
    done = stage_table(core(processed_parts(hours), runs.RUN_LAYOUT), "processed")
    low, high = done.agg(F.min("ts"), F.max("ts")).first()
    half = (low + (high - low) / 2).replace(minute=0, second=0, microsecond=0)
    border = T.wall_clock(half)
    for since, part in ((low, F.col("ts") < border), (half, F.col("ts") >= border)):
        SD.publish_baseline(fitted(hours), baselines, str(since))
        done.where(part).write.mode("append").parquet(arriving)
        SD.run_scoring(spark, arriving, baselines, folder)
    return decision_columns(SD.scored_hours(spark, folder))


@query("stream_incidents", O.incident_sql("isl_full"))
def stream_incidents(spark, d):
    """Three deliveries of ten days each; the job is stopped after each and resumed."""
    arriving, folder = scratch_path(spark, "decisions"), scratch_path(spark, "incident-job")
    period = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    staged = stage_table(
        decided(spark, d).select(*D.DECISION_COLUMNS).withColumn("_period", period), "scored"
    )
    for n in range(3):
        staged.where(F.col("_period") == n).drop("_period").write.mode("append").parquet(arriving)
        SI.run_incidents(spark, arriving, folder)
    return SI.current_incidents(spark, folder)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
