"""Physical plans: what is scanned, how often rows are shuffled, and that no Python runs in tasks."""

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import queries as C
from tidemark.operators import baseline as B
from tidemark.operators import features as X
from tidemark.operators import quality as Q
from tidemark.operators import splits as P
from tidemark.plans.layout import open_parts, store_parts
from tidemark.plans.series import core
from tidemark.sources import events as E

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hours(spark):
    return C.grid(spark, SF)


def test_scan_reads_only_what_the_readings_need(spark):
    text = plan(E.readings(spark, SF).select("meter_id", "ts", "xvs_m3"))
    assert "ReadSchema: struct<" in text
    assert "event_id" not in text.split("ReadSchema")[1].split(">")[0]


def test_frames_share_one_shuffle_by_part(hours):
    rolled = plan(X.hourly_rolling(X.flow_features(hours)))
    assert rolled.count("Exchange") == 1
    assert "hashpartitioning(meter_id" in rolled and "part#" in rolled


def test_no_window_over_a_whole_meter_of_hours(hours):
    """Windows over hours are keyed by part; only per-part summaries are ordered per meter."""
    text = plan(Q.quality_flags(hours))
    by_meter = [
        line for line in text.splitlines()
        if "Exchange hashpartitioning(meter_id" in line and "part#" not in line
    ]
    assert len(by_meter) == 1  # the summaries


def test_splits_do_not_shuffle(hours):
    assert "Exchange" not in plan(P.expanding_splits(hours))


def test_baseline_shuffles_the_training_window_once(hours):
    from tidemark.operators import grid as G

    text = plan(B.fit_baseline(G.train_test_tail(hours).where("is_train")))
    assert text.count("Exchange") == 1


def test_no_python_and_no_cross_join(hours):
    text = plan(C.processed_parts(hours))
    assert "Python" not in text and "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.fixture(scope="module")
def stored(spark, hours):
    """Processed hours as a stored table in parts."""
    from tidemark.operators import features

    flows = features.flow_features(core(C.processed_parts(hours), C.runs.RUN_LAYOUT))
    return store_parts(flows, "plan-test", C.FEATURE_LAYOUT, buckets=5)


@pytest.fixture
def no_broadcast(spark):
    """The plan of a large fleet: nothing is small enough to broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    yield
    spark.conf.set(name, before)


def test_frames_over_stored_parts_do_not_shuffle(stored):
    for fn in (X.hourly_lags, X.hourly_rolling):
        text = plan(fn(stored, layout=C.FEATURE_LAYOUT))
        assert "Exchange" not in text and "Bucketed: true" in text


def test_runs_over_stored_parts_shuffle_summaries_only(stored, no_broadcast):
    """Two exchanges, both of one row per part: to the meter and back to the part."""
    df = Q.run_length(stored, F.col("flag_over10"), "run", C.FEATURE_LAYOUT)
    text = plan(df)
    assert text.count("Exchange") == 2
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and all("Bucketed: true" in line for line in scans)
    below = text[text.index("Exchange"):]
    assert "Aggregate" in below and "Window" in below


def test_stored_parts_open_again(spark, hours, tmp_path):
    path = str(tmp_path / "parts")
    first = store_parts(hours.select("meter_id", "ts", "xvs_m3"), "again", C.FEATURE_LAYOUT, 3, path)
    schema = "meter_id bigint, ts timestamp_ntz, xvs_m3 double, part bigint"
    again = open_parts(spark, path, "again", schema, C.FEATURE_LAYOUT, 3)
    lags = X.lag_and_rolling(again, ("xvs_m3",), (1,), (), "h", C.FEATURE_LAYOUT)
    assert "Exchange" not in plan(lags) and again.exceptAll(first).count() == 0
    assert core(again, C.FEATURE_LAYOUT).count() == hours.count() < again.count()


def test_labels_of_the_own_row_need_no_join(hours):
    table = hours.withColumn("is_anomaly_final", F.lit(True))
    text = plan(X.hourly_base(table))
    assert "Join" not in text and "Exchange" not in text
