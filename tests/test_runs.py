"""Complete runs on stored tables, and streams against their batch twins."""

import pytest

from tidemark.catalog import queries as C
from tidemark.operators import detect as D
from tidemark.params import Params
from tidemark.plans import runs
from tidemark.sources import events as E
from tidemark.sources import sinks

SF = "/root/testdata/sf0.001"
PARAMS = Params(
    model_name="logreg", hour_horizons=(1, 2), day_horizons=(1,), use_online_labels=False,
    rel_diff_limit=0.9, max_iter=3,
)


@pytest.fixture(scope="module")
def outdir(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run"))
    summary = runs.run_detection(spark, E.readings(spark, SF), out, PARAMS)
    out_rows = {r["name"]: r["value"] for r in summary.collect()}
    assert out_rows["rows_processed"] > 600 and out_rows["days"] >= 29
    return out


def test_detection_tables(spark, outdir):
    full = sinks.read_days(spark, f"{outdir}/online_decisions_full")
    assert set(D.DECISION_COLUMNS) <= set(full.columns)
    assert sinks.read_days(spark, f"{outdir}/online_decisions").count() == 24
    assert spark.read.parquet(f"{outdir}/baseline").count() == 168
    assert spark.read.json(f"{outdir}/current_decision").count() == 1


def test_training_and_forecast(spark, outdir):
    metrics = runs.run_training(spark, outdir, outdir, PARAMS)
    assert {(r["granularity"], r["horizon"]) for r in metrics.collect()} >= {
        ("hourly", 1), ("hourly", 2),
    }
    hourly, _ = runs.run_forecast(spark, outdir, outdir, PARAMS)
    rows = hourly.collect()
    assert sorted(r["h"] for r in rows) == [1, 2]
    assert all(0 <= r["p_anomaly"] <= 1 for r in rows)
    assert all(r["is_anomaly"] == int(r["p_anomaly"] >= 0.5) for r in rows)


def test_incident_stream_equals_batch(spark):
    stream = C.QUERIES["stream_incidents"](spark, SF)
    batch = C.QUERIES["incidents"](spark, SF)
    assert stream.exceptAll(batch).count() == 0 and stream.count() == batch.count()


