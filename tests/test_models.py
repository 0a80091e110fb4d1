"""Training rows that horizons share, early stopping, and what a bundle keeps."""

import datetime as dt
import os
import random
from dataclasses import replace

import pytest

from tidemark.operators import features as X
from tidemark.operators import models as ML
from tidemark.operators import splits as P
from tidemark.params import Params
from tidemark.plans.series import HOURLY

NAMES = ["a", "b"]
PARAMS = Params(hour_horizons=(1, 3), max_iter=30, max_depth=2, step_size=0.3, validation_tol=0.05)


@pytest.fixture(params=[HOURLY, replace(HOURLY, size=24)], ids=["whole", "parts"])
def kind(request):
    return replace(ML.HOURS, feature_names=lambda *_: NAMES, layout=request.param)


@pytest.fixture(scope="module")
def table(spark):
    """Two meters with gaps in the features and labels that follow the first feature."""
    rng = random.Random(6)
    rows = []
    for meter, n in ((1, 90), (2, 70)):
        start = dt.datetime(2024, 3, 9)
        a = [rng.choice([None, 0.0, 1.0, 2.0]) for _ in range(n)]
        a[:4] = [None] * 4
        y = [int((v or 0) > 1) for v in a]
        ahead = lambda i, h: y[i + h] if i + h < n else 0
        for i in range(n):
            rows.append(
                (meter, start + dt.timedelta(hours=i), start, start + dt.timedelta(hours=n - 1),
                 a[i], rng.random(), ahead(i, 1), ahead(i, 3))
            )
    return spark.createDataFrame(
        rows,
        "meter_id bigint, ts timestamp_ntz, series_start timestamp_ntz, series_end timestamp_ntz, "
        "a double, b double, y_1 int, y_3 int",
    )


@pytest.mark.parametrize("shift", ["horizon", "none"])
def test_shared_rows_equal_a_shift_and_fill_for_each_horizon(spark, table, kind, shift):
    params = replace(PARAMS, feature_shift=shift)
    shared = ML.shared_rows(table, kind, params)
    for h in params.hour_horizons:
        one = table.selectExpr("meter_id", "ts", "series_start", "series_end", f"y_{h} AS y", *NAMES)
        moved = X.shift_features(one, NAMES, h if shift == "horizon" else 0, kind.layout)
        expected = P.impute(moved, NAMES, kind.layout).select("y", *NAMES)
        got = ML.horizon_samples(shared, h, NAMES, params)
        assert sorted(got.select("y", *NAMES).collect()) == sorted(expected.collect())
        held = {r["held_out"]: r["count"] for r in got.groupBy("held_out").count().collect()}
        assert held[True] >= 25 and held[False] > 3 * held[True]


def test_boosting_stops_early_and_keeps_its_losses(spark, table):
    kind = replace(ML.HOURS, feature_names=lambda *_: NAMES)
    bundle = ML.train_models(table, kind, PARAMS)
    log = ML.training_log(spark, bundle).collect()
    assert sorted(bundle.models) == [1, 3]
    for h, model in bundle.models.items():
        rounds = [r["loss"] for r in log if r["horizon_h"] == h]
        assert len(rounds) == len(model.stages[-1].trees) < PARAMS.max_iter
        assert all(x > 0 for x in rounds)
    whole = ML.train_models(table, kind, replace(PARAMS, validation_share=0.0, max_iter=4))
    assert all(len(m.stages[-1].trees) == 4 for m in whole.models.values())
    assert [r["loss"] for r in ML.training_log(spark, whole).collect()] == [None, None]


def test_backtest_trains_on_one_column(spark, table, monkeypatch):
    """Every job of a fit carries the plan of its input, which must not list the features."""
    kind = replace(ML.HOURS, feature_names=lambda *_: NAMES, min_train_days=lambda p: 0)
    stored = []
    keep = ML.stage_table
    monkeypatch.setattr(ML, "stage_table", lambda df, name: stored.append(df.columns) or keep(df, name))
    rows = ML.backtest(table, kind, replace(PARAMS, max_iter=2)).collect()
    assert sorted((r["horizon_h"], r["fold"]) for r in rows) == [(1, 0), (1, 1), (3, 0), (3, 1)]
    assert sum("vector" in c for c in stored) == 2 and not any("a" in c for c in stored)
    assert {r["n_test"] for r in rows} == {53}


def test_backtest_stores_the_folds_of_one_horizon_at_a_time(spark, table, monkeypatch):
    kind = replace(ML.HOURS, feature_names=lambda *_: NAMES, min_train_days=lambda p: 0)
    params = replace(PARAMS, max_iter=2)
    keep, paths = ML.stage_table, []

    def watch(df, name):
        if "folds" in name:
            assert not any(os.path.exists(p) for p in paths)
        stored = keep(df, name)
        if "folds" in name:
            assert os.path.exists(stored.staged_at)
            paths.append(stored.staged_at)
        return stored

    monkeypatch.setattr(ML, "stage_table", watch)
    side_by_side = ML.backtest(table, kind, replace(params, hour_horizons=(3,))).collect()
    monkeypatch.setattr(ML, "CELLS_AT_ONCE", 0)
    found = ML.backtest(table, kind, params)
    assert len(paths) == 3 and not any(os.path.exists(p) for p in paths)
    rows = sorted(found.collect())
    assert [r for r in rows if r["horizon_h"] == 3] == sorted(side_by_side)
    for h in params.hour_horizons:
        one = ML._horizon_table(table, kind, h, NAMES, params)
        folds = P.fill_folds(one, len(NAMES), P.Folds(2, 0, "hour"), kind.layout)
        facts = sorted(P.fold_facts(folds, (), "ts").collect())
        assert [(r["fold"], *r[4:]) for r in rows if r["horizon_h"] == h] == [tuple(f) for f in facts]


def test_other_models_are_judged_once(spark, table):
    kind = replace(ML.HOURS, feature_names=lambda *_: NAMES)
    bundle = ML.train_models(table, kind, replace(PARAMS, model_name="logreg", hour_horizons=(1,)))
    assert [len(x) for x in bundle.losses.values()] == [1] and bundle.losses[1][0] > 0


def test_unknown_models_are_refused():
    with pytest.raises(ValueError, match="gbt, rf, logreg"):
        ML.build_estimator("forest")


def test_folds_of_arrays_equal_folds_of_columns(spark, table, kind):
    folds = P.Folds(2, 0, "hour")
    one = table.selectExpr("meter_id", "ts", "series_start", "series_end", "y_3 AS y", *NAMES)
    moved = X.shift_features(one, NAMES, 3, kind.layout)
    copied = P.expanding_splits(moved, 2, 0)
    expected = P.impute(copied, NAMES, kind.layout, group=("fold", "role"))
    own = P.fill_folds(ML._horizon_table(table, kind, 3, NAMES, PARAMS), 2, folds, kind.layout)
    got = own.selectExpr("meter_id", "ts", "fold", "role", "y", "_v[0] AS a", "_v[1] AS b")
    assert sorted(got.collect()) == sorted(expected.select(*got.columns).collect())
