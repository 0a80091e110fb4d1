"""Operators against independent pandas formulas, with parts small enough to be crossed often."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import column
from tidemark.operators import features as X
from tidemark.operators import incidents as I
from tidemark.operators import quality as Q
from tidemark.operators import splits as P
from tidemark.plans.series import DAILY, HOURLY, core, spread
from dataclasses import replace

SMALL = replace(HOURLY, size=31)
SIZES = [replace(HOURLY, size=n) for n in (24, 31, 50, 5000)]


def random_series(seed, n=240, missing=0.2):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 4, n) / 8
    values[rng.random(n) < missing] = np.nan
    values[60:130] = 0.25  # a run longer than several parts
    values[150:200] = np.nan
    return pd.Series(values)


def as_list(s):
    return [None if pd.isna(v) else float(v) for v in s]


def run_of(b):
    b = b.astype(int)
    return b.groupby((b == 0).cumsum()).cumsum()


@pytest.mark.parametrize("layout", SIZES, ids=lambda v: str(v.size))
def test_quality_flags(hourly, layout):
    s = random_series(1)
    df = Q.quality_flags(hourly(xvs_m3=as_list(s)), layout=layout)
    zero, flat = s.fillna(0) == 0, s == s.shift()
    assert column(df, "itp_xvs_zero_run") == list(run_of(zero))
    assert column(df, "itp_xvs_flat_run") == list(run_of(flat))
    assert column(df, "itp_xvs_zero_anomaly") == list(run_of(zero) >= 2)
    assert column(df, "itp_xvs_flat_anomaly") == list(run_of(flat) >= 6)
    window = s.rolling(24, min_periods=8, center=True)
    median, iqr = window.median(), window.quantile(0.75) - window.quantile(0.25)
    reach = 3 * iqr.replace(0, np.nan)
    assert column(df, "itp_xvs_spike") == list((s > median + reach) | (s < median - reach))


def test_flags_inside_a_wide_halo(hourly):
    """Chained operators see exact values in the halo rows they rely on."""
    s = random_series(2)
    df = hourly(xvs_m3=as_list(s))
    layout = SMALL.needing(24, 24)
    chained = core(Q.quality_flags(spread(df, layout), layout=layout), layout)
    alone = Q.quality_flags(df, layout=replace(HOURLY, size=5000))
    assert chained.exceptAll(alone).count() == 0 and chained.count() == alone.count()


def test_seven_equal_values_are_flat(hourly):
    df = Q.quality_flags(hourly(xvs_m3=[1.0] * 6 + [2.0] * 7))
    assert column(df, "itp_xvs_flat_anomaly") == [False] * 12 + [True]


def test_spike_needs_eight_values_and_a_range(hourly):
    few = Q.quality_flags(hourly(xvs_m3=[1.0, 2.0, 3.0, 1.5, 2.5, 1.2, 99.0]))
    assert not any(column(few, "itp_xvs_spike"))
    enough = Q.quality_flags(hourly(xvs_m3=[1.0, 2.0, 3.0, 1.5, 2.5, 1.2, 2.2, 99.0]))
    assert column(enough, "itp_xvs_spike") == [False] * 7 + [True]
    constant = Q.quality_flags(hourly(xvs_m3=[1.0] * 20 + [99.0]))
    assert not any(column(constant, "itp_xvs_spike"))


@pytest.mark.parametrize("layout", SIZES, ids=lambda v: str(v.size))
def test_lags_and_rolling(hourly, layout):
    s = random_series(3)
    base = hourly(delta_m3=as_list(s), itp_xvs_spike=[bool(v > 0.3) for v in s.fillna(0)])
    df = X.lag_and_rolling(base, X.HOURLY_BASES, (1, 6), (2, 6), "h", layout)
    assert column(df, "delta_m3_lag6h") == as_list(s.shift(6))
    for w in (2, 6):
        rolling = s.rolling(w, min_periods=max(2, w // 2))
        for stat in ("mean", "std", "min", "max"):
            got = pd.Series(column(df, f"delta_m3_roll{w}h_{stat}"), dtype=float)
            np.testing.assert_allclose(got, getattr(rolling, stat)(), atol=1e-12)
    assert column(df, "itp_xvs_spike_lag1h")[1] in (0.0, 1.0)


@pytest.mark.parametrize("layout", SIZES, ids=lambda v: str(v.size))
def test_horizon_labels_and_shift(hourly, layout):
    y = pd.Series([i % 5 == 0 for i in range(100)])
    df = X.hour_horizon_labels(hourly(label=list(y)), (1, 6), layout)
    assert column(df, "y_6") == list(y.astype(int).shift(-6).fillna(0).astype(int))
    shifted = X.shift_features(hourly(a=[float(i) for i in range(100)]), ["a"], 4, layout)
    assert column(shifted, "a") == [None] * 4 + [float(i) for i in range(96)]


@pytest.mark.parametrize("layout", SIZES, ids=lambda v: str(v.size))
@pytest.mark.parametrize("backward", [True, False])
def test_imputation(hourly, layout, backward):
    s = random_series(4, missing=0.6)
    s[:70] = np.nan
    role = ["train"] * 100 + ["test"] * 140
    df = P.impute(
        hourly(a=as_list(s), b=[None] * 240, role=role), ["a", "b"], layout,
        group=("role",), backward=backward,
    )
    expected = s.groupby(role).ffill()
    if backward:
        expected = expected.groupby(role).bfill()
    assert column(df, "a") == list(expected.fillna(0.0))
    assert column(df, "b") == [0.0] * 240


def test_expanding_splits(hourly):
    facts = (
        P.expanding_splits(hourly(a=[0.0] * 720)).groupBy("fold", "role").count().collect()
    )
    assert {(r["fold"], r["role"]): r["count"] for r in facts} == {
        (0, "train"): 240, (0, "test"): 240, (1, "train"): 480, (1, "test"): 240,
    }
    short = P.expanding_splits(hourly(a=[0.0] * 240), min_train_days=5)
    assert [r["fold"] for r in short.select("fold").distinct().collect()] == [0]
    assert short.where("role = 'train'").count() == 160
    assert P.expanding_splits(hourly(a=[0.0] * 2), min_train_days=0).count() == 0


def test_daily_windows_follow_calendar_parts(spark):
    days = spark.range(40).select(
        F.lit(1).cast("bigint").alias("meter_id"),
        F.date_add(F.lit("2024-02-10").cast("date"), F.col("id").cast("int")).alias("day"),
        F.col("id").cast("double").alias("itp_xvs_m3"),
    )
    df = X.lag_and_rolling(
        days, ("itp_xvs_m3",), (1, 2), (3,), "d", replace(DAILY, size=7), differences=True
    )
    assert column(df, "itp_xvs_m3_lag2d", "day") == [None, None, *map(float, range(38))]
    assert column(df, "itp_xvs_m3_diff1", "day") == [None, *[1.0] * 39]
    assert column(df, "itp_xvs_m3_roll3d_mean", "day")[:3] == [None, 0.5, 1.0]


def decisions(hourly, flags, causes, **more):
    n = len(flags)
    return hourly(
        is_anomaly=flags, top_cause=causes, top_cause_prob=more.get("probs", [0.5] * n),
        delta_m3=[1.0] * n, z_delta=[float(-i) for i in range(n)],
    )


@pytest.mark.parametrize("layout", SIZES, ids=lambda v: str(v.size))
def test_long_incident_crosses_parts(hourly, layout):
    flags = [False] * 10 + [True] * 150 + [False] * 3 + [True] * 3
    found = I.incidents(decisions(hourly, flags, ["leak"] * 166), layout=layout).collect()
    assert [(r["hours"], r["delta_m3_sum"], r["worst_z"], r["cause_ru"]) for r in found] == [
        (150, 150.0, 159.0, "Утечка")
    ]


def test_incident_boundaries(hourly):
    cause_change = I.incidents(decisions(hourly, [True] * 9, ["leak"] * 4 + ["tech"] * 5))
    assert sorted(r["hours"] for r in cause_change.collect()) == [4, 5]
    gap = decisions(hourly, [True] * 9, ["leak"] * 9).where("hour(ts) != 4")
    assert sorted(r["hours"] for r in I.incidents(gap).collect()) == [4, 4]
    none = I.incidents(decisions(hourly, [True] * 3, ["leak"] * 3))
    assert none.count() == 0 and tuple(none.columns) == I.INCIDENT_COLUMNS


@pytest.mark.parametrize("layout", SIZES, ids=lambda v: str(v.size))
@pytest.mark.parametrize("n_splits", [1, 6])
def test_folds_filled_once_equal_folds_filled_one_by_one(hourly, layout, n_splits):
    """Gaps at the start of the series, of blocks, and over whole blocks."""
    rng = np.random.default_rng(n_splits)
    s = random_series(n_splits, missing=0.7)
    s[:130] = np.nan
    t = random_series(n_splits + 9, missing=0.2)
    for at in rng.integers(0, 240, 4):
        t[at : at + 45] = np.nan
    t[3] = np.inf
    df = hourly(a=as_list(s), b=as_list(t), c=[None] * 239 + [1.0])
    folds = P.Folds(n_splits, min_train_days=2)
    copied = P.expanding_splits(df, n_splits, 2)
    expected = P.impute(copied, ["a", "b", "c"], layout, group=("fold", "role"))
    got = P.impute_folds(df, ["a", "b", "c"], folds, layout).select(*expected.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert got.count() > 200


def test_rows_shuffled_for_folds_do_not_depend_on_their_number(hourly):
    """The explode into folds comes after the last exchange of hours."""
    df = hourly(a=[1.0, None] * 200)
    text = P.impute_folds(df, ["a"], P.Folds(9, 0))._jdf.queryExecution().executedPlan().toString()
    lines = text.splitlines()
    explode = next(i for i, line in enumerate(lines) if "Generate explode(_folds" in line)
    assert not any("Exchange" in line for line in lines[:explode])


def test_hundreds_of_features_are_filled_as_one_array(hourly):
    """A window with as many columns took milliseconds a row."""
    rng = np.random.default_rng(5)
    columns = {f"f{i}": [*[None] * (i % 7), *rng.random(60 - i % 7)] for i in range(220)}
    columns |= {"f0": [None] * 60, "f1": [None, 2.0, None] * 20}
    df = hourly(**{n: [None if v is None else float(v) for v in vs] for n, vs in columns.items()})
    filled = P.impute(df, list(columns))
    folds = P.impute_folds(df, list(columns), P.Folds(2, 0))
    for plan in (filled, folds):
        assert "last(" not in plan._jdf.queryExecution().executedPlan().toString()
    assert column(filled, "f0") == [0.0] * 60 and column(filled, "f1") == [2.0] * 60
    assert column(filled, "f6")[:7] == [columns["f6"][6]] * 7
    assert folds.count() == 100
