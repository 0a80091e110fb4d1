"""Baseline, scores, decisions and post-processing."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import column
from tidemark.operators import baseline as B
from tidemark.operators import detect as D
from tidemark.operators import quality as Q
from tidemark.params import CAUSE_PRIOR, DEFAULTS
from tidemark.plans.staging import stage

WEEKS = 24 * 7 * 3


@pytest.fixture(scope="module")
def flows():
    rng = np.random.default_rng(7)
    xvs = pd.Series(rng.integers(0, 40, WEEKS) / 8)
    gvs = pd.Series(rng.integers(0, 40, WEEKS) / 8)
    xvs[rng.random(WEEKS) < 0.1] = np.nan
    return xvs, gvs


def as_list(s):
    return [None if pd.isna(v) else float(v) for v in s]


def mad(v):
    v = v.dropna()
    return 1.4826 * (v - v.median()).abs().median() + 1e-6


def test_baseline_against_pandas(hourly, flows):
    xvs, gvs = flows
    start = "2024-01-01 00:00:00"  # a Monday
    rows = B.fit_baseline(hourly(start, xvs_m3=as_list(xvs), gvs_m3=as_list(gvs)))
    got = rows.orderBy("how").toPandas()
    delta, ratio = xvs - gvs, gvs / np.maximum(xvs, 1e-12)
    how = pd.Series(np.arange(WEEKS) % 168)
    grouped = pd.DataFrame({"delta": delta, "ratio": ratio}).groupby(how)
    np.testing.assert_allclose(got["mu_delta"], grouped["delta"].median().ffill().bfill())
    np.testing.assert_allclose(got["p_low_delta"], grouped["delta"].quantile(0.05).ffill().bfill())
    sigma = grouped["ratio"].apply(mad).ffill().bfill()
    np.testing.assert_allclose(got["sigma_ratio"], sigma, rtol=1e-9)
    np.testing.assert_allclose(got["global_sigma_delta"], mad(delta))
    assert list(got["how"]) == list(range(168))


def test_missing_slots_take_their_neighbours(hourly):
    rows = B.fit_baseline(hourly("2024-01-01 05:00:00", xvs_m3=[1.0, 2.0], gvs_m3=[0.0, 0.0]))
    mu = column(rows, "mu_itp", "how")
    assert mu[0] == mu[5] == 1.0 and mu[6] == mu[167] == 2.0


def test_weather_slope(hourly):
    n = 24 * 7 * 12
    weather = [float(i // 168) for i in range(n)]
    xvs = [10.0 + 2.0 * w for w in weather]
    rows = B.fit_baseline(hourly("2024-01-01 00:00:00", xvs_m3=xvs, gvs_m3=[0.0] * n, weather=weather))
    wc = np.arange(12) - 5.5
    expected = (wc * (10 + 2 * np.arange(12))).sum() / (wc**2).sum()
    np.testing.assert_allclose(column(rows, "beta_delta_w", "how"), expected)
    few = B.fit_baseline(hourly("2024-01-01 00:00:00", xvs_m3=xvs[:168], gvs_m3=[0.0] * 168, weather=weather[:168]))
    assert set(column(few, "beta_delta_w", "how")) == {0.0}


def scored(hourly, flows, params=DEFAULTS):
    xvs, gvs = flows
    hours = Q.balance_and_flags(hourly(
        "2024-01-01 00:00:00", xvs_m3=as_list(xvs), gvs_m3=as_list(gvs),
        supply_m3=[0.0] * WEEKS, return_m3=[0.0] * WEEKS, t1=[9.0] * WEEKS, t2=[1.0] * WEEKS,
    ))
    # Decisions are a stored table before anything filters on them, as in a detection run.
    return stage(D.detect_hours(hours, B.fit_baseline(hours), params))


def test_probabilities_sum_to_one(hourly, flows):
    d = scored(hourly, flows)
    total = sum((F.col(p) for p in D.PROBABILITIES), F.lit(0.0))
    assert d.where(F.abs(total - 1) > 1e-9).count() == 0
    assert d.where("NOT is_anomaly AND (p_normal != 1 OR top_cause != 'normal')").count() == 0
    assert d.where("is_anomaly AND p_normal != 0").count() == 0
    assert d.where("is_anomaly").count() > 0


def test_decision_rules(spark):
    rows = spark.createDataFrame(
        [
            (1, 3.0, 0.0, 1.0, 1.0, 0.5, False, True, False),
            (2, 3.0, 0.0, 1.0, 1.0, 0.1, False, False, False),  # difference too small
            (3, 3.0, 0.0, 0.1, 0.1, 0.5, False, False, False),  # flow too low
            (4, 0.0, 0.0, 0.1, 0.1, 0.0, True, True, False),  # over the limit by itself
            (5, 0.0, -5.0, 0.1, 0.1, 0.0, False, False, True),  # severe
            (6, 2.9, 3.4, 1.0, 1.0, 0.5, False, False, False),
            (7, None, 0.0, 1.0, 1.0, 0.5, False, False, False),
        ],
        "id int, z_delta double, z_ratio double, itp_xvs_m3 double, odpu_gvs_m3 double, "
        "delta_m3 double, flag_over10 boolean, raw boolean, sev boolean",
    )
    out = D.anomaly_decision(rows)
    assert out.where("raw_is_anomaly != raw OR severe != sev").count() == 0
    assert out.where("is_anomaly != (raw OR sev)").count() == 0


def test_corridor_only_when_enabled(hourly, flows):
    plain = scored(hourly, flows).where("raw_is_anomaly").count()
    strict = scored(hourly, flows, replace(DEFAULTS, use_quantile_corridor=True))
    assert strict.where("raw_is_anomaly").count() > plain


def test_first_cause_wins_a_tie(spark):
    row = spark.range(1).select(*[F.lit(0.5).alias(f"p_{c}") for c in CAUSE_PRIOR])
    assert row.select(D.top_cause()).first()[0] == "normal"


def decisions(hourly, raw, severe):
    return hourly(
        raw_is_anomaly=raw, severe=severe, is_anomaly=[a or b for a, b in zip(raw, severe)],
        **{p: [0.0 if p != "p_leak" else 1.0] * len(raw) for p in D.PROBABILITIES},
        top_cause_prob=[0.9] * len(raw),
    )


def test_persistence(hourly):
    raw = [True] * 3 + [False] + [True] * 5 + [False] * 2
    severe = [False] * 10 + [True]
    final = D.decision_postprocess(decisions(hourly, raw, severe))
    expected = [False] * 7 + [True] * 2 + [False, True]
    assert column(final, "is_anomaly_final") == expected
    assert column(final, "top_cause") == ["leak" if e else "normal" for e in expected]
    assert set(column(final, "top_cause_prob")) == {0.9}
    assert column(final, "cause_label")[0] == "Норма"
    assert column(final, "pct_normal")[:1] == [100.0]
    basic = D.decision_postprocess(decisions(hourly, raw, severe), basic=True)
    assert column(basic, "is_anomaly") == [False, True, True, False, False, *[True] * 4, False, False]


def test_latest_decision(hourly):
    d = decisions(hourly, [False, True], [False, True]).withColumns(
        {"top_cause": F.lit("leak"), "delta_m3": F.lit(0.00005), "ratio": F.lit(None).cast("double"),
         "z_delta": F.lit(1.005), "z_ratio": F.lit(0.0)}
    )
    row = D.latest_decision(d).first()
    assert (row["is_anomaly"], row["top_cause"], row["ratio"]) == (True, "Утечка", None)
    assert row["ts"].hour == 1


def test_refits_over_many_days_equal_fresh_fits(spark, hourly):
    """A window of three weeks that moves on by a day: equal to a fit from scratch each time."""
    rng = np.random.default_rng(8)
    n = 24 * 26
    values = lambda: [None if rng.random() < 0.1 else float(rng.integers(-2, 30)) / 8 for _ in range(n)]
    hours = stage(hourly("2024-03-04 00:00:00", xvs_m3=values(), gvs_m3=values(), weather=values()))
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-03-04").cast("date"))
    counts = stage(B.value_counts(hours.where(day < 21)))
    for last in range(21, 24):
        counts = stage(B.refit(counts, hours.where(day == last), hours.where(day == last - 21)))
        window = hours.where((day > last - 21) & (day <= last))
        fresh = B.value_counts(window)
        assert counts.exceptAll(fresh).count() == fresh.exceptAll(counts).count() == 0
    loose = replace(DEFAULTS, beta_min_points=2)
    one = B.baseline_of_counts(counts, loose).orderBy("how").toPandas()
    two = B.fit_baseline(window, loose).orderBy("how").toPandas()
    assert (two["beta_delta_w"] != 0).any()
    pd.testing.assert_frame_equal(one, two, rtol=1e-12)


def test_hours_that_were_never_counted_cannot_leave(hourly):
    hours = hourly(xvs_m3=[1.0, 2.0], gvs_m3=[1.0, 1.0])
    with pytest.raises(Exception, match="never in it"):
        B.refit(B.value_counts(hours), hours, hours.withColumn("xvs_m3", F.lit(9.0))).collect()


def test_a_refit_reads_the_new_day_only(spark, hourly, tmp_path):
    from tidemark.sources import sinks

    path = str(tmp_path / "hours")
    n = 24 * 5
    sinks.write_days(hourly("2024-01-01 00:00:00", xvs_m3=[1.0] * n, gvs_m3=[0.5] * n), path)
    new = sinks.read_days(spark, path).where("day = DATE'2024-01-05'")
    counts = B.value_counts(sinks.read_days(spark, path).where("day < DATE'2024-01-05'"))
    refitted = B.refit(stage(counts), new)
    text = refitted._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan parquet" in line]
    assert len(scans) == 1 and "(day#" in scans[0].split("PartitionFilters")[1]
    assert refitted.agg(F.sum("n")).first()[0] == n
