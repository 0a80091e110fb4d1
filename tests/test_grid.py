"""Time parsing, gap filling, units and windows on hand-written series."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import column
from tidemark.functions import numeric as N
from tidemark.functions import time as T
from tidemark.operators import grid as G
from tidemark.params import Params
from tidemark.plans.series import Layout


def test_dates_and_hours(spark):
    texts = spark.createDataFrame(
        [
            (1, "02.04.2025", "0-1"),
            (2, "2.4.2025", "23–24"),
            (3, "2025-04-02", " 7—8 "),
            (4, "n/a", "1-2"),
            (5, "02.04.2025", "0-0"),
            (6, "02.04.2025", "24-25"),
            (7, "02.04.2025", "3 - 4"),
            (8, "02.04.2025", None),
        ],
        "meter_id bigint, date_raw string, hour_raw string",
    )
    kept = {r["meter_id"]: r for r in G.parse_reading_times(texts).collect()}
    assert {k: r["ts"].hour for k, r in kept.items()} == {1: 0, 2: 23, 3: 7}
    assert all(r["ts"].date() == dt.date(2025, 4, 2) for r in kept.values())


def test_numbers(spark):
    texts = spark.createDataFrame(
        [("1.5",), (" 2e1 ",), ("5d",), ("NaN",), ("abc",), (None,), ("-.5",)], "x string"
    )
    found = [r[0] for r in texts.select(N.number_or(F.col("x"), 9.0)).collect()]
    assert found == [1.5, 20.0, 9.0, 9.0, 9.0, 9.0, -0.5]


def test_gap_fill_ignores_daylight_saving(hourly):
    # The clocks of the session's zone jump on 2024-03-10; wall-clock hours must not.
    readings = hourly(start="2024-03-09 22:00:00", xvs_m3=[float(i) for i in range(10)])
    gappy = readings.where("xvs_m3 NOT BETWEEN 3 AND 7")
    filled = G.hourly_gap_fill(gappy)
    assert column(filled, "ts") == column(readings, "ts")
    assert column(filled, "xvs_m3") == [0, 1, 2, None, None, None, None, None, 8, 9]
    assert column(filled, "hour_idx")[:4] == [23, 24, 1, 2]


def test_single_row_and_empty(hourly):
    one = hourly(xvs_m3=[1.0])
    assert G.hourly_gap_fill(one).count() == 1
    assert G.hourly_gap_fill(one.limit(0)).count() == 0


def test_duplicates(hourly):
    twice = hourly(xvs_m3=[1.0, 2.0]).unionByName(hourly(xvs_m3=[4.0]))
    assert [r["n_rows"] for r in G.duplicate_hours(twice).collect()] == [2]
    with pytest.raises(Exception, match="duplicate hour"):
        G.hourly_gap_fill(twice).collect()
    assert column(G.hourly_gap_fill(twice, on_duplicate="sum"), "xvs_m3") == [5.0, 2.0]
    ranked = twice.withColumn("arrival", F.col("xvs_m3"))
    last = G.hourly_gap_fill(ranked, on_duplicate="last", order_by="arrival")
    assert column(last, "xvs_m3") == [4.0, 2.0]


def test_units_and_proxy(hourly):
    texts = hourly(
        xvs_m3=["1", "x", None], gvs_m3=[None, 2.0, 1.0],
        supply_m3=[3.0, 1.0, None], return_m3=[1.0, 2.0, 1.0],
    )
    numbers = G.harmonize_units(texts, Params(xvs_factor=2.0))
    assert column(numbers, "xvs_m3") == [2.0, None, None]
    off = G.recirculation_proxy(numbers)
    assert off.columns == numbers.columns
    on = G.recirculation_proxy(numbers, enabled=True)
    assert column(on, "odpu_proxy_net") == [2.0, 0.0, None]
    assert column(on, "gvs_m3") == [None, 2.0, 1.0]
    assert column(G.recirculation_proxy(numbers, enabled=True, override=True), "gvs_m3") == [2.0, 0.0, None]
    absent = G.recirculation_proxy(numbers.drop("gvs_m3"), enabled=True)
    assert column(absent, "gvs_m3") == [2.0, 0.0, None]


@pytest.mark.parametrize(
    "values, expected",
    [
        ([0, 3, 6], [0, 3, 6]),
        ([1, 4, 7], [0, 3, 6]),
        ([1, 4, 6], [1, 4, 6]),
        ([0, 4, 7], [None] * 3),
        ([3, None, 9], [None] * 3),
    ],
)
def test_weekday_codings(hourly, values, expected):
    assert column(G.weekday_normalize(hourly(weekday=values)), "weekday_norm") == expected


def test_weekday_row_rule(hourly):
    df = G.weekday_normalize(hourly(weekday=[1, 6, 7, 8]), rule="row")
    assert column(df, "weekday_norm") == [1, 6, 6, None]


@pytest.mark.parametrize("days, train, test", [(4, 48, 24), (2, 48, 24), (1, 24, 24)])
def test_tail_windows(hourly, days, train, test):
    marked = G.train_test_tail(
        hourly(xvs_m3=[1.0] * 24 * days), Params(train_days=2, test_days=1)
    )
    assert (marked.where("is_train").count(), marked.where("is_test").count()) == (train, test)
    overlap = marked.where("is_train AND is_test").count()
    assert overlap == max(0, train + test - 24 * days)


def test_layout_rejects_a_halo_wider_than_a_part():
    with pytest.raises(ValueError):
        Layout(size=10).needing(before=11)


def test_hour_numbers_round_trip(spark):
    hours = spark.range(-50, 50).select(T.hour_from_number(F.col("id")).alias("ts"), "id")
    assert hours.where(T.hour_number(F.col("ts")) != F.col("id")).count() == 0
