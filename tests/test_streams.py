"""Streams that are stopped, resumed, fed out of order and twice, against their batch twins."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.functions import time as T
from tidemark.operators import detect as D
from tidemark.operators import incidents as I
from tidemark.operators.baseline import STATISTICS
from tidemark.params import DEFAULTS
from tidemark.plans.series import HOURLY
from tidemark.sources import events as E
from tidemark.streaming import detect as SD
from tidemark.streaming import hourly as SH
from tidemark.streaming import incidents as SI

SMALL = replace(HOURLY, size=48)
START = dt.datetime(2024, 3, 8)  # a clock change of the session's zone follows
SCHEMA = (
    "meter_id bigint, ts timestamp_ntz, raw_is_anomaly boolean, severe boolean, "
    "is_anomaly boolean, top_cause string, top_cause_prob double, delta_m3 double, z_delta double"
)


@pytest.fixture
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", 8)


def scored(seed, hours, meters=(1, 2)):
    """Decisions of a few meters with long and short runs of anomalies."""
    rng = random.Random(seed)
    rows = []
    for meter in meters:
        raw, cause = False, "leak"
        for h in range(hours):
            if rng.random() < 0.2:
                raw = not raw
            if rng.random() < 0.05:
                cause = rng.choice(["leak", "tech", "tamper"])
            severe = rng.random() < 0.03
            shown = cause if raw or severe else "normal"
            z = None if rng.random() < 0.1 else float(rng.randint(-9, 9))
            rows.append(
                (meter, START + dt.timedelta(hours=h), raw, severe, raw or severe, shown,
                 rng.randint(0, 64) / 64, rng.randint(-64, 64) / 8, z)
            )
    return rows


def batch_incidents(spark, rows, layout=SMALL):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in D.PROBABILITIES:
        df = df.selectExpr("*", f"CAST(top_cause = '{c[2:]}' AS DOUBLE) AS {c}")
    return I.incidents(D.reset_cleared(D.persistence_filter(df, layout=layout)), layout=layout)


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def deliver(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stopped_and_resumed_between_any_deliveries(spark, tmp_path, few_partitions):
    """Out of order, repeated, meters in different files; correct after every single delivery."""
    rng = random.Random(1)
    rows = scored(1, 150)
    path, folder = str(tmp_path / "in"), str(tmp_path / "job")
    cuts = [0, 40, 41, 100, 150]
    seen = []
    for low, high in zip(cuts, cuts[1:]):
        new = [r for r in rows if low <= (r[1] - START).total_seconds() / 3600 < high]
        again = rng.sample(seen, min(len(seen), 5))
        held = [r for r in again if r[1] >= max(s[1] for s in seen) - dt.timedelta(hours=20)]
        rng.shuffle(new)
        deliver(spark, [r for r in new if r[0] == 2] + held, path)
        deliver(spark, [r for r in new if r[0] == 1] + new[:3], path)
        seen += new
        SI.run_incidents(spark, path, folder, layout=SMALL)
        assert same(batch_incidents(spark, seen), SI.current_incidents(spark, folder))
    before = SI.current_incidents(spark, folder).collect()
    SI.run_incidents(spark, path, folder, layout=SMALL)  # nothing new
    assert SI.current_incidents(spark, folder).collect() == before and before


def test_hours_may_be_late_up_to_a_limit(spark, tmp_path, few_partitions):
    rows = scored(2, 120, meters=(1,))
    late, very_late = rows[70], rows[10]
    first = [r for r in rows[:100] if r not in (late, very_late)]
    path, folder = str(tmp_path / "in"), str(tmp_path / "job")
    for part in (first, [late, very_late], rows[100:]):
        deliver(spark, part, path)
        SI.run_incidents(spark, path, folder, layout=SMALL, lateness="48 hours")
    taken = sorted([*first, late, *rows[100:]], key=lambda r: r[1])
    assert same(batch_incidents(spark, taken), SI.current_incidents(spark, folder))


def rows_for_state(rows):
    for r in rows:
        hour = int((r[1] - START).total_seconds() // 3600)
        yield hour, True, r[2], r[3], r[5], r[6], r[7], r[8]


@pytest.mark.parametrize("seed", range(20))
def test_state_survives_any_interruption(seed):
    """Judging in steps, with the state written and read between them, equals judging at once."""
    rng = random.Random(seed)
    rows = list(rows_for_state(scored(seed, 200, meters=(1,))))
    whole = SI.PartState()
    whole.take(iter(rows))
    expected = whole.judge(199, 199, DEFAULTS)
    state, closed = SI.PartState(), []
    for until in sorted(rng.sample(range(199), 12)) + [199]:
        state.take(iter([r for r in rows if r[0] <= until + 5]))
        closed += state.judge(until, 199, DEFAULTS)
        assert state.next_timer(199, DEFAULTS) > until or until == 199
        state = SI.PartState.load(state.dump())
    assert closed == expected and expected and state.open is None


def test_timer_closes_a_stretch_when_the_next_hour_is_overdue():
    state = SI.PartState()
    state.take(iter([(h, True, True, False, "leak", 0.5, 1.0, 2.0) for h in range(6)]))
    assert state.judge(5, 671, DEFAULTS) == [] and state.open.start == 3
    assert state.next_timer(671, DEFAULTS) == 6
    (closed,) = state.judge(6, 671, DEFAULTS)
    assert (closed.start, closed.end, len(closed.probs)) == (3, 5, 3)


def test_streams_leave_the_session_as_it_was(spark, tmp_path, few_partitions):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    deliver(spark, scored(3, 10), str(tmp_path / "in"))
    SI.run_incidents(spark, str(tmp_path / "in"), str(tmp_path / "job"))
    assert spark.conf.get(provider) == before


# --------------------------------------------------------------------------- hourly sums

EVENTS = "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string, value double, props string"


def events(seed, n):
    """Events over two days, across the hour that the session's zone skips."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 3, 9, 12)
    rows = []
    for i in range(n):
        at = start + dt.timedelta(seconds=rng.randint(0, 48 * 3600), microseconds=rng.randint(0, 999_999))
        kind = rng.choice(["view", "click", "purchase", "signup", "error"])
        rows.append((i, rng.randint(0, 89), at, kind, rng.randint(0, 9999) / 100, f'{{"k": {i % 7}}}'))
    return sorted(rows, key=lambda r: r[2])


def test_hours_count_each_event_once_and_list_the_late(spark, tmp_path, few_partitions):
    rng = random.Random(4)
    rows = events(4, 1500)
    path, folder = str(tmp_path / "in"), str(tmp_path / "job")
    schema = spark.createDataFrame([], EVENTS).schema
    held = rng.sample(rows[:400], 9) + rng.sample(rows[790:830], 9)  # far and a little too late
    cuts = [0, 500, 900, 1500]
    taken, late, newest = [], [], None
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        new = [r for r in rows[low:high] if r not in held]
        again = [r for r in taken if newest and r[2] > newest - dt.timedelta(minutes=90)]
        new += rng.sample(again, min(20, len(again))) + (held if i == 2 else [])
        new += rng.sample(new, 10)  # twice in one delivery
        rng.shuffle(new)
        spark.createDataFrame(new, EVENTS).repartition(2).write.mode("append").parquet(path)
        SH.run_hours(spark, path, folder, schema)
        limit = newest and newest - dt.timedelta(hours=2)
        late += [r for r in new if limit and r[2] <= limit]
        taken += [r for r in new if not (limit and r[2] <= limit)]
        newest = max(r[2] for r in new)
    once = spark.createDataFrame(sorted(set(taken)), EVENTS)
    hour = F.window("t", "1 hour")
    assert late and sorted(map(tuple, SH.late_events(spark, folder, schema).drop("batch").collect())) == sorted(late)
    batch = E.aggregate_hours(
        E.as_meter_events(once).withColumn("ts", T.hour_floor(F.col("ts"))), "meter_id", "ts"
    )
    end = newest - dt.timedelta(hours=2)
    expected = [tuple(r) for r in batch.collect() if r["ts"] + dt.timedelta(hours=1) <= end]
    got = [tuple(r) for r in SH.closed_hours(spark, folder).select(*batch.columns).collect()]
    assert sorted(got) == sorted(expected) and len(got) > 100
    assert {r[1].hour for r in got if r[1].date() == dt.date(2024, 3, 10)} >= {1, 2, 3}


# --------------------------------------------------------------------------- scoring


def flat_baseline(spark, meters, level):
    slots = spark.range(168).selectExpr("CAST(id AS INT) AS how")
    rows = slots.crossJoin(spark.createDataFrame([(m,) for m in meters], "meter_id bigint"))
    values = {"mu_delta": level, "sigma_delta": 1.0, "mu_ratio": 0.0, "sigma_ratio": 1.0}
    return rows.selectExpr(
        "meter_id", "how", *[f"CAST({values.get(c, 0.0)} AS DOUBLE) AS {c}" for c in STATISTICS],
        "1.0D AS global_sigma_delta", "1.0D AS global_sigma_ratio",
    )


def test_each_hour_is_scored_with_the_version_valid_then(spark, tmp_path, few_partitions):
    path, base, folder = (str(tmp_path / n) for n in ("in", "baselines", "job"))

    def deliver_hours(first, last):
        rows = [(m, START + dt.timedelta(hours=h), 5.0, 1.0) for m in (1, 2) for h in range(first, last)]
        df = spark.createDataFrame(rows, "meter_id bigint, ts timestamp_ntz, xvs_m3 double, gvs_m3 double")
        df.coalesce(1).write.mode("append").parquet(path)

    def levels():
        rows = SD.scored_hours(spark, folder).orderBy("meter_id", "ts").collect()
        return {m: [None if r["z_delta"] is None else round(4 - r["z_delta"]) for r in rows if r["meter_id"] == m] for m in (1, 2)}

    deliver_hours(0, 10)
    SD.publish_baseline(flat_baseline(spark, [1, 2], 1.0), base, str(START + dt.timedelta(hours=2)))
    SD.run_scoring(spark, path, base, folder)
    assert levels() == {m: [None] * 2 + [1] * 8 for m in (1, 2)}
    SD.publish_baseline(flat_baseline(spark, [1], 2.0), base, str(START + dt.timedelta(hours=12)))
    deliver_hours(10, 16)
    SD.run_scoring(spark, path, base, folder)
    SD.run_scoring(spark, path, base, folder)  # nothing new
    assert levels() == {1: [None] * 2 + [1] * 10 + [2] * 4, 2: [None] * 2 + [1] * 14}
    versions = SD.baseline_versions(spark, base).select("meter_id", "valid_to").distinct().collect()
    assert sorted(versions, key=str) == sorted(
        [(1, START + dt.timedelta(hours=12)), (1, None), (2, None)], key=str
    )
