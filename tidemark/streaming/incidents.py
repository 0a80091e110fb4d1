"""Incidents as keyed streaming state.

The state of a meter's part holds the raw flags that the persistence test looks back on, the
stretch of hours that is still an incident, and hours that the watermark has not passed yet. An
hour is judged once no earlier one can arrive any more. Timers in event time judge waiting hours
of meters that went silent, close a stretch when the hour after it is overdue, and drop the state
when the part is over; so the state is bounded by the parts that are open, and a meter with a
long history that arrives at once is spread over its parts.

A part emits *fragments*: those that are closed, once, and with each change a numbered preview of
how the part would end if nothing more came. Fragments that meet at the border of two parts are
one incident; :func:`current_incidents` joins them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import numeric as N
from tidemark.functions import time as T
from tidemark.operators.detect import lookup_text
from tidemark.params import CAUSE_LABEL, DEFAULTS, Params
from tidemark.plans.series import HOURLY, METER, PART, Layout, spread
from tidemark.streaming.job import read_output, run_available

#: Hours may come this much later than the newest one of any meter; later ones are not taken.
LATENESS = "48 hours"

HOUR_MS = 3_600_000
INPUT = ("hour", "home", "raw", "severe", "cause", "prob", "delta", "z")
STRETCH = "start bigint, end bigint, cause string, probs array<double>, total double, worst double"
STATE = (
    f"version bigint, judged bigint, flags array<boolean>, {STRETCH}, "
    "w_hour array<bigint>, w_home array<boolean>, w_raw array<boolean>, w_severe array<boolean>, "
    "w_cause array<string>, w_prob array<double>, w_delta array<double>, w_z array<double>"
)
FRAGMENT = f"{METER} bigint, {PART} bigint, version bigint, kind string, {STRETCH}"
CLOSED, PREVIEW, NONE = "closed", "preview", "none"


@dataclass
class Stretch:
    """Consecutive anomalous hours of one cause."""

    start: int
    end: int
    cause: str
    probs: list[float] = field(default_factory=list)
    total: float = 0.0
    worst: float | None = None

    def add(self, hour: int, prob: float, delta: float, z: float | None) -> None:
        self.end = hour
        self.probs.append(prob)
        self.total += delta
        if z is not None:
            self.worst = abs(z) if self.worst is None else max(self.worst, abs(z))


@dataclass
class PartState:
    """What a part remembers between deliveries."""

    version: int = 0
    judged: int = -1 << 62
    flags: list[bool] = field(default_factory=list)
    open: Stretch | None = None
    waiting: dict[int, tuple] = field(default_factory=dict)

    @classmethod
    def load(cls, row: tuple) -> PartState:
        version, judged, flags, start, end, cause, probs, total, worst, *waiting = row
        stretch = None
        if start is not None:
            stretch = Stretch(start, end, cause, list(probs), total, worst)
        rows = zip(*[list(w) for w in waiting], strict=True)
        return cls(version, judged, [bool(f) for f in flags], stretch, {r[0]: r for r in rows})

    def dump(self) -> tuple:
        s = self.open
        stretch = (s.start, s.end, s.cause, s.probs, s.total, s.worst) if s else (None,) * 6
        waiting = [list(c) for c in zip(*self.waiting.values())] or [[] for _ in INPUT]
        return (self.version, self.judged, self.flags, *stretch, *waiting)

    def copy(self) -> PartState:
        stretch = self.open and replace(self.open, probs=list(self.open.probs))
        return PartState(self.version, self.judged, list(self.flags), stretch, dict(self.waiting))

    def take(self, rows: Iterator[tuple]) -> bool:
        """Add hours; the first delivery of an hour counts. True if any is new."""
        before = len(self.waiting)
        for row in rows:
            if row[0] > self.judged:
                self.waiting.setdefault(row[0], row)
        return len(self.waiting) > before

    def judge(self, until: int, last_hour: int, params: Params) -> list[Stretch]:
        """Judge the waiting hours up to ``until``; the stretches that end with that."""
        closed: list[Stretch] = []
        need = max(params.min_duration_h, 1)
        for hour in sorted(h for h in self.waiting if h <= until):
            _, home, raw, severe, cause, prob, delta, z = self.waiting.pop(hour)
            self.flags = [*self.flags, raw][-need:]
            if not home:
                continue
            anomalous = severe or (len(self.flags) == need and all(self.flags))
            s = self.open
            if s and not (anomalous and cause == s.cause and hour - s.end <= params.incident_gap_h):
                closed.append(s)
                s = None
            if anomalous:
                s = s or Stretch(hour, hour, cause)
                s.add(hour, prob, delta, z)
            self.open = s
        self.judged = max(self.judged, until)
        if self.open and until >= min(self.open.end + params.incident_gap_h, last_hour):
            closed.append(self.open)
            self.open = None
        return closed

    def next_timer(self, last_hour: int, params: Params) -> int:
        """The hour whose passing changes something even if no row comes."""
        hours = [last_hour, *self.waiting]
        if self.open:
            hours.append(self.open.end + params.incident_gap_h)
        return min(hours)


def part_step(params: Params, size: int):
    """The state function of a part."""

    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            z = frame["z"].astype(object).where(frame["z"].notna(), None)
            for row in zip(*[frame[c].tolist() for c in INPUT[:-1]], z.tolist(), strict=True):
                yield row

    def step(
        key: tuple, frames: Iterator[pd.DataFrame], group: GroupState
    ) -> Iterator[pd.DataFrame]:
        meter, part = key
        last_hour = (part + 1) * size - 1
        state = PartState.load(group.get) if group.exists else PartState()
        new = state.take(rows_of(frames))
        passed = group.getCurrentWatermarkMs() // HOUR_MS
        closed = state.judge(passed, last_hour, params) if passed >= 0 else []
        if new or closed:
            state.version += 1
            ahead = state.copy()
            # "If nothing more came": all waiting hours are judged, and the part ends.
            ended = [] if passed >= last_hour else ahead.judge(last_hour, last_hour, params)
            found = [(CLOSED, s) for s in closed] + [(PREVIEW, s) for s in ended]
            blank = dict.fromkeys(("start", "end", "cause", "probs", "total", "worst"))
            yield pd.DataFrame(
                [
                    {METER: meter, PART: part, "version": state.version, "kind": kind, **values}
                    for kind, values in [(NONE, blank), *[(k, asdict(s)) for k, s in found]]
                ]
            ).astype({"start": "Int64", "end": "Int64"})
        if passed >= last_hour:
            group.remove()
            return
        group.update(state.dump())
        group.setTimeoutTimestamp(state.next_timer(last_hour, params) * HOUR_MS)

    return step


def incident_fragments(
    decisions: DataFrame,
    params: Params = DEFAULTS,
    layout: Layout = HOURLY,
    lateness: str = LATENESS,
) -> DataFrame:
    """Fragments of a stream of scored hours (the columns of the decision record).

    Hours may arrive in any order within ``lateness`` of the newest hour of any meter. Later ones
    are not taken, repeated ones count once, and a missing hour ends an incident.
    """
    layout = layout.needing(before=max(params.min_duration_h - 1, 0))
    hours = decisions.select(
        METER,
        "ts",
        T.hour_number(F.col("ts")).alias("hour"),
        F.col("raw_is_anomaly").alias("raw"),
        "severe",
        F.col("top_cause").alias("cause"),
        F.col("top_cause_prob").alias("prob"),
        F.col("delta_m3").alias("delta"),
        F.col("z_delta").alias("z"),
    )
    # Watermarks need an instant, so wall-clock hours are read as UTC.
    timed = spread(hours, layout).select(
        "*",
        (layout.home() == F.col(PART)).alias("home"),
        F.timestamp_seconds(F.col("hour") * 3600).alias("event_time"),
    )
    return (
        timed.drop("ts")
        .withWatermark("event_time", lateness)
        .groupBy(METER, PART)
        .applyInPandasWithState(
            part_step(params, layout.size), FRAGMENT, STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def run_incidents(
    spark: SparkSession, path: str, folder: str, params: Params = DEFAULTS, **options
) -> None:
    """Take in the decisions that have arrived below ``path`` since the last run.

    All new files are one delivery: the watermark moves when they have all been read, so hours of
    different meters in different files are not late to each other.
    """
    schema = spark.read.parquet(path).schema
    arriving = spark.readStream.schema(schema).parquet(path)
    run_available(incident_fragments(arriving, params, **options), folder)


def joined_fragments(fragments: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Incidents of fragments: those of one cause without a gap between them are one."""
    order = Window.partitionBy(METER).orderBy("start")
    meets = (F.lag("cause").over(order) == F.col("cause")) & (
        F.col("start") - F.lag("end").over(order) <= params.incident_gap_h
    )
    first = F.when(~F.coalesce(meets, F.lit(False)), F.col("start"))
    begun = fragments.withColumn("_first", first).withColumn(
        "_first", F.last("_first", ignorenulls=True).over(order)
    )
    merged = begun.groupBy(METER, "_first", F.col("cause").alias("cause_en")).agg(
        F.max("end").alias("_end"),
        F.sort_array(F.flatten(F.collect_list("probs"))).alias("_probs"),
        F.sum("total").alias("_total"),
        F.max("worst").alias("_worst"),
    )
    hours = F.size("_probs").cast("bigint")
    return merged.select(
        METER,
        T.hour_from_number(F.col("_first")).alias("start"),
        T.hour_from_number(F.col("_end")).alias("end"),
        hours.alias("duration_h"),
        "cause_en",
        lookup_text(F.col("cause_en"), CAUSE_LABEL, F.col("cause_en")).alias("cause_ru"),
        N.round_half_even(N.quantile_of_sorted(F.col("_probs"), 0.5), 3).alias("confidence"),
        N.round_half_even(F.col("_total"), 4).alias("delta_m3_sum"),
        N.round_half_even(F.col("_total") / hours, 4).alias("delta_m3_mean"),
        N.round_half_even(F.col("_worst"), 2).alias("worst_z"),
        hours.alias("hours"),
    ).where(F.col("hours") >= params.min_duration_h)


def current_incidents(spark: SparkSession, folder: str, params: Params = DEFAULTS) -> DataFrame:
    """Incidents closed so far and those still open, as of the job's last run."""
    newest = F.max("version").over(Window.partitionBy(METER, PART))
    rows = read_output(spark, folder).withColumn("_newest", newest)
    valid = rows.where(
        (F.col("kind") == CLOSED) | ((F.col("kind") == PREVIEW) & (F.col("version") == F.col("_newest")))
    )
    return joined_fragments(valid, params)
