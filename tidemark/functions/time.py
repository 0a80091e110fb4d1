"""Calendar expressions on ``timestamp_ntz``.

``date_trunc`` and ``timestampdiff`` go through the session time zone, so they would shift hours
at a daylight-saving change. The expressions below only combine dates and hour numbers.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS_PER_WEEK = 168

# The date format and the hour-interval pattern of delivered files.
DATE_FORMAT = "d.M.yyyy"
RIGHT_BOUND_PATTERN = r"-(\d{1,2})$"
DASHES = "–—"  # en dash, em dash


def day_of(ts: Column) -> Column:
    return ts.cast("date")


def add_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"))


def hour_floor(ts: Column) -> Column:
    """Start of the hour that contains ``ts``."""
    return add_hours(day_of(ts).cast("timestamp_ntz"), F.hour(ts))


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long")


def hour_number(ts: Column) -> Column:
    """Hours since the epoch."""
    return day_number(day_of(ts)) * 24 + F.hour(ts)


def hour_from_number(number: Column) -> Column:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(number / 24).cast("int"))
    return add_hours(day.cast("timestamp_ntz"), F.pmod(number, F.lit(24)))


def wall_clock(value: datetime | None) -> Column:
    """A literal of a time as the driver got it; by its text, as no zone touches that."""
    return F.lit(value and str(value)).cast("timestamp_ntz")


def utc_instant(ts: Column) -> Column:
    """The instant at which a clock in UTC shows ``ts``: what watermarks take."""
    seconds = hour_number(ts) * 3600 + F.minute(ts) * 60
    fraction = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.timestamp_micros(seconds * 1_000_000 + fraction)


def parse_date(text: Column) -> Column:
    """Day-first dotted dates, else ISO dates or timestamps, else NULL."""
    dotted = F.try_to_date(F.trim(text), DATE_FORMAT).cast("timestamp_ntz")
    return F.coalesce(dotted, F.trim(text).try_cast("timestamp_ntz"))


def parse_hour_bound(text: Column) -> Column:
    """Right bound of an hour interval such as ``0-1``; NULL if the text has another form."""
    cleaned = F.trim(F.translate(text.cast("string"), DASHES, "--"))
    return F.regexp_extract(cleaned, RIGHT_BOUND_PATTERN, 1).try_cast("int")


def hour_start(date: Column, right_bound: Column) -> Column:
    return add_hours(date, right_bound - 1)


def monday_weekday(ts: Column) -> Column:
    return F.weekday(ts)


def hour_of_week(weekday: Column, ts: Column) -> Column:
    """0..167; a missing weekday falls back to the calendar."""
    return F.coalesce(weekday.cast("int"), monday_weekday(ts)) * 24 + F.hour(ts)


def weekday_to_zero_based(value: Column, low: Column, high: Column) -> Column:
    """Weekday numbers as 0..6, judged by the range the whole series uses (0..6 or 1..7)."""
    return (
        F.when((low >= 0) & (high <= 6), value)
        .when((low >= 1) & (high <= 7), value - 1)
        .cast("int")
    )
