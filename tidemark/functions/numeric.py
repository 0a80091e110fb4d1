"""NULL-safe numeric expressions.

Missing values are always SQL NULL: NaN sorts above every number in Spark, so it is turned into
NULL wherever text or foreign data enters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal or scientific number; anything else (type suffixes, words) is "not a number".
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def finite(value: Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def parse_number(text: Column) -> Column:
    """Text to double; text that is no number becomes NULL instead of failing the job."""
    as_text = text.cast("string")
    return F.when(as_text.rlike(NUMBER_PATTERN), finite(F.trim(as_text).try_cast("double")))


def number_or(text: Column, default: float) -> Column:
    """Like :func:`parse_number` with a default for whatever is not a number."""
    return F.coalesce(parse_number(text), F.lit(float(default)))


def at_least(value: Column, floor: float) -> Column:
    """``max(value, floor)`` that keeps NULL (``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(float(floor))))


def larger(a: Column, b: Column) -> Column:
    """The larger of two values, NULL if either is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def relative_difference(a: Column, b: Column, eps: float) -> Column:
    """``|a - b|`` relative to the larger of the two."""
    return F.abs(a - b) / at_least(larger(a, b), eps)


def round_half_even(value: Column, digits: int) -> Column:
    """Scale, round half to even, unscale: the rounding that report columns use."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def quantile_of_sorted(values: Column, q: float) -> Column:
    """Linear-interpolated quantile of an ascending array without NULLs; NULL if it is empty."""
    position = (F.size(values) - 1) * F.lit(float(q))
    below, above = F.floor(position), F.ceil(position)
    low = F.get(values, below.cast("int"))
    high = F.get(values, above.cast("int"))
    return F.when(below == above, low).otherwise(
        low * (above - position) + high * (position - below)
    )
