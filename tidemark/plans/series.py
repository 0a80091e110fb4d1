"""Windows over long series without one task per series.

Partitioning a window by ``meter_id`` alone would put a meter with a long history into a single
task. Every series is therefore cut into *parts* of a fixed number of hours (or days). A part
also receives copies of the rows just before and after it (its *halo*), so a bounded frame such
as ``lag`` or a rolling window sees exactly what it would see in the whole series. The copies are
made before the shuffle by a narrow ``explode`` and cost ``(before + after) / size`` extra rows.

Unbounded frames ("the last break before this hour") are answered inside the part first. What a
part needs from earlier parts is one value per part; those values are aggregated, carried forward
over the few parts of a meter, and joined back on the partitioning the rows already have.

The parts are defined by time, so the input has to be a gap-free grid
(:func:`tidemark.operators.grid.hourly_gap_fill` builds one).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import time as T

METER = "meter_id"
PART = "part"


@dataclass(frozen=True)
class Layout:
    """Length of a part and of its halo, in units of the time column.

    Functions that work inside parts take the very layout the parts were made with.
    """

    time: str = "ts"
    unit: str = "hour"
    size: int = 672
    before: int = 0
    after: int = 0

    def needing(self, before: int = 0, after: int = 0) -> Layout:
        wider = replace(self, before=max(self.before, before), after=max(self.after, after))
        if max(wider.before, wider.after) > self.size:
            raise ValueError(f"halo {before}/{after} exceeds the part size {self.size}")
        return wider

    def position(self) -> Column:
        """Running number of the hour or day."""
        if self.unit == "day":
            return T.day_number(F.col(self.time))
        return T.hour_number(F.col(self.time))

    def home(self) -> Column:
        """The part a row belongs to, as opposed to parts that only hold a copy."""
        return F.floor(self.position() / self.size)

    def memberships(self) -> Column:
        """Array of all parts that need the row."""
        offset = F.pmod(self.position(), F.lit(self.size))
        return F.array_compact(
            F.array(
                self.home(),
                F.when(offset < self.after, self.home() - 1),
                F.when(offset >= self.size - self.before, self.home() + 1),
            )
        )


HOURLY = Layout()
DAILY = Layout(time="day", unit="day", size=112)


def window(layout: Layout, *extra_keys: str) -> WindowSpec:
    """Rows of one part in time order."""
    return Window.partitionBy(METER, PART, *extra_keys).orderBy(layout.time)


def spread(df: DataFrame, layout: Layout) -> DataFrame:
    """Assign rows to parts, copying halo rows. Narrow: the shuffle comes with the first window."""
    return df.select("*", F.explode(layout.memberships()).alias(PART))


def core(df: DataFrame, layout: Layout) -> DataFrame:
    """Drop the halo copies and the part column."""
    return df.where(F.col(PART) == layout.home()).drop(PART)


def over_series(
    df: DataFrame, layout: Layout, body: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Run ``body`` on parts. A frame that is already in parts stays in them, so that operators
    can be chained on one shuffle; the caller then cuts the halo once at the end."""
    if PART in df.columns:
        return body(df)
    return core(body(spread(df, layout)), layout)


def over(layout: Layout, rows: str = "", group: tuple[str, ...] = ()) -> str:
    """The ``OVER`` clause of :func:`window`, for tables with hundreds of window columns."""
    keys = ", ".join((METER, PART, *group))
    return f"OVER (PARTITION BY {keys} ORDER BY {layout.time} {rows})"


def last_seen(
    parts: DataFrame,
    values: dict[str, str],
    layout: Layout,
    *,
    warmup: int | None = None,
    series_first: str | None = None,
    group: tuple[str, ...] = (),
    first_of_group: dict[str, str] | None = None,
) -> DataFrame:
    """Latest non-NULL value at or before each row, looking back over the whole series.

    ``values`` maps output columns to input columns (equal names replace the input). ``group``
    restricts the look-back to rows with equal group columns. ``warmup`` is the number of leading
    halo rows that cannot be trusted because they themselves looked back beyond the halo; by
    default the whole halo, and rows inside it then get no valid result. ``series_first`` names an
    output for the position of the first row of the series (or group). ``first_of_group`` maps
    further outputs to outputs of ``values``: their earliest non-NULL value in the whole group.
    """
    keys = [METER, PART, *group]
    leads = first_of_group or {}
    warmup = layout.before if warmup is None else warmup
    offset = F.pmod(layout.position(), F.lit(layout.size))
    # A part itself looks at its own rows, the rows after it and the trusted end of the halo
    # before it. Whatever lies further back comes from the summaries of earlier parts.
    settled = layout.size - layout.before + warmup
    keep = [c for c in parts.columns if c not in values]
    to_here = over(layout, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", group)
    anywhere = over(layout, "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING", group)
    local = parts.withColumns(
        {
            "_pos": layout.position(),
            "_home": layout.home() == F.col(PART),
            "_head": offset < settled,
            "_visible": (layout.home() >= F.col(PART)) | (offset >= settled),
        }
    ).selectExpr(
        *keep,
        "_pos",
        "_home",
        "_head",
        *[f"last(IF(_visible, {c}, NULL), true) {to_here} AS {n}" for n, c in values.items()],
        *[f"first(IF(_home, {values[n]}, NULL), true) {anywhere} AS {o}" for o, n in leads.items()],
    )

    # One row per part. Rows that are copied into the next part's halo are not in "head": the next
    # part sees them itself, in their proper order.
    latest = f"struct({', '.join(values)})"
    firsts = [f"first(struct({', '.join(leads)})) AS _leads"] if leads else []
    summary = (
        local.where("_home")
        .groupBy(*keys)
        .agg(
            *map(
                F.expr,
                [
                    "min(_pos) AS _first",
                    f"max_by({latest}, _pos) AS _all",
                    f"max_by({latest}, IF(_head, _pos, NULL)) AS _before_halo",
                    *firsts,
                ],
            )
        )
    )
    by_part = f"PARTITION BY {', '.join((METER, *group))} ORDER BY {PART}"
    whole = f"OVER ({by_part} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    older = f"OVER ({by_part} RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)"
    previous = f"OVER ({by_part} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
    first = [f"min(_first) {whole} AS {series_first}"] if series_first else []
    carried = summary.selectExpr(
        *keys,
        *[
            f"coalesce(last(_before_halo.{n}, true) {previous}, last(_all.{n}, true) {older})"
            f" AS _carried_{n}"
            for n in values
        ],
        *[f"first(_leads.{o}, true) {whole} AS _group_{o}" for o in leads],
        *first,
    )
    return local.join(carried, keys, "left").selectExpr(
        *keep,
        *[f"coalesce({n}, _carried_{n}) AS {n}" for n in values],
        *[f"_group_{o} AS {o}" for o in leads],
        *([series_first] if series_first else []),
    )


def run_lengths(
    parts: DataFrame, flags: dict[str, str], layout: Layout, warmup: int | None = None
) -> DataFrame:
    """Length of the current run of a true flag column, 0 outside a run.

    On a gap-free grid that is the distance to the last row whose flag is false.
    """
    breaks = parts.withColumn("_at", layout.position()).selectExpr(
        "*", *[f"IF({f}, NULL, _at) AS _break_{n}" for n, f in flags.items()]
    )
    seen = last_seen(
        breaks,
        {f"_break_{n}": f"_break_{n}" for n in flags},
        layout,
        warmup=warmup,
        series_first="_series_first",
    )
    return seen.selectExpr(
        *parts.columns,
        *[
            f"CAST(IF({f}, _at - coalesce(_break_{n}, _series_first - 1), 0) AS INT) AS {n}"
            for n, f in flags.items()
        ],
    )
