"""Helpers shared by the training-data operators.

Words are runs of bytes other than space and 0x09-0x0D; ``bytes.split()`` splits on just those.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tidemark.plans.staging import release as release

BLANKS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker handles at a time; a single longer text is handled alone.
SLICE_BYTES = 4 << 20

U64 = np.uint64


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not use yet, whatever its case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns that an operator is about to add."""
    clashing = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in clashing])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def any_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let an operator see plain names only; columns with other names get theirs back."""

    @wraps(operator)
    def call(docs: DataFrame, *args, **kwargs) -> DataFrame:
        odd = {f"_odd{i}_": c for i, c in enumerate(docs.columns) if not re.fullmatch(r"\w+", c)}
        if not odd:
            return operator(docs, *args, **kwargs)
        plain = {c: name for name, c in odd.items()}
        kwargs = {k: plain.get(v, v) if isinstance(v, str) else v for k, v in kwargs.items()}
        out = operator(docs.toDF(*[plain.get(c, c) for c in docs.columns]), *args, **kwargs)
        return out.toDF(*[odd.get(c, c) for c in out.columns])

    return call


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``limit`` bytes of one text column each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def map_texts(
    df: DataFrame,
    text: str,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str | StructType,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Apply ``fn`` to record batches with a bounded number of text bytes."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit integers; a bijection."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def id_ranges(df: DataFrame, column: str, n: int) -> list[int]:
    """At most ``n - 1`` ascending ids that cut the rows with an id into about equal ranges."""
    accuracy = max(10_000, 20 * n)
    quantiles = df.agg(
        F.percentile_approx(quoted(column), [i / n for i in range(1, n)] or [0.5], accuracy)
    ).first()[0]
    return sorted(set(quantiles or []))[: n - 1] if n > 1 else []


def range_of(column: str, cuts: list[int]) -> Column:
    """Index of the range of an id; an id equal to a cut belongs above it, null to the last.

    Binary search outside the plan: an expression would hold all cuts and look at each.
    """
    if not cuts:
        return F.lit(0)
    edges = np.array(cuts, np.int64)

    def search(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), side="right"))

    index = F.pandas_udf(search, IntegerType())(F.coalesce(quoted(column), F.lit(0)).cast("bigint"))
    return F.when(quoted(column).isNull(), len(cuts)).otherwise(index)


class Memo(dict):
    """A cache of two generations: when the young one is full it becomes the old one.

    Only :meth:`retire` drops keys, so what look-ups after it have found stays until the next.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.old: dict = {}

    def retire(self) -> None:
        """Make a full young generation the old one; to be called once before a lot."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def absent(self, keys: set) -> list:
        """Keys not held; those of the old generation move to the young one."""
        out = []
        for k in keys.difference(self.keys()):
            v = self.old.get(k)
            if v is None:
                out.append(k)
            else:
                self[k] = v
        return out
