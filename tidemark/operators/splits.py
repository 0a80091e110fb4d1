"""Expanding-window folds, imputation inside a fold, and feature screening."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import time as T
from tidemark.operators.grid import with_series_bounds
from tidemark.params import DEFAULTS, Params
from tidemark.plans.fills import fill_gaps
from tidemark.plans.series import HOURLY, Layout, over_series


@dataclass(frozen=True)
class Folds:
    """Expanding folds of a gap-free series as arithmetic on the row number.

    With ``k`` folds the test blocks are the last ``k`` blocks of ``n // (k + 1)`` rows and each
    trains on everything before it. Folds that train on too short a span are left out and the
    others renumbered.
    """

    n_splits: int = DEFAULTS.n_splits
    min_train_days: int = DEFAULTS.min_train_days
    unit: str = "hour"

    def _positions(self) -> tuple[Column, Column, Column]:
        """Row number from 0, rows of the series, rows of a test block."""
        if self.unit == "day":
            start, end = (T.day_number(T.day_of(F.col(c))) for c in ("series_start", "series_end"))
            here = T.day_number(F.col("day"))
        else:
            start, end = (T.hour_number(F.col(c)) for c in ("series_start", "series_end"))
            here = T.hour_number(F.col("ts"))
        total = end - start + 1
        return here - start, total, F.floor(total / (self.n_splits + 1))

    def row(self) -> Column:
        return self._positions()[0]

    def block(self) -> Column:
        """The test block a row lies in, from 1; 0 before the first. Blocks do not overlap."""
        row, total, size = self._positions()
        into = row - (total - self.n_splits * size)
        return F.when((into >= 0) & (size > 0), F.floor(into / size) + 1).otherwise(F.lit(0)).cast("int")

    def memberships(self) -> Column:
        """Array of ``fold, role, first_test``: the folds a row takes part in, and the number of
        the row that ends their training."""
        row, total, size = self._positions()
        per_day = 1 if self.unit == "day" else 24
        found = []
        skipped = F.lit(0)
        for i in range(self.n_splits):
            first_test = total - (self.n_splits - i) * size
            long_enough = F.floor((first_test - 1) / per_day) + 1 >= self.min_train_days
            role = F.when(row < first_test, "train").when(row < first_test + size, "test")
            usable = long_enough & (size > 0) & role.isNotNull()
            fold = (F.lit(i) - skipped).cast("int")
            found.append(
                F.when(
                    usable,
                    F.struct(fold.alias("fold"), role.alias("role"), first_test.alias("first_test")),
                )
            )
            skipped = skipped + (~long_enough).cast("int")
        return F.array_compact(F.array(*found))


def expanding_splits(
    df: DataFrame,
    n_splits: int = DEFAULTS.n_splits,
    min_train_days: int = DEFAULTS.min_train_days,
    unit: str = "hour",
) -> DataFrame:
    """One copy of a row per fold it takes part in, with ``fold`` and ``role`` (:class:`Folds`).

    Row numbers follow from the series bounds, so the split is a narrow ``explode``: no window,
    no shuffle.
    """
    df = with_series_bounds(df)
    folds = Folds(n_splits, min_train_days, unit)
    return df.select("*", F.explode(folds.memberships()).alias("_f")).select(
        *df.columns, "_f.fold", "_f.role"
    )


def feature_array(df: DataFrame, features: list[str]) -> DataFrame:
    """The features as one array of doubles, ``_v``, with NaN for missing and infinite values."""
    floating = {c for c, kind in df.dtypes if kind in ("double", "float")}
    missing = "double('NaN')"
    values = [
        f"coalesce(IF(abs({c}) = double('infinity'), NULL, CAST({c} AS DOUBLE)), {missing})"
        if c in floating
        else f"coalesce(CAST(CAST({c} AS INT) AS DOUBLE), {missing})"
        for c in features
    ]
    return df.selectExpr(
        *[c for c in df.columns if c not in features], f"array({', '.join(values)}) AS _v"
    )


def impute(
    df: DataFrame,
    features: list[str],
    layout: Layout = HOURLY,
    *,
    group: tuple[str, ...] = (),
    backward: bool = True,
) -> DataFrame:
    """Fill gaps forward, then (for leading gaps) backward, then with 0.

    ``group`` keeps groups of rows apart. A leading gap only ever sees the first known value of
    its group, so the backward fill is an aggregate, not a second pass.
    """

    def body(parts: DataFrame) -> DataFrame:
        rest = [c for c in parts.columns if c not in features]
        key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}) if group else F.lit("")
        located = feature_array(parts, features).withColumns({"_at": layout.position(), "_key": key})
        filled = fill_gaps(located, "_v", "_at", {"_known": "_key"}, layout)
        value = "_known[{0}]" if backward else "IF(_known_from[{0}] >= 0, 0.0D, _known[{0}])"
        return filled.selectExpr(
            *rest, *[f"{value.format(i)} AS {c}" for i, c in enumerate(features)]
        )

    return over_series(df, layout, body)


def impute_folds(
    df: DataFrame, features: list[str], folds: Folds = Folds(), layout: Layout = HOURLY
) -> DataFrame:
    """``expanding_splits`` filled like :func:`impute` inside each fold and role."""
    df = with_series_bounds(df)
    own = [c for c in df.columns if c not in features]
    filled = fill_folds(feature_array(df, features), len(features), folds, layout)
    return filled.selectExpr(
        *own, "fold", "role", *[f"_v[{i}] AS {c}" for i, c in enumerate(features)]
    )


def fill_folds(
    df: DataFrame, width: int, folds: Folds = Folds(), layout: Layout = HOURLY
) -> DataFrame:
    """:func:`impute_folds` for features that are already an array, ``_v``, of ``width`` numbers.

    No row is copied before it is filled, so what is shuffled does not depend on the number of
    folds. A row is filled twice: as a test row inside its block, the only one it lies in, and as
    a training row over the whole series, where a leading gap also gets the number of the row
    that its value comes from. A fold's training then only has to know whether that row lies
    before its border. The copies are made at the end, by a narrow ``explode``.
    """
    df = with_series_bounds(df)
    own = [c for c in df.columns if c != "_v"]
    unknown = F.array_repeat(F.lit(float("nan")), width)

    def body(parts: DataFrame) -> DataFrame:
        kept = [c for c in parts.columns if c != "_v"]
        located = parts.withColumns(
            {
                "_v": F.coalesce("_v", unknown), "_row": folds.row().cast("bigint"), "_all": F.lit(""),
                "_block": folds.block().cast("string"), "_folds": folds.memberships(),
            }
        )
        strands = {"_series": "_all", "_test": "_block"}
        both = fill_gaps(located, "_v", "_row", strands, layout)
        exploded = both.select(*both.columns, F.explode("_folds").alias("_f"))
        return exploded.selectExpr(
            *kept,
            "_f.fold AS fold",
            "_f.role AS role",
            "CASE WHEN _f.role = 'test' THEN _test WHEN _series_from IS NULL THEN _series "
            "ELSE transform(_series, (x, i) -> IF(_series_from[i] >= _f.first_test, 0.0D, x)) END AS _v",
        )

    return over_series(df, layout, body).select(*own, "fold", "role", "_v")


def varying_features(df: DataFrame, features: list[str], vector: str | None = None) -> DataFrame:
    """One row per feature that takes more than one value; a single pass over all columns.

    ``vector`` names a column that holds the features' values, in their order.
    """
    if vector:
        values = vector_to_array(vector)
    else:
        values = F.array(*[F.col(c).cast("double") for c in features])
    ranges = (
        df.select(F.posexplode(values).alias("_i", "_v"))
        .groupBy("_i")
        .agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    )
    names = F.array(*[F.lit(c) for c in features])
    return ranges.where("_low <> _high").select(F.get(names, F.col("_i")).alias("feature"))


def class_weights(df: DataFrame, params: Params = DEFAULTS, label: str = "y") -> DataFrame:
    weight = F.when(F.col(label) == 1, params.weight_positive).otherwise(params.weight_negative)
    return df.withColumn("weight", weight)


def fold_facts(splits: DataFrame, keys: tuple[str, ...], time: str = "ts") -> DataFrame:
    """Sizes, positives and bounds of every fold: the part of a backtest that needs no model."""
    train, test = F.col("role") == "train", F.col("role") == "test"
    return splits.groupBy(*keys, "fold").agg(
        F.count_if(train).alias("n_train"),
        F.count_if(test).alias("n_test"),
        F.coalesce(F.sum(F.when(test, F.col("y"))), F.lit(0)).cast("bigint").alias("n_pos_te"),
        F.min(F.when(train, F.col(time))).alias("train_start"),
        F.max(F.when(train, F.col(time))).alias("train_end"),
        F.min(F.when(test, F.col(time))).alias("test_start"),
        F.max(F.when(test, F.col(time))).alias("test_end"),
    )


def horizon_rows(labelled: DataFrame, horizons: tuple[int, ...], name: str) -> DataFrame:
    """Wide labels ``y_<h>`` to one row per horizon."""
    pairs = F.array(
        *[F.struct(F.lit(h).alias(name), F.col(f"y_{h}").alias("y")) for h in horizons]
    )
    keep = [c for c in labelled.columns if c not in {f"y_{h}" for h in horizons}]
    return labelled.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*")

