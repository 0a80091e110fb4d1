"""Horizon classifiers on Spark MLlib: training, backtests and forecasts.

One model per horizon is trained on all meters together. Feature tables stay distributed; only
feature names, fold counts and metrics reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import time as T
from tidemark.operators import features as X
from tidemark.operators import metrics as M
from tidemark.operators import splits as P
from tidemark.operators.grid import with_series_bounds
from tidemark.params import DEFAULTS, Params
from tidemark.plans.series import DAILY, HOURLY, METER, Layout, over_series, window
from tidemark.plans.staging import drop_table, release, stage_table

PARALLEL_FITS = 6  # driver threads that submit fits; every fit is a distributed job
#: Feature values that horizons of a backtest may work on together. Each horizon has a shuffle and
#: a table of its folds, and a fit caches its rows.
CELLS_AT_ONCE = 1 << 29


def build_estimator(
    name: str, params: Params = DEFAULTS, validation: str | None = None
) -> Estimator:
    """Classifier by name.

    Boosting stops early once the loss on rows where the column ``validation`` is true does not
    improve any more; the other models do not look at it.
    """
    common = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight"}
    stopping = {"validationIndicatorCol": validation, "validationTol": params.validation_tol}
    builders: dict[str, Callable[[], Estimator]] = {
        "gbt": lambda: GBTClassifier(
            maxDepth=params.max_depth,
            stepSize=params.step_size,
            maxIter=params.max_iter,
            seed=params.seed,
            **(stopping if validation else {}),
            **common,
        ),
        "rf": lambda: RandomForestClassifier(
            maxDepth=params.max_depth, numTrees=params.max_iter, seed=params.seed, **common
        ),
        "logreg": lambda: LogisticRegression(maxIter=params.max_iter, **common),
    }
    if name.lower() not in builders:
        raise ValueError(f"unknown model {name!r}; known are {', '.join(builders)}")
    return builders[name.lower()]()


@dataclass(frozen=True)
class Granularity:
    """What differs between hourly and daily models."""

    name: str
    time: str
    unit: str
    horizon: str
    layout: Layout
    feature_names: Callable[[DataFrame, Params], list[str]]
    horizons: Callable[[Params], tuple[int, ...]]
    min_train_days: Callable[[Params], int]
    number: Callable[[Column], Column]


HOURS = Granularity(
    "hourly", "ts", "hour", "horizon_h", HOURLY, X.hourly_feature_names,
    lambda p: p.hour_horizons, lambda p: p.min_train_days,
    T.hour_number,
)
DAYS = Granularity(
    "daily", "day", "day", "horizon_d", DAILY, X.daily_feature_names,
    lambda p: p.day_horizons, lambda p: p.min_train_days_daily,
    lambda c: T.day_number(T.day_of(c)),
)


@dataclass
class Bundle:
    """Trained models with the features each of them reads."""

    granularity: Granularity
    models: dict[int, PipelineModel] = field(default_factory=dict)
    features: dict[int, list[str]] = field(default_factory=dict)
    losses: dict[int, list[float]] = field(default_factory=dict)


def labelled_hours(base: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Hourly features with ``y_<h>`` labels, materialised once for all fits."""
    base = with_series_bounds(base)
    table = X.hour_horizon_labels(X.hourly_features(base, params), params.hour_horizons)
    names = X.hourly_feature_names(table, params)
    ys = [f"y_{h}" for h in params.hour_horizons]
    return stage_table(
        table.select(METER, "ts", "series_start", "series_end", *names, *ys), "hourly-features"
    )


def labelled_days(base: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Daily features with ``y_<d>`` labels, aligned by day."""
    base = with_series_bounds(base)
    table = X.daily_features(X.daily_table(base), params)
    labels = X.day_horizon_labels(X.day_labels(base), params.day_horizons)
    names = X.daily_feature_names(table, params)
    ys = [f"y_{d}" for d in params.day_horizons]
    return stage_table(
        X.align_day_labels(table, labels).select(
            METER, "day", "series_start", "series_end", *names, *ys
        ),
        "daily-features",
    )


def _horizon_table(
    table: DataFrame, kind: Granularity, horizon: int, names: list[str], params: Params
) -> DataFrame:
    """Labels of one horizon with the features, as one array, of so many rows earlier."""
    steps = horizon if params.feature_shift == "horizon" else 0
    one = table.select(
        METER, kind.time, "series_start", "series_end", F.col(f"y_{horizon}").alias("y"), *names
    )
    return X.shift_features(P.feature_array(one, names), ["_v"], steps, kind.layout)


def with_vector(rows: DataFrame, names: list[str]) -> DataFrame:
    """All features of a row as ``vector``, stored beside them.

    A fit is hundreds of small jobs, and every job carries the plan of its input. Read back as one
    column, hundreds of features make a short plan.
    """
    return VectorAssembler(inputCols=names, outputCol="vector").transform(rows)


def _chosen_vector(rows: DataFrame, names: list[str], chosen: list[str]) -> DataFrame:
    """``vector`` narrowed to the chosen features, as ``features``."""
    places = [names.index(c) for c in chosen]
    return VectorSlicer(inputCol="vector", outputCol="features", indices=places).transform(rows)


def _fit(
    train: DataFrame,
    names: list[str],
    chosen: list[str],
    params: Params,
    validation: str | None = None,
) -> PipelineModel:
    more = [validation] if validation else []
    rows = _chosen_vector(train, names, chosen).select("y", *more, "features")
    model = build_estimator(params.model_name, params, validation).fit(P.class_weights(rows, params))
    return PipelineModel([VectorAssembler(inputCols=chosen, outputCol="features"), model])


def _varying(train: DataFrame, names: list[str]) -> list[str]:
    """At most one row per column of the schema reaches the driver."""
    found = {r["feature"] for r in P.varying_features(train, names, "vector").collect()}
    return [n for n in names if n in found]


def _has_both_classes(train: DataFrame) -> bool:
    low, high = train.agg(F.min("y"), F.max("y")).first()
    return low is not None and low != high


def shared_rows(table: DataFrame, kind: Granularity, params: Params = DEFAULTS) -> DataFrame:
    """One stored table of filled features that all horizons train on.

    Training on features of ``h`` hours earlier needs no shifted copy of the features for each
    horizon: the labels move instead. ``l_<h>`` are the labels that a row's features predict. The
    first row of a series also stands for the ``h`` rows before any shifted value is known, which
    a backward fill gives its values. ``place`` is the row's share of its series' length.
    """
    names = kind.feature_names(table, params)
    horizons = kind.horizons(params)
    steps = {h: h if params.feature_shift == "horizon" else 0 for h in horizons}
    layout = kind.layout.needing(after=max(*steps.values(), 1))
    first = F.col(kind.time) == F.col("series_start").cast(dict(table.dtypes)[kind.time])
    length = F.col("_last") - F.col("_first") + 1

    def labels(parts: DataFrame) -> DataFrame:
        order = window(layout)
        ahead = {
            h: [F.lead(f"y_{h}", i).over(order) for i in range(1, s + 1)] for h, s in steps.items()
        }
        found = {
            f"l_{h}": F.array(F.col(f"y_{h}"), *ahead[h])
            if steps[h]
            else F.array(f"y_{h}")
            for h in horizons
        }
        return parts.withColumns(found)

    moved = over_series(table, layout, labels)
    bounds = {
        "_first": kind.number(F.col("series_start")), "_last": kind.number(F.col("series_end")),
        "_here": kind.number(F.col(kind.time)),
    }
    known = lambda h: F.filter(f"l_{h}", lambda y: y.isNotNull())
    # Only the first row keeps all labels; the others predict the one ``h`` steps on, if any.
    own = {
        f"l_{h}": F.when(first, known(h)).otherwise(
            F.array_compact(F.array(F.get(f"l_{h}", F.lit(s))))
        )
        for h, s in steps.items()
    }
    rows = moved.withColumns(own).select(
        METER, kind.time, "series_start", "series_end", *names, *own
    )
    filled = with_vector(P.impute(rows, names, kind.layout), names)
    return stage_table(
        filled.withColumns(bounds)
        .withColumn("place", (F.col("_here") - F.col("_first")) / length)
        .drop("_first", "_last", "_here"),
        f"{kind.name}-shared",
    )


def horizon_samples(shared: DataFrame, horizon: int, names: list[str], params: Params) -> DataFrame:
    """``y``, ``held_out`` and the features of one horizon's training rows.

    Held out is the tail of every series: the last ``validation_share`` of its rows.
    """
    return shared.select(
        (F.col("place") >= 1 - params.validation_share).alias("held_out"),
        *names,
        F.explode(f"l_{horizon}").alias("y"),
    )


def train_models(table: DataFrame, kind: Granularity, params: Params = DEFAULTS) -> Bundle:
    """One classifier per horizon. Horizons with one class or no varying feature are left out.

    With a ``validation_share`` boosting is judged on the held-out tail of every series, round
    by round, and stops early; the bundle keeps the losses. Without (0), or where either part has
    one class, it runs all rounds on all rows.
    """
    names = kind.feature_names(table, params)
    shared = shared_rows(table, kind, params)

    def one(horizon: int):
        rows = horizon_samples(shared, horizon, ["vector"], params)
        if not _has_both_classes(rows):
            return horizon, None, [], []
        chosen = _varying(rows, names)
        if not chosen:
            return horizon, None, [], []
        held, seen = rows.where("held_out"), rows.where("NOT held_out")
        judged = params.validation_share > 0 and _has_both_classes(held) and _has_both_classes(seen)
        model = _fit(rows, names, chosen, params, "held_out" if judged else None)
        losses = _losses(model, _chosen_vector(held, names, chosen), params) if judged else []
        return horizon, model, chosen, losses

    bundle = Bundle(kind)
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        for horizon, model, chosen, losses in pool.map(one, kind.horizons(params)):
            if model is not None:
                bundle.models[horizon] = model
                bundle.features[horizon] = chosen
                bundle.losses[horizon] = losses
    return bundle


def _losses(model: PipelineModel, held: DataFrame, params: Params) -> list[float]:
    """Loss on the held-out rows after each round of boosting, or of the finished model."""
    weighted = P.class_weights(held, params)
    classifier = model.stages[-1]
    if isinstance(classifier, GBTClassificationModel):
        return list(classifier.evaluateEachIteration(weighted))
    p = F.col("p")
    right = F.greatest(F.when(F.col("y") == 1, p).otherwise(1 - p), F.lit(1e-15))
    scored = probability(classifier, weighted, "p")
    return [scored.agg(F.sum(-F.log(right) * F.col("weight")) / F.sum("weight")).first()[0]]


def training_log(spark: SparkSession, bundle: Bundle) -> DataFrame:
    """``<horizon>, model, n_features, round, loss``: a row for each round that was judged."""
    rows = [
        (h, type(m.stages[-1]).__name__, len(bundle.features[h]), i, loss)
        for h, m in sorted(bundle.models.items())
        for i, loss in enumerate(bundle.losses.get(h) or [None], 1)
    ]
    return spark.createDataFrame(
        rows,
        f"{bundle.granularity.horizon} int, model string, n_features int, round int, loss double",
    )


def probability(model: Transformer, rows: DataFrame, name: str) -> DataFrame:
    scored = model.transform(rows)
    return scored.withColumn(name, F.get(vector_to_array("probability"), 1)).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def backtest(table: DataFrame, kind: Granularity, params: Params = DEFAULTS) -> DataFrame:
    """F1, ROC-AUC, sizes and bounds per horizon and expanding fold.

    A horizon's folds are the features once more and in copies. They are stored, scored and
    deleted before the next horizon's, unless the table is so small that several fit side by side.
    """
    names = kind.feature_names(table, params)
    spark = table.sparkSession
    folds = P.Folds(params.n_splits, kind.min_train_days(params), kind.unit)

    def fold_rows(horizon: int) -> DataFrame:
        shifted = _horizon_table(table, kind, horizon, names, params)
        filled = P.fill_folds(shifted, len(names), folds, kind.layout)
        return stage_table(filled.withColumn("vector", array_to_vector("_v")).drop("_v"), f"{kind.name}-folds-{horizon}")

    def score(rows: DataFrame, fold: int) -> DataFrame | None:
        train = rows.where((F.col("fold") == fold) & (F.col("role") == "train"))
        test = rows.where((F.col("fold") == fold) & (F.col("role") == "test"))
        if not _has_both_classes(train):
            return None
        chosen = _varying(train, names)
        if not chosen:
            return None
        model = _fit(train, names, chosen, params).stages[-1]
        rows = _chosen_vector(test, names, chosen).select("fold", "y", "features")
        return probability(model, rows, "score").select("fold", "y", "score")

    def one(horizon: int) -> DataFrame | None:
        rows = fold_rows(horizon)
        release(spark)
        at = F.lit(horizon).alias(kind.horizon)
        found = []
        for fold in range(params.n_splits):
            scored = score(rows, fold)
            if scored is not None:
                name = f"{kind.name}-scored-{horizon}-{fold}"
                found.append(stage_table(scored.select(at, "*"), name))
            release(spark)
        drop_table(rows)
        return concat_horizons(found) if found else None

    horizons = kind.horizons(params)
    at_once = CELLS_AT_ONCE // max(1, table.count() * len(names))
    release(spark)
    with ThreadPoolExecutor(max(1, min(PARALLEL_FITS, at_once))) as pool:
        found = dict(zip(horizons, pool.map(one, horizons), strict=True))
    parts = {h: scored for h, scored in found.items() if scored is not None}
    if not parts:
        bounds = "date" if kind.unit == "day" else "timestamp_ntz"
        return spark.createDataFrame(
            [],
            f"{kind.horizon} int, fold int, f1 double, roc_auc double, n_train bigint, "
            f"n_test bigint, n_pos_te bigint, train_start {bounds}, train_end {bounds}, "
            f"test_start {bounds}, test_end {bounds}",
        )
    keys = (kind.horizon, "fold")
    union = concat_horizons([*parts.values()])
    labels = table.select(METER, kind.time, "series_start", "series_end", *[f"y_{h}" for h in parts])
    splits = labels.select("*", F.explode(folds.memberships()).alias("_f"))
    splits = splits.select(*labels.columns, "_f.fold", "_f.role")
    long = P.horizon_rows(splits, tuple(parts), kind.horizon)
    facts = P.fold_facts(long, (kind.horizon,), kind.time)
    quality = M.f1_score(union, keys, params).join(M.roc_auc(union, keys), list(keys))
    return quality.join(facts, list(keys)).select(
        *keys, "f1", "roc_auc", "n_train", "n_test", "n_pos_te", "train_start", "train_end",
        "test_start", "test_end",
    )


def concat_horizons(parts: list[DataFrame]) -> DataFrame:
    """Per-horizon tables as one long table."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def latest_features(
    table: DataFrame, names: list[str], kind: Granularity, params: Params = DEFAULTS
) -> DataFrame:
    """The newest feature row of every meter, gaps filled from earlier rows, then with 0."""
    kinds = dict(table.dtypes)
    last = table.groupBy(METER).agg(
        F.max(kind.time).alias(kind.time),
        *[F.expr(f"max_by({c}, IF({c} IS NULL, NULL, {kind.time}))").alias(c) for c in names],
    )
    numbers = {c: f"CAST({c} AS INT)" if kinds[c] == "boolean" else c for c in names}
    return last.selectExpr(
        METER, kind.time, *[f"coalesce(CAST({n} AS DOUBLE), 0.0D) AS {c}" for c, n in numbers.items()]
    )


def forecast(table: DataFrame, bundle: Bundle, params: Params = DEFAULTS) -> DataFrame:
    """Anomaly probability of the hours (or days) that follow every meter's last row."""
    kind = bundle.granularity
    short = "h" if kind.unit == "hour" else "d"
    target = "ts_for" if kind.unit == "hour" else "day_for"
    names = sorted({n for chosen in bundle.features.values() for n in chosen})
    if not names:
        kind_type = "timestamp_ntz" if kind.unit == "hour" else "date"
        return table.sparkSession.createDataFrame(
            [], f"{METER} bigint, {short} int, {target} {kind_type}, p_anomaly double, is_anomaly int"
        )
    rows = latest_features(table, names, kind, params)
    parts = []
    for horizon, model in sorted(bundle.models.items()):
        when = (
            T.add_hours(F.col(kind.time), F.lit(horizon))
            if kind.unit == "hour"
            else F.date_add(kind.time, horizon)
        )
        p = F.col("p")
        parts.append(
            probability(model, rows, "p").select(
                METER,
                F.lit(horizon).alias(short),
                when.alias(target),
                N.round_half_even(p, 4).alias("p_anomaly"),
                (p >= params.threshold).cast("int").alias("is_anomaly"),
            )
        )
    return concat_horizons(parts)


def save_bundle(bundle: Bundle, path: str) -> None:
    """Models below ``path`` and a manifest of their features."""
    spark = SparkSession.getActiveSession()
    kind = bundle.granularity
    rows = []
    for horizon, model in bundle.models.items():
        where = f"{path}/{kind.name}-{horizon}"
        model.write().overwrite().save(where)
        rows.append((kind.name, horizon, bundle.features[horizon], where))
    spark.createDataFrame(
        rows, "granularity string, horizon int, features array<string>, path string"
    ).write.mode("overwrite").json(f"{path}/manifest-{kind.name}")


def load_bundle(path: str, kind: Granularity) -> Bundle:
    spark = SparkSession.getActiveSession()
    manifest = spark.read.schema(
        "granularity string, horizon int, features array<string>, path string"
    ).json(f"{path}/manifest-{kind.name}")
    bundle = Bundle(kind)
    for row in manifest.collect():  # one row per horizon
        bundle.models[row["horizon"]] = PipelineModel.load(row["path"])
        bundle.features[row["horizon"]] = list(row["features"])
    return bundle
