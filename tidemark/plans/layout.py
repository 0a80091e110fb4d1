"""Parts as stored tables: bucketed, so that windows over them need no shuffle.

A table in parts is written once, halo copies included, in buckets by meter and part and sorted
by time inside each bucket. Whatever partitions by meter and part later (lags, rolling frames, run
lengths, islands, fills) reads its buckets as they lie; only summaries of one row per part move.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.series import METER, PART, Layout, spread
from tidemark.plans.staging import scratch_path


def store_parts(
    df: DataFrame, name: str, layout: Layout, buckets: int | None = None, path: str | None = None
) -> DataFrame:
    """Store a grid with the halo that ``layout`` asks for; the stored table, in parts.

    Operators take the result with the same ``layout`` and stay in its parts; the caller cuts
    the halo at the end (:func:`tidemark.plans.series.core`). There are as many buckets as
    shuffle partitions unless told otherwise, each one file. The table is registered under a
    fresh name in the session's catalog; its files stay where they are when the session ends.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or scratch_path(spark, name)
    parts = spread(df, layout)
    # Buckets use the hash of this shuffle, so each task writes one bucket.
    by_bucket = parts.repartition(buckets, METER, PART)
    table = _fresh_name(name)
    (
        by_bucket.write.bucketBy(buckets, METER, PART)
        .sortBy(METER, PART, layout.time)
        .option("path", path)
        .saveAsTable(table)
    )
    return spark.table(table)


def open_parts(
    spark: SparkSession, path: str, name: str, schema: str, layout: Layout, buckets: int
) -> DataFrame:
    """Register files that :func:`store_parts` left in an earlier session.

    ``schema`` is the table's, as DDL, with the part; ``layout`` and ``buckets`` are those it was
    stored with.
    """
    table = _fresh_name(name)
    spark.sql(
        f"CREATE TABLE {table} ({schema}) USING parquet "
        f"CLUSTERED BY ({METER}, {PART}) SORTED BY ({METER}, {PART}, {layout.time}) "
        f"INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def _fresh_name(name: str) -> str:
    return f"tidemark_{name.replace('-', '_')}_{uuid.uuid4().hex}"
