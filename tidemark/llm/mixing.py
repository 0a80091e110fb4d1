"""Mixing sources to target weights: random order per source, prefix sums, exact cuts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm.common import (
    BLANKS, WORD_PATTERN, any_columns, fresh, id_ranges, quoted, range_of, without,
)
from tidemark.plans.staging import stage_table

ADDED = ("size", "source_size", "target", "taken")
#: Leading hex digits of a random key that name its range: 4096 ranges in each source.
RANGE_DIGITS = 3
#: Rows without id, which share a key, fall into about so many ranges of size and text hash.
MISSING_RANGES = 1024


def running_total(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows in a total order, without one task for all rows."""
    part = "_part"
    parts = stage_table(
        df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "running"
    )
    # One row for each partition.
    offsets = (
        parts.groupBy(part)
        .agg(F.sum(value).alias("_sum"))
        .select(
            part,
            F.coalesce(
                F.sum("_sum").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ).alias("_offset"),
        )
    )
    inner = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inner), F.lit(0))
    return parts.join(offsets, part).withColumn(name, F.col("_offset") + own).drop(part, "_offset")


def source_targets(
    sizes: DataFrame, weights: Sequence[int], share: float, most: float
) -> DataFrame:
    """``source, source_size`` with the target of each source.

    Sources in code point order, null last, weigh ``weights`` in turn. They share ``share`` times
    all sizes by weight; a target stops at ``most`` times its source's size, and what is above is
    shared again by weight until no target is above.
    """
    ranked = running_total(
        sizes.withColumn("_one", F.lit(1)), [F.col("source").asc_nulls_last()], "_one", "rank"
    )
    weight = F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")
    )
    ranked = stage_table(ranked.drop("_one").withColumn("weight", weight), "sources")
    limit = F.lit(float(most)) * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        capped = F.col("weight") * F.lit(level) > limit
        n, held, free = ranked.agg(
            F.count(F.when(capped, 1)),
            F.sum(F.when(capped, F.col("source_size")).otherwise(0)),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))),
        ).first()
        if n == full or not free:
            break
        full, level = n, (share * total - most * held) / free
    target = F.least(limit, F.col("weight") * F.lit(level))
    return ranked.withColumn("target", target)


@any_columns
def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words of each document the mix takes.

    The result has the input's columns, ``size`` (words of the text), ``source_size``, ``target``
    of its source and ``taken``; input columns of these names are replaced. Each source's
    documents are ordered by a hash of seed and id. Whole epochs are taken while the target
    allows, then documents in that order until the rounded target is met to the word: the last
    one is taken in part. Key ranges are fixed by the hash, so a large source spreads over as
    many tasks as it has ranges and reruns agree.

    A null text has size 0. Documents without source form a source of their own, the last one.
    Documents without id share one random key, whose range is split by size and text. Ties are
    ordered by id, size and text, and repeated rows are documents of their own. An empty table
    gives an empty table.
    """
    docs = without(docs, *ADDED)
    key, rng, rank, before, src, r, g, offset, budget, epochs, tie, sub, s, tail = fresh(
        docs, "key", "range", "rank", "before", "src", "r", "g", "offset", "budget", "epochs",
        "tie", "sub", "s", "tail",
    )
    size = F.coalesce(F.regexp_count(quoted(text_col), F.lit(WORD_PATTERN)), F.lit(0))
    identity = F.coalesce(quoted(id_col).cast("string"), F.lit(""))
    # The text itself is moved only if the result needs it.
    sized = (
        docs.withColumn("size", size.cast("bigint"))
        .withColumn(key, F.md5(F.concat(F.lit(f"{seed}:"), identity).cast("binary")))
        .withColumn(tie, F.xxhash64(quoted(text_col)))
    )
    sizes = sized.groupBy(quoted(source_col).alias("source")).agg(
        F.sum("size").alias("source_size")
    )
    targets = stage_table(source_targets(sizes, weights, share, most), "targets").select(
        F.col("source").alias(src), F.col("rank").alias(rank), "source_size", "target"
    )
    # Size and the upper half of the text's hash, in the order of both.
    missing = quoted(id_col).isNull()
    sized = sized.withColumn(
        tail, F.when(missing, F.col("size") * (1 << 32) + F.shiftright(tie, 32))
    )
    cuts = id_ranges(sized.where(missing), tail, MISSING_RANGES)
    shared = F.md5(F.lit(f"{seed}:").cast("binary"))
    placed = (
        sized.join(targets, quoted(source_col).eqNullSafe(quoted(src)))
        .drop(src)
        .withColumn(rng, F.substring(key, 1, RANGE_DIGITS))
        .withColumn(
            sub,
            F.when(missing, range_of(tail, cuts)).otherwise(
                F.when(F.col(key) < shared, F.lit(-1)).otherwise(F.lit(len(cuts) + 1))
            ),
        )
        .drop(tail)
    )
    ranges = placed.groupBy(rank, rng, sub).agg(F.sum("size").alias("_sum"))
    earlier = W.partitionBy(rank).orderBy(rng, sub).rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.select(
        F.col(rank).alias(r),
        F.col(rng).alias(g),
        F.col(sub).alias(s),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias(offset),
    )
    order = W.partitionBy(rank, rng, sub).orderBy(key, quoted(id_col), "size", tie)
    inside = F.coalesce(
        F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    rest = F.col(budget) - F.col(epochs) * F.col("source_size")
    return (
        placed.join(
            offsets,
            (F.col(rank) == F.col(r)) & (F.col(rng) == F.col(g)) & (F.col(sub) == F.col(s)),
        )
        .withColumn(before, inside + F.col(offset))
        .withColumn(budget, F.floor(F.col("target") + 0.5).cast("bigint"))
        .withColumn(
            epochs,
            F.expr(f"CASE WHEN source_size > 0 THEN {budget} div source_size ELSE 0 END"),
        )
        .withColumn(
            "taken",
            F.col(epochs) * F.col("size")
            + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col(before))),
        )
        .select(*[quoted(c) for c in docs.columns], *ADDED)
    )


@F.pandas_udf(StringType())
def first_words(text: pd.Series, count: pd.Series) -> pd.Series:
    """The text up to the end of its ``count``-th word; null where either is null."""

    def cut(x: str | None, n: float) -> str | None:
        if x is None or n != n:
            return None
        rest = x.encode().split(None, int(n))
        if len(rest) <= n:
            return x
        return x.encode()[: len(x.encode()) - len(rest[-1])].rstrip(BLANKS.encode()).decode()

    return pd.Series([cut(x, n) for x, n in zip(text, count, strict=True)], dtype=object)


@any_columns
def mixed_documents(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of :func:`mix` as documents: one for each epoch, the last of them cut to its words.

    Documents of which nothing is taken do not occur; those of size 0 have nothing to take.
    """
    copy = fresh(mixed, "copy")[0]
    whole = F.expr("CASE WHEN size > 0 THEN taken div size ELSE 0 END")
    rest = F.expr("CASE WHEN size > 0 THEN taken % size ELSE 0 END")
    count = whole + F.signum(rest).cast("bigint")
    copies = mixed.withColumn(
        copy,
        F.explode(F.when(count > 0, F.sequence(F.lit(1), count))),
    )
    part = quoted(copy) > whole
    text = F.when(
        part, first_words(F.when(part, quoted(text_col)), F.when(part, rest).cast("double"))
    ).otherwise(quoted(text_col))
    return copies.withColumn(text_col, text).drop(copy, *ADDED)
