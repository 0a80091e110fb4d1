"""Filter interaction audit: what each filter removes under every order of the filters.

What a filter removes depends only on which filters a document fails, its *mask*. Documents are
therefore counted by part and mask first. The step at which an order removes a mask is a product
in the min-plus algebra: the mask matrix (0 where a mask fails a filter, infinite elsewhere)
combined with the matrix of positions (the inverse of each order's permutation), where sums take
the place of products and minima that of sums.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import any_columns, as_bytes, map_texts, quoted
from tidemark.plans.staging import stage_table

FILTERS = "ABCDE"
#: The bit of filter E.
REPEATED = 1 << 4
#: A part's report has ``steps * steps!`` rows, so longer lists of filters are refused.
MOST_FILTERS = 7

# Thresholds of the filters.
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
_MARKUP = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def orders(n: int) -> np.ndarray:
    """All permutations of ``n`` filters, one row each, in lexicographic order."""
    return np.array(list(permutations(range(n))), np.int64).reshape(factorial(n), n)


def removal_steps(n: int) -> np.ndarray:
    """``[mask, order]``: the step, from 1, that removes documents of a mask; infinite for none."""
    masks = np.arange(1 << n)[:, None] >> np.arange(n) & 1
    failing = np.where(masks == 1, 0.0, np.inf)  # masks x filters
    positions = np.argsort(orders(n), axis=1).T + 1.0  # filters x orders
    return (failing[:, :, None] + positions[None, :, :]).min(axis=1)


class Audit:
    """The counts of a part's report, from the number of documents of each mask."""

    def __init__(self, n: int):
        if not 1 <= n <= MOST_FILTERS:
            raise ValueError(f"between 1 and {MOST_FILTERS} filters")
        self.n = n
        self.orders = orders(n)
        self.steps = removal_steps(n)
        self.fails = (np.arange(1 << n)[:, None] >> np.arange(n) & 1) == 1

    def scatter(self, weights: np.ndarray) -> np.ndarray:
        """``[order, step]``: sums of the masks' weights at the step that removes them."""
        out = np.zeros((len(self.orders), self.n), np.int64)
        masks, rows = np.nonzero(np.isfinite(self.steps))
        np.add.at(out, (rows, self.steps[masks, rows].astype(np.int64) - 1), weights[masks])
        return out

    def report(self, rows: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
        """Each count as ``[order, step]``; the arguments hold one number for each mask."""
        removed = self.scatter(rows)
        failing = (rows[:, None] * self.fails).sum(axis=0)[self.orders]
        alone = rows[1 << np.arange(self.n)][self.orders]
        by_filter = np.zeros(self.n, np.int64)
        np.add.at(by_filter, self.orders, removed)
        return {
            "kept": rows.sum() - np.cumsum(removed, axis=1),
            "removed": removed,
            # A document that fails a filter and is not removed by it was removed before it.
            "redundant": failing - removed,
            "unique_fails": alone,
            "good_lost": self.scatter(good),
            "toxic_lost": self.scatter(toxic),
            "shapley": by_filter[self.orders],
        }


def audit(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``part, mask, n, good, toxic``.

    Bit ``i`` of ``mask`` says that ``n`` documents fail filter ``names[i]``; ``good`` and
    ``toxic`` of them carry that label. Rows of equal part and mask add up. Result: ``part,
    filter_order, step`` and the columns ``COUNTS``. No rows give no rows.
    """
    shape = Audit(len(names))
    size = 1 << shape.n
    labels = ["".join(names[f] for f in o) for o in shape.orders]
    # At most one row for each mask: a part fits one list.
    parts = (
        masks.groupBy("part", "mask")
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n", "good", "toxic")])
        .groupBy("part")
        .agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                weights = np.zeros((3, size), np.int64)
                for row in found:
                    weights[:, row["mask"]] = row["n"], row["good"], row["toxic"]
                counts = shape.report(*weights)
                rows = len(labels) * shape.n
                yield pa.record_batch(
                    [
                        pa.array([part] * rows, pa.string()),
                        pa.array(np.repeat(labels, shape.n), pa.string()),
                        pa.array(np.tile(np.arange(1, shape.n + 1), len(labels)).astype(np.int32)),
                        *[pa.array(counts[c].ravel(), pa.int64()) for c in COUNTS],
                    ],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    schema = "part string, filter_order string, step int, " + ", ".join(
        f"{c} bigint" for c in COUNTS
    )
    return parts.mapInArrow(run, schema)


def _text_mask(data: bytes) -> int:
    """Bits of the filters that look at one text: A, B, C and D."""
    words = data.split()
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    points = len(data) if data.isascii() else len(data.decode())
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS_PERCENT * points) << 2
        | (_MARKUP.search(data) is not None) << 3
    )


@any_columns
def document_masks(
    docs: DataFrame,
    labels: DataFrame,
    part_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and the filters that they fail.

    Filters: A under 200 words, B under 50 % distinct words, C more than 2 % capitals, D markup
    characters, E the text of a smaller id again. Texts are compared by 128-bit hashes; a null
    text is an empty one and a null part the empty part. Repeated rows count each. Rows without
    id never fail E, make no other row fail it and have no label. A document is good (toxic) if
    any of its labels is 1; other columns of both tables are not read.
    """

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in as_bytes(batch.column(2))]
        digests = b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts)
        h = np.frombuffer(digests, "<i8").reshape(-1, 2)
        return pa.record_batch(
            [
                batch.column(0),
                batch.column(1),
                pa.array([_text_mask(t) for t in texts], pa.int32()),
                pa.array(h[:, 0].copy()),
                pa.array(h[:, 1].copy()),
            ],
            names=["id", "part", "mask", "h1", "h2"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(
        quoted(id_col).alias("id"),
        F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"),
        quoted(text_col).alias("text"),
    )
    judged = map_texts(source, "text", judge, f"id {kind}, part string, mask int, h1 bigint, h2 bigint")
    # Equal rows become one before the first join, so no id is frequent there.
    judged = judged.groupBy("id", "part", "mask", "h1", "h2").agg(F.count("*").alias("n"))
    judged = stage_table(judged, "judged-documents")  # rows with and without id part ways below
    marks = labels.groupBy(quoted(id_col).alias("id")).agg(
        F.max(F.expr("quality = 1")).alias("good"), F.max(F.expr("toxic = 1")).alias("toxic")
    )
    rare = judged.where("id IS NOT NULL").join(marks.where("id IS NOT NULL"), "id", "left")
    no_mark = F.lit(None).cast("boolean")
    marked = rare.unionByName(
        judged.where("id IS NULL").withColumns({"good": no_mark, "toxic": no_mark})
    )
    # Copies of a text differ in part and labels only: of each such class the smallest id and how
    # many rows have it are enough to tell which rows fail E.
    texts = stage_table(
        marked.groupBy(
            "h1", "h2", "mask", "part",
            F.coalesce("good", F.lit(False)).alias("good"),
            F.coalesce("toxic", F.lit(False)).alias("toxic"),
        ).agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
            F.min("id").alias("least"),
            F.min_by("n", "id").alias("n_least"),
        ),
        "text-classes",
    )
    firsts = texts.groupBy("h1", "h2").agg(F.min("least").alias("first"))
    original = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    counted = texts.join(stage_table(firsts, "first-texts"), ["h1", "h2"]).select(
        "part", "mask", "good", "toxic", "n", original.alias("original")
    )
    split = counted.select(
        "part", "good", "toxic",
        F.explode(
            F.array(
                F.struct("mask", F.col("original").alias("n")),
                F.struct(
                    F.col("mask").bitwiseOR(F.lit(REPEATED)).alias("mask"),
                    (F.col("n") - F.col("original")).alias("n"),
                ),
            )
        ).alias("m"),
    )
    n = F.col("m.n")
    return split.groupBy("part", F.col("m.mask").alias("mask")).agg(
        F.sum(n).alias("n"),
        F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"),
    )
