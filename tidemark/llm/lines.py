"""Line dedup: normalised lines are exploded, hashed and counted; frequent ones go."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.common import BLANKS, any_columns, as_bytes, fresh, map_texts, quoted, without
from tidemark.plans.staging import stage_table

_BLANKS = BLANKS.encode()
_EMPTY = np.zeros((0, 2), "<i8")


def _hashes(text: bytes, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text, and the 128-bit hash of each key that is long enough."""
    lines = text.split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        key = line.strip(_BLANKS).lower()
        long = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        keys.append(xxhash.xxh3_128_digest(key) if long else None)
    return lines, keys


@any_columns
def drop_repeated_lines(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Drop lines whose key occurs in ``min_docs`` documents, except in the largest of these.

    A key is the line without blanks at both ends and with A-Z in lower case; keys of fewer than
    ``min_chars`` code points stay. The result has the input's columns with the remaining lines,
    joined by a line feed, as text, and ``n_lines`` (before) and ``n_dropped``; input columns of
    these two names are replaced.

    A null text is one line and stays null; an empty text is one empty line. Rows of the same id
    are one document when documents are counted, and each of them is returned. Rows without id
    neither count nor lose lines. An empty table gives an empty table.
    """
    docs = without(docs, "n_lines", "n_dropped")
    drop, one, two = fresh(docs, "drop", "h1", "h2")

    def keys_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, found = [], []
        for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            if i is not None and text:
                own = set(_hashes(text, min_chars)[1])
                own.discard(None)
                ids.extend([i] * len(own))
                found.extend(own)
        h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        return pa.record_batch(
            [pa.array(ids, batch.column(0).type), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())],
            names=["id", "h1", "h2"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    keys = map_texts(source, "text", keys_of, f"id {kind}, h1 bigint, h2 bigint")
    keys = stage_table(keys.distinct(), "line-keys")
    frequent = (
        keys.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("id").alias("last"))
        .where(F.col("n") >= min_docs)
        .drop("n")
    )
    # A key of many documents is one row on the right; as that side is a stored table, Spark can
    # split the left one.
    frequent = stage_table(frequent, "frequent-lines")
    drops = (
        keys.join(frequent, ["h1", "h2"])
        .where(F.col("id") != F.col("last"))
        .groupBy(F.col("id").alias(drop + "id"))
        .agg(F.collect_list("h1").alias(one), F.collect_list("h2").alias(two))
    )
    joined = docs.join(drops, quoted(id_col) == quoted(drop + "id"), "left").drop(drop + "id")
    names = docs.columns
    text_at = names.index(text_col)

    def rebuild(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, totals, dropped = [], [], []
        for text, h1, h2 in zip(
            as_bytes(batch.column(text_at)),
            batch.column(len(names)).to_pylist(),
            batch.column(len(names) + 1).to_pylist(),
            strict=True,
        ):
            if not h1 or text is None:
                texts.append(text)
                totals.append(1 if text is None else text.count(b"\n") + 1)
                dropped.append(0)
                continue
            gone = {bytes(r) for r in np.array([h1, h2], "<i8").T.copy()}
            lines, keys = _hashes(text, min_chars)
            kept = [x for x, k in zip(lines, keys, strict=True) if k not in gone]
            texts.append(b"\n".join(kept))
            totals.append(len(lines))
            dropped.append(len(lines) - len(kept))
        columns = [batch.column(i) for i in range(len(names))]
        columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.record_batch(
            [*columns, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())],
            names=[*names, "n_lines", "n_dropped"],
        )

    schema = docs.schema.add("n_lines", LongType()).add("n_dropped", LongType())
    return map_texts(joined, text_col, rebuild, schema)
