"""The corpus pipeline: from ``documents`` to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and reread as the next stage's ``docs``. All stages but the last return the columns of
``documents``; they handle nulls, repeated rows and empty tables as the operators they call.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, lines, mixing, packing, simhash
from tidemark.llm.queries import documents, tokenizer_path, vocabulary_path
from tidemark.llm.shipping import ship
from tidemark.plans.staging import stage_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SimHash has no SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def same_columns(stage: Stage) -> Stage:
    """Set other columns aside, so that none clashes with an operator's, and return them all."""

    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        names = [c if c in OWN else f"_own{i}_" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return call


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, if the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


@same_columns
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts and texts without letters; fills in a missing ``lang``.

    Where no language could be learned, a missing ``lang`` stays null.
    """
    found = language.identify(docs, vocabulary_path()).where("has_letters")
    return found.withColumn("lang", F.coalesce("lang", F.when(F.col("score") > 0, F.col("lang_pred"))))


@same_columns
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share; every document stays."""
    return _with_length(lines.drop_repeated_lines(docs))


@same_columns
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id."""
    return simhash.one_of_each(docs, words=3, distance=3)


@same_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, leaves out and cuts documents so that each source meets its target."""
    mixed = mixing.mixed_documents(mixing.mix(docs))
    return _with_length(mixed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    ship(spark)
    pieces = packing.pack_documents(docs, tokenizer_path())
    return pieces.select(
        F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"), "sequence_id", "offset", "ids",
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
