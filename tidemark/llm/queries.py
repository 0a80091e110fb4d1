"""The queries of the training-data operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, interactions, language, lines, mixing, negatives, packing
from tidemark.llm import recompression, secrets, simhash, suffixes, tokens, topk
from tidemark.llm.oracle import SQL
from tidemark.llm.shipping import ship
from tidemark.plans.staging import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sha(text: str) -> F.Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(documents(spark, sf_dir), tokenizer_path())
    return pieces.select(
        F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"), "sequence_id", "offset",
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    tokens.write_token_files(documents(spark, sf_dir), path, tokenizer_path())
    return tokens.read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return recompression.drop_repeated_passages(docs).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_fingerprints(documents(spark, sf_dir)).withColumnRenamed(
        "id", "doc_id"
    )


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return suffixes.drop_earlier_passages(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lines.drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", sha("text").alias("kept_sha256")
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return language.identify(docs, vocabulary_path()).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return secrets.secret_report(secrets.find_secrets(docs)).drop("text", "secrets")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return interactions.audit(interactions.document_masks(documents(spark, sf_dir), labels))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f for f in (op1_pack, op2_token_files, op3_passages, op4_top_k, op5_fingerprints, op6_suffixes, op7_line_dedup, op8_language, op9_mix, op10_simhash, op11_secrets, op12_filter_audit, op13_hard_negatives)
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
