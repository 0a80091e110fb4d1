"""Reading delivered files and stored tables."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.utils import AnalysisException

from tidemark.functions import numeric as N
from tidemark.params import CSV_HEADERS
from tidemark.plans.series import METER
from tidemark.plans.staging import stage_table

NUMBER_COLUMNS = ("supply_m3", "return_m3", "gvs_m3", "xvs_m3", "t1", "t2", "weather")

# Spark reads single-byte files as Latin-1, which maps every byte to the character of that number.
# Translating those characters gives the Cyrillic code page.
_HIGH_BYTES = bytes(b for b in range(128, 256) if b != 0x98)  # 0x98 is unassigned
LATIN1_CHARS = _HIGH_BYTES.decode("latin-1")
CP1251_CHARS = _HIGH_BYTES.decode("cp1251")


#: Files with more different headers than this are not one delivery.
MOST_LAYOUTS = 64


def _cyrillic(raw: Column) -> Column:
    """Text of bytes in the Cyrillic code page."""
    return F.translate(F.decode(raw, "ISO-8859-1"), LATIN1_CHARS, CP1251_CHARS)


def _files(lines: DataFrame, encoding: str | None) -> DataFrame:
    """``file, cyrillic, head``: one row per file, from all of its lines; its first as bytes."""
    utf8 = F.bool_and(F.is_valid_utf8("value"))
    return lines.groupBy("file").agg(
        (~utf8 if encoding is None else F.lit(encoding == "cp1251")).alias("cyrillic"),
        # Only the part of a file that starts at 0 has its header; ids ascend inside it.
        F.min_by("raw", F.when(F.col("block") == 0, F.col("id"))).alias("head"),
    )


def delivered_lines(
    spark: SparkSession, path: str, *, sep: str = ",", encoding: str | None = None
) -> DataFrame:
    """All lines of delivered files: ``file, line, problem`` and the fields as texts.

    Without an explicit ``encoding`` (UTF-8 or cp1251) each file's own bytes decide, all of them:
    a file that is not UTF-8 throughout is in the Cyrillic single-byte code page. Each file has a
    header, and files may have different ones; known headers get their short names, others keep
    theirs, and fields that a file lacks are NULL. Blank lines and repetitions of the header are
    skipped. A line is one record;
    ``problem`` says why it is none: ``fields`` if it does not have the header's fields,
    ``encoding`` if a byte has no meaning in the code page.

    Files are split like any text; per file one row is aggregated, and the driver sees the
    different headers only.
    """
    if encoding is not None:
        encoding = encoding.lower().replace("windows-", "cp")
        if encoding not in ("utf-8", "utf8", "cp1251"):
            raise ValueError(f"unknown encoding {encoding!r}")
    lines = spark.read.text(path).select(
        "value",
        F.col("value").cast("binary").alias("raw"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    files = _files(lines, encoding).select(
        "file",
        "cyrillic",
        "head",
        F.when(F.col("cyrillic"), _cyrillic(F.col("head")))
        .otherwise(F.col("head").cast("string"))
        .alias("header"),
    )
    files = stage_table(files, "delivered-files")
    headers = files.select("header").distinct().limit(MOST_LAYOUTS + 1).collect()
    headers = sorted(r[0] for r in headers if r[0] is not None)
    if len(headers) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} different headers below {path}")
    layouts = [_fields(h, sep) for h in headers]
    names = list(dict.fromkeys(n for own in layouts for n in own))
    text = F.when(F.col("cyrillic"), _cyrillic(F.col("raw"))).otherwise(F.col("value"))
    bodies = (
        lines.join(files, "file")
        .where((F.col("raw") != F.col("head")) & (F.trim("value") != ""))
        .select("file", text.alias("line"), "cyrillic", "header")
    )
    record = F.lit(None).cast(_struct(names))
    for header, own in zip(headers, layouts):
        record = F.when(F.col("header") == header, _record(own, names, sep)).otherwise(record)
    unknown = F.col("cyrillic") & F.contains("line", F.lit("\x98"))
    problem = F.when(unknown, "encoding").when(F.col("r._bad").isNotNull(), "fields")
    return bodies.withColumn("r", record).select(
        "file", "line", problem.alias("problem"), *[F.col(f"r.`{n}`").alias(n) for n in names]
    )


def _fields(header: str, sep: str) -> list[str]:
    found = [n.strip() for n in next(csv.reader([header.lstrip("\ufeff")], delimiter=sep))]
    return [CSV_HEADERS.get(n, n) for n in found]


def _struct(names: list[str]) -> t.StructType:
    return t.StructType([t.StructField(n, t.StringType()) for n in (*names, "_bad")])


def _record(own: list[str], names: list[str], sep: str) -> Column:
    """A line with the fields ``own`` as a struct of all ``names`` and ``_bad``."""
    schema = ", ".join(f"`{n}` STRING" for n in (*own, "_bad"))
    parsed = F.from_csv(
        F.col("line"), schema, {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    missing = F.lit(None).cast("string")
    # The lambda's argument is parsed once, however many fields are taken from it.
    picked = F.transform(
        F.array(parsed),
        lambda r: F.struct(
            *[(r[n] if n in own else missing).alias(n) for n in names], r["_bad"].alias("_bad")
        ),
    )
    return F.get(picked, F.lit(0))


def _typed(lines: DataFrame) -> DataFrame:
    columns = []
    for c in lines.columns:
        value = F.col(f"`{c}`")
        if c in NUMBER_COLUMNS:
            value = N.parse_number(value)
        elif c in (METER, "weekday"):
            value = value.try_cast("bigint" if c == METER else "int")
        columns.append(value.alias(c))
    return lines.select(*columns)


def read_readings_csv(
    spark: SparkSession, path: str, *, sep: str = ",", encoding: str | None = None
) -> DataFrame:
    """Delivered readings as text dates and hours with numeric channels.

    Lines are those of :func:`delivered_lines` without a problem.
    """
    lines = delivered_lines(spark, path, sep=sep, encoding=encoding)
    return _typed(lines.where("problem IS NULL").drop("file", "line", "problem"))


def rejected_lines(
    spark: SparkSession, path: str, *, sep: str = ",", encoding: str | None = None
) -> DataFrame:
    """``file, line, problem`` of the delivered lines that are no readings."""
    lines = delivered_lines(spark, path, sep=sep, encoding=encoding)
    return lines.where("problem IS NOT NULL").select("file", "line", "problem")


def read_processed(spark: SparkSession, path: str, schema: t.StructType | None = None) -> DataFrame:
    """A stored hourly table; ``ts`` kept as text elsewhere is parsed, bad values become NULL."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return parse_ts(reader.parquet(path))


def parse_ts(table: DataFrame) -> DataFrame:
    """Times kept as text become times; bad ones become NULL."""
    if dict(table.dtypes)["ts"] == "string":
        table = table.withColumn("ts", F.col("ts").try_cast("timestamp_ntz"))
    return table


def read_optional(spark: SparkSession, path: str, schema: t.StructType) -> DataFrame:
    """A table that may not have been written yet; then an empty frame of the same schema."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
