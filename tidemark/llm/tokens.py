"""Token files: id arrays compressed one by one with a shared zstandard dictionary.

A dataset is a folder with ``dictionary.zdict``, ``manifest`` (a parquet table with a row for
each file) and ``files``. A file holds the frames of its documents in ascending order of id::

    magic "TIDEIDS1" | frame ... | index | offset of the index, documents (2 x u64)
    | dictionary hash (u64) | magic

A frame is a document's ids as little-endian unsigned 16-bit integers (32-bit if one of them
needs it), compressed. The index, compressed without dictionary, has for each document: id
(i64), frame offset (u64), ids (u32), bytes of an id (u8; with 128 added if the id is null).

Task attempts write files of different names and the manifest lists those of the attempts that
succeeded, so lost executors and repeated tasks leave no trace in what is read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, id_ranges, partitions, quoted, range_of, slices
from tidemark.llm.encoding import END, encoder

MAGIC = b"TIDEIDS1"
_TRAILER = "<QQQ8s"
_TRAILER_BYTES = struct.calcsize(_TRAILER)
_ENTRY = np.dtype([("id", "<i8"), ("offset", "<u8"), ("n", "<u4"), ("width", "u1")])
_NULL_ID = 128
READ_BYTES = 8 << 20
#: The dictionary is trained on so many documents with the smallest id hashes, and on so many
#: bytes of each of them.
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 16 << 10
DICTIONARY_BYTES = 64 << 10


def _serialized(ids: bytes) -> tuple[bytes, int]:
    x = np.frombuffer(ids, "<u4")
    if len(x) and x.max() > 0xFFFF:
        return ids, 4
    return x.astype("<u2").tobytes(), 2


def train_dictionary(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> bytes:
    """A zstandard dictionary from a bounded sample of serialized id arrays."""
    order = F.xxhash64(quoted(id_col))
    # Ids alone find the sample; only its own texts are moved.
    least = docs.select(order.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    sample = (
        docs.select(quoted(text_col).alias("text"), order.alias("h"))
        .where(F.col("h") <= F.lit(least).cast("bigint"))
        .orderBy("h", F.xxhash64("text"))
        .limit(SAMPLE_DOCS)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                encoded = encoder(tokenizer).encode(as_bytes(part.column(0)), END)
                out = [_serialized(x)[0][:SAMPLE_BYTES] for x in encoded]
                yield pa.record_batch([pa.array(out, pa.binary())], names=["x"])

    samples = sorted(bytes(r[0]) for r in sample.select("text").mapInArrow(run, "x binary").collect())
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        # Too little to train on: the sample itself is the dictionary.
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> zstd.ZstdCompressionDict | None:
    return zstd.ZstdCompressionDict(data) if data else None


def _in_ranges(source: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Add ``part``, the number of a row's file, and how many there are: ranges by id, and after
    them ranges by the start of the text for as large a share of rows as have no id."""
    total, named = source.agg(F.count(F.lit(1)), F.count("id")).first()
    unnamed = -(-n * (total - named) // total) if total else 0
    cuts = id_ranges(source, "id", max(1, n - unnamed))
    part = range_of("id", cuts)
    if not unnamed:
        return source.withColumn("part", part), len(cuts) + 1
    # The first seven bytes as a number sort like the text; a null text is first.
    head = F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 7)), 14, "0")
    placed = source.withColumn("place", F.coalesce(F.conv(head, 16, 10).cast("bigint"), F.lit(-1)))
    more = id_ranges(placed.where("id IS NULL"), "place", unnamed)
    last = F.lit(len(cuts) + 1) + range_of("place", more)
    part = F.when(F.col("id").isNull(), last).otherwise(part)
    return placed.withColumn("part", part), len(cuts) + 2 + len(more)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    level: int = 3,
    files: int | None = None,
) -> None:
    """Encode whole texts, end each with the end id, and write them in ascending order of id.

    Null texts count as empty. Rows of the same id follow each other in order of their text;
    rows without id come last, in order of their text, in files of their own. Other columns are
    not read. An empty table gives a dataset without files.
    """

    n = files or partitions(docs)
    source = docs.select(quoted(id_col).cast("bigint").alias("id"), quoted(text_col).alias("text"))
    dictionary = train_dictionary(source, tokenizer, "id", "text")
    store, root = FileSystem.from_uri(path)
    store.create_dir(f"{root}/files", recursive=True)
    with store.open_output_stream(f"{root}/dictionary.zdict") as out:
        out.write(dictionary)
    parted, parts = _in_ranges(source, n)
    ordered = (
        parted.repartitionById(parts, F.col("part"))
        .sortWithinPartitions(F.col("id").asc_nulls_last(), "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(path)
        shared = _dictionary(dictionary)
        compressor = zstd.ZstdCompressor(level=level, dict_data=shared)
        number = TaskContext.get().partitionId()
        name = f"{number:06d}-{uuid.uuid4().hex}"
        entries: list[np.ndarray] = []
        at, total = len(MAGIC), 0
        out = None
        for batch in batches:
            for part in slices(batch, 1):
                if out is None:
                    out = store.open_output_stream(f"{root}/files/{name}")
                    out.write(MAGIC)
                encoded = encoder(tokenizer).encode(as_bytes(part.column(1)), END)
                index = np.zeros(len(encoded), _ENTRY)
                frames = []
                for i, (key, ids) in enumerate(
                    zip(part.column(0).to_pylist(), encoded, strict=True)
                ):
                    data, width = _serialized(ids)
                    frames.append(compressor.compress(data))
                    index[i] = (key or 0, at, len(ids) // 4, width | (_NULL_ID * (key is None)))
                    at += len(frames[-1])
                out.write(b"".join(frames))
                entries.append(index)
                total += int(index["n"].sum())
        if out is None:
            return
        index = np.concatenate(entries)
        out.write(zstd.ZstdCompressor(level=level).compress(index.tobytes()))
        out.write(struct.pack(_TRAILER, at, len(index), xxhash.xxh64_intdigest(dictionary), MAGIC))
        out.close()
        known = index["id"][index["width"] < _NULL_ID]
        yield pa.record_batch(
            [
                pa.array([number], pa.int32()), pa.array([name]),
                pa.array([len(index)], pa.int64()), pa.array([total], pa.int64()),
                pa.array([int(known[0]) if len(known) else None], pa.int64()),
                pa.array([int(known[-1]) if len(known) else None], pa.int64()),
            ],
            names=["number", "name", "docs", "tokens", "first_id", "last_id"],
        )

    written = ordered.select("id", "text").mapInArrow(
        run,
        "number int, name string, docs bigint, tokens bigint, first_id bigint, last_id bigint",
    )
    written.write.parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "number int, name string, docs bigint, tokens bigint, first_id bigint, last_id bigint"
    ).parquet(f"{path}/manifest")


class TokenFile:
    """One file: its index and random access to its documents."""

    def __init__(self, store: FileSystem, root: str, name: str, dictionary: bytes):
        self.file = store.open_input_file(f"{root}/files/{name}")
        size = self.file.size()
        at, n, known, magic = struct.unpack(
            _TRAILER, self.file.read_at(_TRAILER_BYTES, size - _TRAILER_BYTES)
        )
        if magic != MAGIC or known != xxhash.xxh64_intdigest(dictionary):
            raise ValueError(f"{name}: not a token file of this dictionary")
        index = zstd.ZstdDecompressor().decompress(
            self.file.read_at(size - _TRAILER_BYTES - at, at)
        )
        self.index = np.frombuffer(index, _ENTRY)
        if len(self.index) != n:
            raise ValueError(f"{name}: damaged index")
        self.ends = np.append(self.index["offset"][1:], np.uint64(at)).astype(np.int64)
        self.decompressor = zstd.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def _ids(self, row: int, frame: bytes) -> bytes:
        data = self.decompressor.decompress(frame)
        if self.index["width"][row] % _NULL_ID == 4:
            return data
        return np.frombuffer(data, "<u2").astype("<u4").tobytes()

    def document(self, row: int) -> bytes:
        """Ids of one document; reads only its frame."""
        first = int(self.index["offset"][row])
        return self._ids(row, self.file.read_at(int(self.ends[row]) - first, first))

    def documents(self) -> Iterator[tuple[int, list[bytes]]]:
        """Ids of all documents, a bounded number of bytes at a time."""
        starts = self.index["offset"].astype(np.int64)
        row = 0
        while row < len(starts):
            base = int(starts[row])
            last = max(row + 1, int(np.searchsorted(self.ends, base + READ_BYTES, side="right")))
            block = self.file.read_at(int(self.ends[last - 1]) - base, base)
            yield row, [
                self._ids(i, block[int(starts[i]) - base : int(self.ends[i]) - base])
                for i in range(row, last)
            ]
            row = last


def _load_dictionary(store: FileSystem, root: str) -> bytes:
    with store.open_input_stream(f"{root}/dictionary.zdict") as f:
        return f.read()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents; ``start`` counts the ids before them."""
    # One row for each file.
    earlier = W.orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    listed = _manifest(spark, path).withColumn(
        "start", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))
    )
    files = listed.select("name", "start").repartition(partitions(listed), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(path)
        dictionary = None
        for batch in batches:
            for name, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                dictionary = _load_dictionary(store, root) if dictionary is None else dictionary
                file = TokenFile(store, root, name, dictionary)
                for row, ids in file.documents():
                    part = file.index[row : row + len(ids)]
                    n = part["n"].astype(np.int64)
                    yield pa.record_batch(
                        [
                            pa.array(part["id"].copy(), mask=part["width"] >= _NULL_ID),
                            pa.array(start + np.cumsum(n) - n),
                            pa.array(n),
                            pa.array(ids, pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    start += int(n.sum())

    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Ids of the documents with an id (one, if ids are unique), from their frames alone."""
    near = _manifest(spark, path).where(
        (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)
    )
    store, root = FileSystem.from_uri(path)
    dictionary = _load_dictionary(store, root)
    out = []
    for r in near.orderBy("number").select("name").collect():
        file = TokenFile(store, root, r[0], dictionary)
        known = file.index["width"] < _NULL_ID
        for row in np.flatnonzero((file.index["id"] == doc_id) & known):
            out.append(np.frombuffer(file.document(int(row)), "<u4"))
    return out
