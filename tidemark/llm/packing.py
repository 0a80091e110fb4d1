"""Vector bin packing of examples into training sequences.

Each example demands tokens, one segment and loss-bearing tokens; each sequence has a limit on
all three. A task keeps a bounded pool of examples and fills one sequence at a time with the
example whose demand has the largest dot product with what the sequence has left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.common import as_bytes, quoted, slices
from tidemark.llm.encoding import END, encoder

#: Sequences of a task are numbered from the task's partition id times this.
TASK_SEQUENCES = 1 << 33
ROWS = 2048


@dataclass(frozen=True)
class Limits:
    """Per sequence; ``pool`` is how many examples a task chooses from.

    The pool grows while its examples could not fill a sequence. By default the segments are no
    limit of their own, as a segment has at least one token.
    """

    tokens: int = 2048
    segments: int = 2048
    loss: int = 2048
    pool: int = 512


@dataclass
class Item:
    """The rest of an example: ids from ``start`` on."""

    key: object
    ids: np.ndarray
    loss: np.ndarray | None
    start: int


@dataclass
class Piece:
    key: object
    start: int
    ids: np.ndarray
    total: int
    sequence: int
    offset: int
    mask: np.ndarray | None

    @property
    def loss_tokens(self) -> int:
        return len(self.ids) if self.mask is None else int(self.mask.sum())


class Packer:
    """Fills sequences from a pool of examples. Every id ends up in exactly one piece."""

    def __init__(self, limits: Limits, first: int = 0):
        self.limits = limits
        self.sequence = first
        n = limits.pool
        self.items: list[Item | None] = [None] * n
        self.free = list(range(n - 1, -1, -1))
        self.tokens = np.zeros(n, np.int64)
        self.loss = np.zeros(n, np.int64)
        self.full = np.array([limits.tokens, max(1, limits.loss)], np.float64)

    def add(self, key: object, ids: np.ndarray, loss: np.ndarray | None) -> Iterator[Piece]:
        item = Item(key, ids, loss, 0)
        while len(ids) - item.start >= self.limits.tokens:
            n = self._prefix(item, self.limits.tokens, self.limits.loss)
            if n < self.limits.tokens:
                break
            yield self._piece(item, n, 0)
            self.sequence += 1
        if item.start < len(ids):
            while not self.free:
                if self._short():
                    self._grow()
                else:
                    yield from self._close(self._fill())
            self._put(item)

    def _short(self) -> bool:
        """Whether a sequence could take the whole pool and more."""
        return (
            len(self.items) < self.limits.segments
            and self.tokens.sum() < self.limits.tokens
            and self.loss.sum() < self.limits.loss
        )

    def _grow(self) -> None:
        n = len(self.items)
        self.items += [None] * n
        self.free += range(2 * n - 1, n - 1, -1)
        self.tokens = np.append(self.tokens, np.zeros(n, np.int64))
        self.loss = np.append(self.loss, np.zeros(n, np.int64))

    def finish(self) -> Iterator[Piece]:
        while len(self.free) < len(self.items):
            pieces = self._fill()
            last = len(self.free) == len(self.items)
            yield from (self._halved(pieces) if last else self._close(pieces))

    def _prefix(self, item: Item, tokens: int, loss: int) -> int:
        """Most ids from the start of an item that fit."""
        n = min(tokens, len(item.ids) - item.start)
        if item.loss is None:
            return min(n, loss)
        bearing = np.cumsum(item.loss[item.start : item.start + n])
        return int(np.searchsorted(bearing, loss, side="right"))

    def _demand(self, item: Item, n: int) -> int:
        if item.loss is None:
            return n
        return int(item.loss[item.start : item.start + n].sum())

    def _put(self, item: Item) -> None:
        """Into the pool, with the demand of what one sequence could hold of it."""
        slot = self.free.pop()
        n = self._prefix(item, self.limits.tokens, self.limits.loss)
        self.items[slot] = item
        whole = n == len(item.ids) - item.start
        self.tokens[slot] = n if whole else self.limits.tokens + 1
        self.loss[slot] = self._demand(item, n)

    def _take(self, slot: int) -> Item:
        item = self.items[slot]
        self.items[slot] = None
        self.free.append(slot)
        self.tokens[slot] = self.loss[slot] = 0
        return item

    def _piece(self, item: Item, n: int, offset: int) -> Piece:
        span = slice(item.start, item.start + n)
        mask = None if item.loss is None else item.loss[span]
        piece = Piece(
            item.key, item.start, item.ids[span], len(item.ids), self.sequence, offset, mask
        )
        item.start += n
        return piece

    def _fill(self) -> list[Piece]:
        left = np.array([self.limits.tokens, self.limits.loss], np.int64)
        pieces: list[Piece] = []
        offset = 0
        while left[0] > 0 and len(pieces) < self.limits.segments:
            weight = left / (self.full * self.full)
            # Every example demands one segment, so that term does not change the order.
            score = self.tokens * weight[0] + self.loss * weight[1]
            fits = (self.tokens > 0) & (self.tokens <= left[0]) & (self.loss <= left[1])
            if fits.any():
                slot = int(np.argmax(np.where(fits, score, -1.0)))
                item = self._take(slot)
                n = len(item.ids) - item.start
            else:
                # None fits as a whole: cut the best of those that can fill the gap.
                slot, n = self._cut(score, left)
                if not n:
                    break
                item = self._take(slot)
            piece = self._piece(item, n, offset)
            if item.start < len(item.ids):
                self._put(item)
            left -= (n, piece.loss_tokens)
            offset += n
            pieces.append(piece)
        return pieces

    def _cut(self, score: np.ndarray, left: np.ndarray) -> tuple[int, int]:
        for slot in np.argsort(-score, kind="stable"):
            if self.tokens[slot] > 0:
                n = self._prefix(self.items[slot], int(left[0]), int(left[1]))
                if n:
                    return int(slot), n
        return 0, 0

    def _close(self, pieces: list[Piece]) -> Iterator[Piece]:
        if not pieces:
            raise ValueError("an example fits into no sequence")
        yield from pieces
        self.sequence += 1

    def _halved(self, pieces: list[Piece]) -> Iterator[Piece]:
        """A task's last sequence, cut into sequences whose lengths are powers of two."""
        total = sum(len(p.ids) for p in pieces)
        if not pieces or total & (total - 1) == 0:
            yield from self._close(pieces)
            return
        room, offset = 1 << (total.bit_length() - 1), 0
        for p in pieces:
            done = 0
            while done < len(p.ids):
                n = min(room - offset, len(p.ids) - done)
                span = slice(done, done + n)
                mask = None if p.mask is None else p.mask[span]
                yield Piece(
                    p.key, p.start + done, p.ids[span], p.total, self.sequence, offset, mask
                )
                done += n
                offset += n
                if offset == room:
                    total -= room
                    self.sequence += 1
                    offset = 0
                    room = 1 << (total.bit_length() - 1) if total else 0


def _packed(df: DataFrame, key_type: str, limits: Limits, examples) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, TaskContext.get().partitionId() * TASK_SEQUENCES)
        rows: list[Piece] = []
        key_kind = pa.int64()

        def pieces() -> Iterator[Piece]:
            nonlocal key_kind
            for batch in batches:
                key_kind = batch.column(0).type
                for part in slices(batch, 1):
                    for example in examples(part):
                        yield from packer.add(*example)
            yield from packer.finish()

        def out() -> pa.RecordBatch:
            columns = [
                pa.array([p.key for p in rows], key_kind),
                *[
                    pa.array([f(p) for p in rows], pa.int64())
                    for f in (
                        lambda p: p.start, lambda p: len(p.ids), lambda p: p.total,
                        lambda p: p.sequence, lambda p: p.offset, lambda p: p.loss_tokens,
                    )
                ],
                pa.array([p.ids.tobytes() for p in rows], pa.binary()),
            ]
            names = ["key", "start", "length", "tokens", "sequence_id", "offset", "loss", "ids"]
            rows.clear()
            return pa.record_batch(columns, names=names)

        for piece in pieces():
            rows.append(piece)
            if len(rows) == ROWS:
                yield out()
        if rows:
            yield out()

    return df.mapInArrow(
        run,
        f"key {key_type}, start bigint, length bigint, tokens bigint, sequence_id bigint, "
        "offset bigint, loss bigint, ids binary",
    )


def pack(
    examples: DataFrame, key: str, ids: str, loss: str | None = None, limits: Limits = Limits()
) -> DataFrame:
    """Pack encoded examples: ``ids`` binary of unsigned 32-bit ids, ``loss`` one byte a token.

    A byte of 1 marks a token that bears loss; without the column, or where it is null, all do.
    Returns pieces: ``key, start, length, tokens`` (of the example), ``sequence_id, offset``
    (without gaps from 0), ``loss`` (loss-bearing tokens) and ``ids``. An example is cut only if
    it exceeds a limit or to fill a sequence that no whole example fits. Each task packs what it
    reads with a pool of ``limits.pool`` examples; its last sequence is cut into sequences whose
    lengths are powers of two, which need no padding.

    Examples without ids (null or empty) give no piece; null keys and repeated rows are examples
    like any other. An empty table gives no rows. Sequence ids follow the partitions read.
    """
    if limits.tokens < 1 or limits.segments < 1 or limits.loss < 1:
        raise ValueError("limits must be positive")
    columns = [quoted(key).alias("key"), quoted(ids).alias("ids")]
    columns += [quoted(loss).alias("loss")] if loss else []
    source = examples.select(*columns)

    def of(batch: pa.RecordBatch):
        keys, all_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        masks = batch.column(2).to_pylist() if loss else [None] * len(keys)
        for k, x, m in zip(keys, all_ids, masks, strict=True):
            yield k, np.frombuffer(x or b"", "<u4"), None if m is None else np.frombuffer(m, "u1")

    return _packed(source, source.schema["key"].dataType.simpleString(), limits, of)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode whole texts, end each with the end id, and pack them; all tokens bear loss.

    Columns as of :func:`pack`. A null text counts as empty: one piece with the end id. Other
    columns of the input are not read.
    """
    source = docs.select(quoted(id_col).alias("key"), quoted(text_col).alias("text"))

    def of(batch: pa.RecordBatch):
        encoded = encoder(tokenizer).encode(as_bytes(batch.column(1)), END)
        for k, x in zip(batch.column(0).to_pylist(), encoded, strict=True):
            yield k, np.frombuffer(x, "<u4"), None

    return _packed(source, source.schema["key"].dataType.simpleString(), limits, of)
