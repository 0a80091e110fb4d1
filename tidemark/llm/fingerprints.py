"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text is cut at line feeds and, by a rule on the last eight bytes, after one byte in 64 or so,
whatever the bytes are, so that a long line is several paragraphs with or without spaces and a cut
depends on nothing further away. Each paragraph's digest is added to three cells of a sketch, whose
size follows the number of paragraphs and grows until all of them can be recovered from it.

Likeness needs the two fingerprints alone. They are folded to a common size and subtracted, and
peeling cells of one digest recovers those that differ. Where that fails, the digests recovered
from each fingerprint fill larger sketches, which are subtracted and peeled in turn.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, fresh, id_ranges, mixed, partitions, quoted, range_of, slices

PAIR_BYTES = 2 << 20
CHECK = U64(0x5851F42D4C957F2D)
#: A cut follows eight bytes whose hash has so many leading zero bits.
CUT_BITS = 6
CUT_FACTOR = U64(0x9E3779B97F4A7C15)
CELL_SEEDS = np.arange(1, 4, dtype=U64) * U64(0xD1342543DE82EF95)
#: Cells for each paragraph and for each sketch, at first.
ROOM = 1.4
LEAST = 6
#: A cell as it is stored; counts are kept modulo 256, which peeling allows.
CELL = np.dtype([("n", "i1"), ("key", "<u8"), ("check", "<u8")])


def paragraph_digests(text: bytes) -> np.ndarray:
    """Sorted digests of a text's paragraphs; the n-th copy of one has a digest of its own."""
    if not text:
        return np.zeros(0, U64)
    b = np.frombuffer(text, np.uint8)
    # The last eight bytes as one number; the first seven places have no cut but a line feed.
    cut = np.zeros(len(b), bool)
    if len(b) > 7:
        last = b.astype(U64)
        for n in (1, 2, 4):
            last = last[:-n] | last[n:] << U64(8 * n)
        last = (last ^ (last >> U64(32))) * CUT_FACTOR
        cut[7:] = last >> U64(64 - CUT_BITS) == 0
    ends = np.flatnonzero(cut | (b == 10)) + 1
    digest = xxhash.xxh3_64_intdigest
    edges = [0, *ends.tolist(), len(text)]
    h = np.array([digest(text[x:y]) for x, y in zip(edges, edges[1:], strict=False) if y > x], U64)
    h.sort()
    new = np.append(True, h[1:] != h[:-1])
    copy = np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return np.where(copy > 0, mixed(h + copy.astype(U64) * CHECK), h)


def _larger(third: int) -> int:
    """The next of the sizes 2, 3, 4, 6, 8, 12, ..., any two of which have a common divisor that
    is not much less than the smaller one."""
    return third * 3 // 2 if third & (third - 1) == 0 else third * 4 // 3


def _roomy(paragraphs: int) -> int:
    """Cells in a third of a sketch that most likely can be peeled."""
    third = 2
    while 3 * third < ROOM * paragraphs + LEAST:
        third = _larger(third)
    return third


class Sketches:
    """Sketches of several documents side by side; ``thirds`` are a third of their cells each."""

    def __init__(self, thirds: np.ndarray):
        self.thirds = np.asarray(thirds, np.int64)
        ends = np.cumsum(3 * self.thirds)
        self.first = ends - 3 * self.thirds
        cells = int(ends[-1]) if len(ends) else 0
        self.count = np.zeros(cells, np.int8)
        self.keys = np.zeros(cells, U64)
        self.checks = np.zeros(cells, U64)

    def add(self, which: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Add digests, or take them back; returns the cells that changed, three of each."""
        checks, wrap = mixed(keys ^ CHECK), sign.astype(U64)  # -1 subtracts modulo 2**64
        third, first = self.thirds[which], self.first[which]
        cells = []
        for j in range(3):
            cell = mixed(keys + CELL_SEEDS[j]) % third.astype(U64)
            cells.append(first + j * third + cell.astype(np.int64))
            np.add.at(self.count, cells[j], sign.astype(np.int8))
            np.add.at(self.keys, cells[j], keys * wrap)
            np.add.at(self.checks, cells[j], checks * wrap)
        return np.concatenate(cells)

    def minus(self, left: np.ndarray, right: np.ndarray) -> Sketches:
        """Differences of pairs of sketches, each pair folded to its common size."""
        out = Sketches(np.gcd(self.thirds[left], self.thirds[right]))
        for side, put in ((left, np.add), (right, np.subtract)):
            size = 3 * self.thirds[side]
            pair = np.repeat(np.arange(len(side)), size)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            cell = self.first[side][pair] + place
            third, fold = self.thirds[side][pair], out.thirds[pair]
            at = out.first[pair] + place // third * fold + place % third % fold
            put.at(out.count, at, self.count[cell])
            put.at(out.keys, at, self.keys[cell])
            put.at(out.checks, at, self.checks[cell])
        return out

    def peeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests recovered, the sketch of each, and which sketches were recovered whole.

        Empties the sketches.
        """
        owner = np.repeat(np.arange(len(self.thirds)), 3 * self.thirds)
        found, of = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        look = np.arange(len(owner))
        for _ in range(len(owner) + 1):
            look = look[np.abs(self.count[look]) == 1]
            sign = self.count[look].astype(np.int64)
            keys = self.keys[look] * sign.astype(U64)
            pure = mixed(keys ^ CHECK) * sign.astype(U64) == self.checks[look]
            which, sign, keys = owner[look[pure]], sign[pure], keys[pure]
            if not len(keys):
                break
            _, once = np.unique(keys ^ mixed(which.astype(U64)), return_index=True)
            which, sign, keys = which[once], sign[once], keys[once]
            look = np.unique(self.add(which, keys, -sign))
            found.append(keys)
            of.append(which)
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        whole = np.bincount(owner[left], minlength=len(self.thirds)) == 0
        return np.concatenate(found), np.concatenate(of), whole


def _filled(thirds: np.ndarray, digests: list[np.ndarray]) -> Sketches:
    s = Sketches(thirds)
    sizes = [len(x) for x in digests]
    keys = np.concatenate([np.zeros(0, U64), *digests])
    s.add(np.repeat(np.arange(len(sizes)), sizes), keys, np.ones(len(keys), np.int64))
    return s


def fingerprints(digests: list[np.ndarray]) -> list[str]:
    """Each text's number of paragraphs and its sketch, large enough to recover all of them."""
    out = [""] * len(digests)
    thirds = np.array([_roomy(len(x)) for x in digests], np.int64)
    todo = np.arange(len(digests))
    while len(todo):
        s = _filled(thirds[todo], [digests[i] for i in todo])
        table = np.zeros(len(s.count), CELL)
        table["n"], table["key"], table["check"] = s.count, s.keys, s.checks
        *_, whole = s.peeled()
        for i, first, third in zip(
            todo[whole], s.first[whole].tolist(), s.thirds[whole].tolist(), strict=True
        ):
            cells = table[first : first + 3 * third].tobytes()
            out[i] = f"{len(digests[i]):x}." + base64.b64encode(cells).decode()
        todo = todo[~whole]
        thirds[todo] = [_larger(t) for t in thirds[todo].tolist()]
    return out


def _parsed(prints: list[str]) -> tuple[np.ndarray, Sketches]:
    sizes, cells = [], []
    for x in prints:
        size, _, data = x.partition(".")
        sizes.append(int(size, 16))
        cells.append(np.frombuffer(base64.b64decode(data), CELL))
    s = Sketches(np.array([len(x) // 3 for x in cells], np.int64))
    if cells:
        table = np.concatenate(cells)
        s.count, s.keys, s.checks = (np.ascontiguousarray(table[c]) for c in CELL.names)
    return np.array(sizes, np.int64), s


def likenesses(prints: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Likeness of pairs of fingerprints, named by their places in the list.

    Share of the paragraphs of both texts that both have (0 to 1), a repeated paragraph as often
    as both repeat it; 1 for two texts without paragraphs.
    """
    left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
    sizes, sketches = _parsed(prints)
    _, of, whole = sketches.minus(left, right).peeled()
    differ = np.bincount(of, minlength=len(left))
    todo = np.flatnonzero(~whole)
    if len(todo):
        keys, of, whole = sketches.peeled()
        if not whole.all():
            raise ValueError("not a fingerprint: its paragraphs cannot be recovered")
        digests = np.split(keys[np.argsort(of, kind="stable")], np.cumsum(sizes)[:-1])
        thirds = np.array([_roomy(n) for n in sizes[left[todo]] + sizes[right[todo]]], np.int64)
    while len(todo):
        n = len(todo)
        both = _filled(
            np.append(thirds, thirds), [digests[i] for i in (*left[todo], *right[todo])]
        )
        _, of, whole = both.minus(np.arange(n), np.arange(n, 2 * n)).peeled()
        differ[todo[whole]] = np.bincount(of, minlength=n)[whole]
        todo, thirds = todo[~whole], np.array([_larger(t) for t in thirds[~whole]], np.int64)
    total = sizes[left] + sizes[right]
    return np.where(total > 0, (total - differ) / np.maximum(total, 1), 1.0)


def likeness(fingerprint: str, other: str) -> float:
    """Likeness of two texts from their fingerprints; see :func:`likenesses`."""
    return float(likenesses([fingerprint, other], [0], [1])[0])


def edited(text: str, other: str) -> str:
    """The last half of a text replaced by the first code points of another."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """``(id, text, next text)`` of sorted rows, some at a time; copies only close the last pair."""
    first = last = None
    lot: list[tuple] = []
    held, closed = 0, False
    for batch in batches:
        for part in slices(batch, 1):
            for key, text, copy in zip(*[c.to_pylist() for c in part.columns[:3]], strict=True):
                text = text or ""
                if closed:
                    continue
                if last is not None:
                    lot.append((*last, text))
                    held += len(text)
                if first is None:
                    first = text
                last, closed = (key, text), bool(copy)
                if held > PAIR_BYTES:
                    yield lot
                    lot, held = [], 0
    if last is not None and not closed:
        lot.append((*last, first))
    if lot:
        yield lot


def edit_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text is :func:`edited` with the next document in descending order of id; after
    the last comes the first. Returns ``id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``; the last two are the :func:`likeness` of the
    fingerprint to the edited text's and to the next document's. Null texts count as empty; two texts without
    paragraphs have likeness 1. Rows of the same id are ordered by text. Rows without id come
    last, by a hash of the text and then the text, in ranges of their own. A single row is its
    own next. An empty table gives no rows; other columns are not read.
    """
    source = docs.select(
        quoted(id_col).cast("bigint").alias("id"), quoted(text_col).alias("text")
    )
    part, target, place, key, none = fresh(source, "part", "target", "place", "key", "none")
    # A row's key is its id or, without one, a hash of its text.
    source = source.withColumn(none, F.col("id").isNull()).withColumn(
        key, F.coalesce("id", F.xxhash64("text"))
    )
    cuts = id_ranges(source.where(~F.col(none)), key, partitions(source))
    late = id_ranges(source.where(none), key, partitions(source))
    ranges = len(cuts) + 1
    placed = source.withColumn(
        part,
        F.when(F.col(none), F.lit(ranges) + range_of(key, late)).otherwise(
            F.lit(ranges - 1) - range_of(key, cuts)
        ),
    )
    ranges += len(late) + 1
    # The first row of each range is copied to the end of the range before: a row a partition.
    first = F.when(F.col(none), F.min(key)).otherwise(F.max(key))
    heads = placed.groupBy(part, none).agg(first.alias(key)).collect()
    heads = sorted(tuple(r) for r in heads)
    before = [(*h[1:], heads[i - 1][0]) for i, h in enumerate(heads)]
    copies = source.sparkSession.createDataFrame(
        before, f"{none} boolean, {key} bigint, {target} int"
    )
    spots = F.array(F.struct(F.col(part).alias("p"), F.lit(False).alias("copy")))
    extra = F.array(F.struct(F.col(target).alias("p"), F.lit(True).alias("copy")))
    dealt = (
        placed.join(F.broadcast(copies), [none, key], "left")
        .withColumn(
            place,
            F.explode(F.when(F.col(target).isNull(), spots).otherwise(F.concat(spots, extra))),
        )
        .select(
            "id", "text", F.when(F.col(none), F.col(key)).alias("hash"),
            F.col(f"{place}.copy").alias("copy"), F.col(f"{place}.p").alias("p"),
        )
        .repartitionById(ranges, F.col("p"))
        .sortWithinPartitions("copy", F.col("id").desc_nulls_last(), "hash", "text")
        .select("id", "text", "copy")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _pairs(batches):
            n = len(lot)
            changed = [edited(text, other).encode() for _, text, other in lot]
            texts = [*[text.encode() for _, text, _ in lot], lot[-1][2].encode(), *changed]
            prints = fingerprints([paragraph_digests(x) for x in texts])
            own = np.arange(n)
            near = likenesses(prints, np.append(own, own), np.append(own + n + 1, own + 1))
            yield pa.record_batch(
                [
                    pa.array([x[0] for x in lot], pa.int64()),
                    pa.array([len(x[1]) for x in lot], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in changed]),
                    pa.array(prints[:n]),
                    pa.array(prints[n + 1 :]),
                    pa.array(near[:n]),
                    pa.array(near[n:]),
                ],
                names=[
                    "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                    "near_edited", "near_next",
                ],
            )

    return dealt.mapInArrow(
        run,
        "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
