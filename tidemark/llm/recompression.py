"""Substring dedup by recompression.

Rounds name runs of equal tokens and then pairs of neighbours. A name is a hash of what it
stands for, so all tasks give equal content equal names without talking to each other. Which
pairs merge depends on the two names alone: each round puts every name on a left or a right side
by a hash bit, and a left name merges with a right name that follows it. So the interior of a
repeated passage is named alike wherever it occurs, and only names near its ends can differ.

For every name the parse tracks the span of tokens that fixed it. A window that contains the
span certifies the name: every occurrence of the window has it. A window's anchor is its
certified name with the least hash. Neighbouring windows with the same anchor are one row, with
a hash of all they cover:

* an anchor name that occurs once has no repeated window;
* rows equal in name and cover are repeats, all windows at once;
* rows with the same name and different covers are border cases: one row of each cover has its
  windows hashed one by one and compared.

Windows that certify no name (periodic ones) are rows of their own.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from tidemark.llm.common import (
    U64, any_columns, as_bytes, fresh, map_texts, mixed, quoted, without,
)
from tidemark.plans.staging import stage_table

#: A name stands for at most so many tokens.
NAME_TOKENS = 8
ROUNDS = 4
#: Rounds that name runs before they name pairs.
RUN_ROUNDS = (0, 2)
#: Names of fewer tokens are anchors only where there is no longer one.
SELECTIVE = 3
NONE = U64(0xFFFFFFFFFFFFFFFF)
BASES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
ROUND_SEEDS = np.arange(1, ROUNDS + 1, dtype=U64) * BASES[1]


# ------------------------------------------------------------------------------------ hashing


class Rolling:
    """Hashes of any span of a token sequence, from prefix sums modulo 2**64."""

    def __init__(self, tokens: np.ndarray, base: np.uint64):
        n = len(tokens)
        inverse = U64(pow(int(base), -1, 1 << 64))
        up = np.cumprod(np.append(U64(1), np.full(n, base)))
        self.down = np.cumprod(np.append(U64(1), np.full(n, inverse)))
        self.prefix = np.append(U64(0), np.cumsum(tokens * up[:n]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]


def _pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * U64(0xFF51AFD7ED558CCD) + mixed(b + U64(0xC4CEB9FE1A85EC53)))


# -------------------------------------------------------------------------------------- parse


class Parse:
    """Names over a sequence of documents: spans ``start..end`` and what fixed them ``lo..hi``."""

    def __init__(self, tokens: np.ndarray, first: np.ndarray, last: np.ndarray):
        """``first`` and ``last`` are the bounds of the document that each token belongs to."""
        n = len(tokens)
        self.name = tokens
        self.start = np.arange(n, dtype=np.int32)
        self.end = self.start + np.int32(1)
        self.lo, self.hi = self.start.copy(), self.end.copy()
        self.loose = np.zeros(n, bool)  # fixed by more than a bounded span
        self.first, self.last = first.astype(np.int32), last.astype(np.int32)
        for r in range(ROUNDS):
            if r in RUN_ROUNDS:
                self._runs()
            self._pairs(r)

    def _keep(self, heads: np.ndarray, name: np.ndarray, end: np.ndarray, lo, hi, loose) -> None:
        head = np.flatnonzero(heads)
        self.name, self.end, self.lo, self.hi = name[head], end[head], lo[head], hi[head]
        self.loose = loose[head]
        self.start, self.first, self.last = self.start[head], self.first[head], self.last[head]

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a name has one before and after it in its document."""
        return self.start > self.first, self.end < self.last

    def _outer(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Spans widened by the neighbour on each side; beyond a document's end no window goes."""
        before, after = self._neighbours()
        lo = np.where(before, np.append(self.lo[:1], self.lo[:-1]), self.first - 1)
        hi = np.where(after, np.append(self.hi[1:], self.hi[-1:]), self.last + 1)
        left = before & np.append(False, self.loose[:-1])
        right = after & np.append(self.loose[1:], False)
        return lo, hi, left, right

    def _runs(self) -> None:
        n = len(self.name)
        if not n:
            return
        before, _ = self._neighbours()
        head = np.ones(n, bool)
        head[1:] = (self.name[1:] != self.name[:-1]) | ~before[1:]
        at = np.flatnonzero(head)
        count = np.diff(np.append(at, n))
        tail = at + count - 1
        lo, hi, left, right = self._outer()
        width = self.end[tail] - self.start[at]
        merge = (count > 1) & (width <= NAME_TOKENS)
        long = np.repeat((count > 1) & ~merge, count)
        # Every name must see its neighbours to know where its run ends.
        run_lo, run_hi = np.repeat(lo[at], count), np.repeat(hi[tail], count)
        loose = np.repeat(left[at] | right[tail] | self.loose[at], count) | long
        merged = np.repeat(merge, count)
        name = np.where(
            merged,
            _pair_names(self.name, np.repeat(count, count).astype(U64) | U64(1 << 62)),
            self.name,
        )
        end = np.where(merged, np.repeat(self.end[tail], count), self.end)
        # In a run too long to merge the spans stay in order; it is loose anyway.
        lo = np.where(long, self.lo, run_lo)
        hi = np.where(long, self.hi, run_hi)
        self._keep(head | ~merged, name, end, lo, hi, loose)

    def _pairs(self, r: int) -> None:
        n = len(self.name)
        if not n:
            return
        right_side = (mixed(self.name + ROUND_SEEDS[r]) >> U64(63)).astype(bool)
        _, after = self._neighbours()
        width = self.end - self.start
        merge = np.zeros(n, bool)
        merge[:-1] = (
            after[:-1] & ~right_side[:-1] & right_side[1:]
            & (width[:-1] + width[1:] <= NAME_TOKENS)
        )
        second = np.append(False, merge[:-1])
        lo, hi, left, right = self._outer()
        # A left name alone depends on the name after it, a right name on the one before.
        new_hi = np.where(merge, np.append(self.hi[1:], self.hi[-1:]), np.where(right_side, self.hi, hi))
        new_lo = np.where(right_side, lo, self.lo)
        loose = self.loose | np.where(merge | ~right_side, right, left)
        following = np.append(self.name[1:], U64(0))
        name = np.where(merge, _pair_names(self.name, following), self.name)
        end = np.where(merge, np.append(self.end[1:], self.end[-1:]), self.end)
        self._keep(~second, name, end, new_lo, new_hi, loose)


def least_in_ranges(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the first least key in each range ``lo..hi``; -1 if empty or all are ``NONE``."""
    out = np.full(len(lo), -1, np.int64)
    size = hi - lo
    some = np.flatnonzero(size > 0)
    if not len(some):
        return out
    level = np.zeros(len(lo), np.int64)
    level[some] = np.floor(np.log2(size[some])).astype(np.int64)
    index = np.arange(len(keys))
    for j in range(int(level[some].max()) + 1):
        use = some[level[some] == j]
        if len(use):
            a, b = index[lo[use]], index[hi[use] - (1 << j)]
            best = np.where(keys[a] <= keys[b], a, b)
            out[use] = np.where(keys[best] == NONE, -1, best)
        half = 1 << j
        if len(index) > half:
            a, b = index[:-half], index[half:]
            index = np.where(keys[a] <= keys[b], a, b)
    return out


def anchors(tokens: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Rows ``document, start, count, name, cover`` for all windows of some documents.

    ``start`` is the first of ``count`` neighbouring windows with one anchor, in tokens of the
    document; ``cover`` is a hash of all they cover and of where the anchor lies in it.
    """
    ends = np.cumsum(lengths)
    begins = ends - lengths
    parse = Parse(tokens, np.repeat(begins, lengths), np.repeat(ends, lengths))
    keys = mixed(parse.name ^ U64(0x2545F4914F6CDD1D)) >> U64(2)
    keys |= (parse.end - parse.start < SELECTIVE).astype(U64) << U64(62)
    keys[parse.loose] = NONE
    # Window starts of all documents.
    count = np.maximum(lengths - window + 1, 0)
    document = np.repeat(np.arange(len(lengths)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begins[document]
    # Both bounds of the spans are in order, so counts take the place of searches.
    size = len(tokens) + 3
    lo = np.cumsum(np.bincount(parse.lo + 1, minlength=size))[at]
    hi = np.cumsum(np.bincount(parse.hi, minlength=size))[at + window]
    anchor = least_in_ranges(keys, lo, hi)
    head = np.ones(len(at), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (anchor[1:] < 0) | (document[1:] != document[:-1])
    rows = np.flatnonzero(head)
    n = np.diff(np.append(rows, len(at)))
    start = at[rows]
    rolling = Rolling(tokens, BASES[0])
    cover = rolling.of(start, start + n - 1 + window)
    own = anchor[rows]
    alone = own < 0
    offset = np.where(alone, 0, parse.start[own] - start)
    cover = mixed(cover + mixed(n.astype(U64) * U64(1 << 32) + offset.astype(U64)))
    name = np.where(alone, mixed(cover ^ BASES[1]), parse.name[own])
    return document[rows], start - begins[document[rows]], n, name, cover


# -------------------------------------------------------------------------------------- Spark


def tokens_of(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of texts, a 64-bit hash of each, and how many each text has."""
    words = [(t or b"").split() for t in texts]
    hashes = b"".join(map(xxhash.xxh3_64_digest, chain.from_iterable(words)))
    return words, np.frombuffer(hashes, U64), np.array([len(w) for w in words], np.int64)


def identity(id_col: str, text_col: str) -> list[Column]:
    """``k, t``: columns without nulls that tell rows of different id or text apart."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    return [
        F.coalesce(quoted(id_col).cast("bigint"), F.xxhash64(text)).alias("k"),
        F.hash(text).alias("t"),
    ]


def anchor_rows(docs: DataFrame, window: int, names_only: bool) -> DataFrame:
    """Anchor rows of ``docs (k, t, text)``; or only their names."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        _, tokens, lengths = tokens_of(as_bytes(batch.column(2)))
        if not (lengths >= window).any():
            return None
        document, start, n, name, cover = anchors(tokens, lengths, window)
        name = pa.array(name.view(np.int64))
        if names_only:
            return pa.record_batch([name], names=["name"])
        rows = pa.array(document)
        return pa.record_batch(
            [
                name, pa.array(cover.view(np.int64)), batch.column(0).take(rows),
                batch.column(1).take(rows), pa.array(start.astype(np.int32)),
                pa.array(n.astype(np.int32)),
            ],
            names=["name", "cover", "k", "t", "start", "n"],
        )

    whole = "name bigint, cover bigint, k bigint, t int, start int, n int"
    return map_texts(docs, "text", run, "name bigint" if names_only else whole)


def packed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The frame with its texts as zstandard frames: what joins move is smaller."""
    names = docs.columns
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        compressor = zstd.ZstdCompressor(level=3)
        frames = [None if t is None else compressor.compress(t) for t in as_bytes(batch.column(at))]
        columns = list(batch.columns)
        columns[at] = pa.array(frames, pa.binary())
        return pa.record_batch(columns, names=names)

    schema = ", ".join(
        f"`{f.name.replace('`', '``')}` "
        + ("binary" if f.name == text_col else f.dataType.simpleString())
        for f in docs.schema
    )
    return map_texts(docs, text_col, run, schema)


def unpacked(frames: list[bytes | None]) -> list[bytes | None]:
    d = zstd.ZstdDecompressor()
    return [None if f is None else d.decompress(f) for f in frames]


def window_rows(docs: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """``h1, h2, k, t, at, many`` for every window of the chosen rows of ``docs (k, t, text)``."""
    wanted = chosen.groupBy("k", "t").agg(
        F.collect_list(F.struct("start", "n", "many")).alias("wanted")
    )
    joined = packed(docs).join(wanted, ["k", "t"]).select("k", "t", "text", "wanted")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, tokens, lengths = tokens_of(unpacked(batch.column(2).to_pylist()))
        begins = np.cumsum(lengths) - lengths
        lists = batch.column(3)
        per = np.diff(lists.offsets.to_numpy())
        each = lists.flatten()
        n = each.field("n").to_numpy().astype(np.int64)
        many = each.field("many").to_numpy(zero_copy_only=False)
        document = np.repeat(np.repeat(np.arange(batch.num_rows), per), n)
        at = np.repeat(each.field("start").to_numpy().astype(np.int64), n)
        at += np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = at + begins[document]
        h1, h2 = (Rolling(tokens, b).of(first, first + window) for b in BASES)
        rows = pa.array(document)
        return pa.record_batch(
            [
                pa.array(mixed(h1).view(np.int64)), pa.array(mixed(h2).view(np.int64)),
                batch.column(0).take(rows), batch.column(1).take(rows),
                pa.array(at.astype(np.int32)), pa.array(np.repeat(many, n)),
            ],
            names=["h1", "h2", "k", "t", "at", "many"],
        )

    return map_texts(
        joined, "text", run, "h1 bigint, h2 bigint, k bigint, t int, at int, many boolean"
    )


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """``k, t, start, n``: ranges of windows of ``docs (k, t, text)`` that occur more than once."""
    names = anchor_rows(docs, window, names_only=True)
    repeated = names.groupBy("name").agg(F.count("*").alias("uses")).where("uses > 1")
    # A frequent name is one row on the right; as that side is a stored table, Spark can split
    # the left one.
    repeated = stage_table(repeated, "repeated-names")
    rows = stage_table(
        anchor_rows(docs, window, names_only=False).join(repeated.select("name"), "name"),
        "anchors",
    )
    covers = stage_table(
        rows.groupBy("name", "cover").agg(
            F.count("*").alias("uses"), F.min(F.struct("k", "t", "start", "n")).alias("one")
        ),
        "covers",
    )
    whole = rows.join(covers.where("uses > 1").select("name", "cover"), ["name", "cover"])
    several = covers.groupBy("name").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = stage_table(several, "border-names")
    border = covers.join(several.select("name"), "name").select(
        "one.*", (F.col("uses") > 1).alias("many")
    )
    windows = stage_table(window_rows(docs, border, window), "windows")
    known = (
        windows.groupBy("h1", "h2")
        .agg(F.count("*").alias("uses"), F.max("many").alias("any_many"))
        .where("uses > 1 OR any_many")
    )
    known = stage_table(known, "repeated-windows")
    single = windows.where("NOT many").join(known.select("h1", "h2"), ["h1", "h2"])
    return (
        whole.select("k", "t", "start", "n")
        .union(single.select("k", "t", F.col("at").alias("start"), F.lit(1).alias("n")))
    )


def covered(starts: np.ndarray, counts: np.ndarray, window: int, length: int) -> np.ndarray:
    """Which of ``length`` tokens lie in a window that starts in one of the ranges."""
    step = np.zeros(length + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + counts - 1 + window, -1)
    return np.cumsum(step[:-1]) > 0


@any_columns
def drop_repeated_passages(
    docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that occurs anywhere else.

    Words are runs of characters other than blanks, compared unchanged; windows lie in one
    document and are judged on the input. The result has the input's columns, with the words
    left, joined by one space, as text, and ``n_words``, ``n_removed`` and ``kept_sha256`` (of
    that text); input columns of these names are replaced.

    Null texts have no words and give an empty text, as do empty ones; texts shorter than the
    window only lose their spacing. A repeated row is an occurrence of its own, so both lose all
    windows. Rows without id are treated like any other. An empty table gives an empty table.
    """
    added = ("n_words", "n_removed", "kept_sha256")
    docs = without(docs, *added)
    k, t, spans = fresh(docs, "k", "t", "spans")
    keys = identity(id_col, text_col)
    source = docs.select(*keys, quoted(text_col).alias("text"))
    ranges = repeated_windows(source, window)
    lists = (
        ranges.distinct().groupBy(F.col("k").alias(k), F.col("t").alias(t))
        .agg(F.collect_list(F.struct("start", "n")).alias(spans))
    )
    named = docs.select("*", *[c.alias(n) for c, n in zip(keys, (k, t), strict=True)])
    joined = packed(named, text_col).join(lists, [k, t], "left")
    joined = joined.select(*[quoted(c) for c in docs.columns], spans)
    names = docs.columns
    text_at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, total, removed, digest = [], [], [], []
        lists = batch.column(len(names))
        texts = unpacked(batch.column(text_at).to_pylist())
        for i, text in enumerate(texts):
            words = (text or b"").split()
            own = lists[i].values
            left = words
            if own is not None and len(own):
                gone = covered(
                    own.field("start").to_numpy().astype(np.int64),
                    own.field("n").to_numpy().astype(np.int64), window, len(words),
                )
                left = [words[j] for j in np.flatnonzero(~gone)]
            kept.append(b" ".join(left))
            total.append(len(words))
            removed.append(len(words) - len(left))
            digest.append(hashlib.sha256(kept[-1]).hexdigest())
        columns = [batch.column(i) for i in range(len(names))]
        columns[text_at] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.record_batch(
            [*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), digest],
            names=[*names, *added],
        )

    schema = docs.schema.add("n_words", LongType()).add("n_removed", LongType())
    return map_texts(joined, text_col, run, schema.add("kept_sha256", StringType()))
