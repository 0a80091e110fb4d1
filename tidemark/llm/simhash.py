"""SimHash near-dedup with generalised pigeonhole partitions.

Fingerprints of 64 bits are cut into partitions of correlated bits. Two fingerprints within
``d`` bits agree, in at least one of ``m`` partitions, to within that partition's threshold,
whenever the thresholds add up to ``d - m + 1`` (a threshold of -1 skips its partition). Each
distinct fingerprint gets the thresholds with the fewest estimated candidates, by dynamic
programming over histograms of the partitions' values, and probes an index of these values.
Every candidate is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import (
    U64, any_columns, as_bytes, fresh, map_texts, mixed, partitions, quoted,
)
from tidemark.llm.graph import connected_components
from tidemark.plans.staging import stage_table

SEED = 42
BITS = 64
#: Values of a partition are counted in so many classes; the histograms have a fixed size.
HISTOGRAM_BITS = 16
#: An index cell holds about so many fingerprints; larger buckets become grids of cells.
CELL = 2048
#: Cells with at most so many pairs are compared by listing their pairs.
LISTED = 1024


# ------------------------------------------------------------------------------ fingerprints


def fingerprints_of(texts: list[bytes | None], words: int) -> np.ndarray:
    """Fingerprints of texts, as unsigned 64-bit integers."""
    out = np.zeros(len(texts), U64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        tokens = (text or b"").lower().split()
        if not tokens:
            continue
        joined = b" ".join(tokens)
        if len(tokens) <= words:
            out[i] = digest(joined, SEED)
            continue
        starts = np.zeros(len(tokens) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in tokens], out=starts[1:])
        first = starts[: len(tokens) - words + 1].tolist()
        last = (starts[words:] - 1).tolist()
        h = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)),
            U64, len(first),
        )
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(h), 1 << 16):
            block = h[at : at + (1 << 16)].view(np.uint8)
            ones += np.unpackbits(block, bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
        set_bits = np.flatnonzero(2 * ones > len(h)).astype(U64)
        out[i] = np.bitwise_or.reduce(U64(1) << set_bits) if len(set_bits) else 0
    return out


def text_tie(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(quoted(text_col), F.lit("")))


def with_fingerprints(
    docs: DataFrame, words: int, id_col: str, text_col: str
) -> DataFrame:
    """``id, tie, fp``: the fingerprint of every row, and a hash of its text to order ties."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprints_of(as_bytes(batch.column(2)), words).view(np.int64)
        return pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(fp)], names=["id", "tie", "fp"]
        )

    source = docs.select(
        quoted(id_col).alias("id"), text_tie(text_col).alias("tie"), quoted(text_col).alias("text")
    )
    kind = source.schema["id"].dataType.simpleString()
    return map_texts(source, "text", run, f"id {kind}, tie bigint, fp bigint")


# ---------------------------------------------------------------- partitions and thresholds


def correlated_partitions(counts: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Cut 64 bits into ``m`` partitions; each grows by the bit most correlated with it.

    ``counts[i, j]`` is how many of ``n`` fingerprints have both bits.
    """
    p = counts / max(n, 1)
    own = np.diag(p)
    spread = np.sqrt(np.maximum(own * (1 - own), 1e-12))
    r = np.abs(p - np.outer(own, own)) / np.outer(spread, spread)
    np.fill_diagonal(r, 0)
    left = list(range(BITS))
    out = []
    for k in range(m):
        size = (len(left) + (m - k) - 1) // (m - k)
        sub = r[np.ix_(left, left)]
        group = [left[int(np.argmax(sub.max(1)))]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            gain = r[np.ix_(rest, group)].sum(1)
            group.append(rest[int(np.argmax(gain))])
        out.append(sorted(group))
        left = [b for b in left if b not in group]
    return out


def values_of(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, side by side."""
    v = np.zeros(len(fp), U64)
    for k, b in enumerate(bits):
        v |= ((fp >> U64(b)) & U64(1)) << U64(k)
    return v


def value_class(v: np.ndarray, width: int) -> np.ndarray:
    if width <= HISTOGRAM_BITS:
        return v.astype(np.int64)
    return (mixed(v) >> U64(64 - HISTOGRAM_BITS)).astype(np.int64)


@cache
def flips(width: int, distance: int) -> np.ndarray:
    """Masks with exactly ``distance`` of ``width`` bits."""
    return np.array(
        [sum(1 << b for b in c) for c in combinations(range(width), distance)], U64
    )


def thresholds(
    values: list[np.ndarray], histograms: list[np.ndarray], widths: list[int], distance: int
) -> np.ndarray:
    """For each fingerprint the thresholds that sum to ``distance - m + 1`` at least cost.

    The cost of a threshold is the number of probes and of the fingerprints in the classes they
    meet. Dynamic programming over partitions; states are the sums reached so far.
    """
    m, n = len(values), len(values[0])
    most = -(-(distance - m + 1) // m) + 1  # one above an even share
    cost = np.zeros((m, most + 2, n))
    for i in range(m):
        for t in range(most + 1):
            cost[i, t + 1] = cost[i, t]
            for mask in flips(widths[i], t):
                near = histograms[i][value_class(values[i] ^ mask, widths[i])]
                cost[i, t + 1] += 1 + near
    # best[s]: least cost so far with sum s - (partitions so far).
    sums = distance + 1
    best = np.full((sums + 1, n), np.inf)
    best[0] = 0
    choice = np.zeros((m, sums + 1, n), np.int8)
    for i in range(m):
        after = np.full((sums + 1, n), np.inf)
        for s in range(sums + 1):
            for t in range(min(s, most + 1) + 1):
                c = best[s - t] + cost[i, t]
                better = c < after[s]
                after[s][better] = c[better]
                choice[i, s][better] = t
        best = after
    out = np.zeros((m, n), np.int64)
    s = np.full(n, distance + 1, np.int64)
    for i in range(m - 1, -1, -1):
        t = choice[i, s, np.arange(n)]
        out[i] = t - 1
        s = s - t
    return out


def partition_count(n: int, distance: int) -> int:
    """The number of partitions with the least probes and random candidates for ``n`` rows."""

    def cost(m: int) -> float:
        total = 0.0
        base, extra = divmod(distance - m + 1, m)
        for i in range(m):
            t = base + (i < extra)
            if t >= 0:
                width = BITS // m
                probes = sum(len(flips(width, k)) for k in range(t + 1))
                total += probes * (1 + n / 2.0**width)
            total += 1
        return total

    options = [m for m in range(2, distance + 2) if (distance - m + 1) // m <= 1]
    return min(options or [distance + 1], key=cost) if distance else 2


# ------------------------------------------------------------------------------------- links


def _pairs_within(
    x: np.ndarray, y: np.ndarray, distance: int
) -> tuple[np.ndarray, np.ndarray]:
    near = np.bitwise_count(x ^ y) <= distance
    near &= x != y
    return x[near], y[near]


def _linked(
    index: np.ndarray, probes: np.ndarray, distance: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever pairs of a cell connect, at most two a fingerprint and block.

    Pairs are compared in blocks; within a block the smallest label spreads along the links
    found, and each fingerprint is linked to its label.
    """
    label = index.copy()
    top = U64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, len(probes), 512):
        x = probes[at : at + 512]
        near = np.bitwise_count(x[:, None] ^ index[None, :]) <= distance
        rows, cols = near.any(1), near.any(0)
        if not rows.any():
            continue
        near = near[np.ix_(rows, cols)]
        x, y = x[rows], label[cols]
        old = y
        while True:
            lx = np.where(near, y[None, :], top).min(1)
            ly = np.minimum(y, np.where(near, lx[:, None], top).min(0))
            if (ly == y).all():
                break
            y = ly
        yield x[x != lx], lx[x != lx]
        moved = np.unique(np.stack([old, y], 1)[old != y], axis=0)
        yield moved[:, 0], moved[:, 1]
        label[cols] = y


def link_fingerprints(distinct: DataFrame, distance: int) -> DataFrame:
    """Links ``(a, b)`` with the components of "at most ``distance`` bits differ".

    ``distinct`` has one row ``fp`` for each fingerprint and should be a stored table. The links
    returned connect what all pairs would connect, without listing the pairs of dense groups.
    """
    n = distinct.count()
    m = partition_count(n, distance)

    def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            fp = batch.column(0).to_numpy().view(U64)
            bits = np.unpackbits(fp.view(np.uint8), bitorder="little").reshape(-1, BITS)
            bits = bits.astype(np.float32)
            total += bits.T @ bits
        i, j = np.nonzero(total)
        yield pa.record_batch(
            [pa.array(i), pa.array(j), pa.array(total[i, j].astype(np.int64))],
            names=["i", "j", "n"],
        )

    counts = np.zeros((BITS, BITS))
    pairs = distinct.mapInArrow(ones, "i bigint, j bigint, n bigint")
    for i, j, c in pairs.groupBy("i", "j").agg(F.sum("n")).collect():  # 4096 rows at most
        counts[i, j] = c
    groups = correlated_partitions(counts, n, m)
    widths = [len(g) for g in groups]

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, 1 << HISTOGRAM_BITS), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(U64)
            for i, g in enumerate(groups):
                total[i] += np.bincount(
                    value_class(values_of(fp, g), widths[i]), minlength=1 << HISTOGRAM_BITS
                )
        i, c = np.nonzero(total)
        yield pa.record_batch(
            [pa.array(i), pa.array(c), pa.array(total[i, c])], names=["i", "c", "n"]
        )

    # At most 65536 rows a partition, whatever the number of fingerprints.
    counted = (
        distinct.mapInArrow(classes, "i bigint, c bigint, n bigint")
        .groupBy("i", "c").agg(F.sum("n").alias("n")).toArrow()
    )
    histograms = np.zeros((m, 1 << HISTOGRAM_BITS), np.int64)
    histograms[counted["i"].to_numpy(), counted["c"].to_numpy()] = counted["n"].to_numpy()
    shared = distinct.sparkSession.sparkContext.broadcast(histograms)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy().view(U64)
                yield from _entries(fp, groups, widths, list(shared.value), distance)

    cells = (
        distinct.mapInArrow(entries, "cell bigint, role int, fp bigint")
        .repartition(partitions(distinct), "cell")
        .sortWithinPartitions("cell", "role")
    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, role, fp in _whole_cells(batches):
            for a, b in _probe_cells(cell, role, fp, distance):
                yield pa.record_batch(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
                )

    return cells.mapInArrow(probe, "a bigint, b bigint")


INDEX, PROBE = 1, 2


def _entries(
    fp: np.ndarray, groups: list[list[int]], widths: list[int],
    histograms: list[np.ndarray], distance: int,
) -> Iterator[pa.RecordBatch]:
    """Index entries and probes of fingerprints, each with the cell it belongs to.

    A bucket of a partition whose class holds more than ``CELL`` fingerprints is a grid: index
    entries are dealt over its rows, probes over its columns, and each occurs in every cell of
    its row or column, so every probe still meets every entry.
    """
    values = [values_of(fp, g) for g in groups]
    limits = thresholds(values, histograms, widths, distance)
    deal = mixed(fp + U64(0x9E3779B97F4A7C15))

    def placed(i: int, v: np.ndarray, f: np.ndarray, d: np.ndarray, role: int):
        size = histograms[i][value_class(v, widths[i])]
        side = np.maximum(1, -(-size // CELL))
        key = mixed(v * U64(8) + U64(i + 1))
        for other in range(int(side.max()) if len(side) else 0):
            use = other < side
            own = d[use] % side[use].astype(U64)
            row, column = (own, U64(other)) if role == INDEX else (U64(other), own)
            cell = mixed(key[use] + row * U64(0x100000001) + column)
            yield pa.record_batch(
                [
                    pa.array(cell.view(np.int64)),
                    pa.array(np.full(len(cell), role, np.int32)),
                    pa.array(f[use].view(np.int64)),
                ],
                names=["cell", "role", "fp"],
            )

    for i in range(len(groups)):
        yield from placed(i, values[i], fp, deal, INDEX)
        for t in range(int(limits[i].max()) + 1):
            use = limits[i] >= t
            for mask in flips(widths[i], t):
                yield from placed(i, values[i][use] ^ mask, fp[use], deal[use], PROBE)


def _whole_cells(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted rows regrouped so that no cell is cut."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        part = [c.to_numpy() for c in batch.columns]
        if kept is not None:
            part = [np.concatenate(x) for x in zip(kept, part, strict=True)]
        cut = int(np.searchsorted(part[0], part[0][-1], side="left"))
        if cut:
            yield part[0][:cut], part[1][:cut], part[2][:cut].view(U64)
        kept = [x[cut:] for x in part]
    if kept is not None and len(kept[0]):
        yield kept[0], kept[1], kept[2].view(U64)


def _probe_cells(
    cell: np.ndarray, role: np.ndarray, fp: np.ndarray, distance: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    ends = np.append(starts[1:], len(cell))
    entries = np.add.reduceat((role == INDEX).astype(np.int64), starts)
    probes = ends - starts - entries
    pairs = entries * probes
    for k in np.flatnonzero(pairs > LISTED):
        middle = starts[k] + entries[k]
        yield from _linked(fp[starts[k] : middle], fp[middle : ends[k]], distance)
    small = np.flatnonzero((pairs > 0) & (pairs <= LISTED))
    total = np.cumsum(pairs[small])
    at = 0
    while at < len(small):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + (1 << 18), side="right")))
        k = small[at:to]
        each = pairs[k]
        which = np.repeat(np.arange(len(k)), each)
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        x = starts[k][which] + nth % entries[k][which]
        y = starts[k][which] + entries[k][which] + nth // entries[k][which]
        a, b = _pairs_within(fp[x], fp[y], distance)
        if len(a):
            yield a, b
        at = to


# ---------------------------------------------------------------------------------- operator


@any_columns
def near_duplicates(
    docs: DataFrame,
    words: int = 3,
    distance: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, tie, fp, component_id, keep`` for every row of ``docs``.

    A text's words, A-Z in lower case, give shingles of ``words`` words, repeats included (fewer
    words: the whole sequence); a bit of ``fp`` is set if it is set in over half of the shingles'
    XXH64 hashes. Null texts and texts without words have fingerprint zero. Fingerprints are
    linked at ``distance`` or fewer differing bits; ``component_id`` is the smallest id reachable
    and ``keep`` marks one row of each component: the smallest id, then the smallest ``tie``.

    Rows without id are linked like any other; their component's id is null if no row has one.
    Repeated rows are equal and exactly one of them can be kept. An empty table gives no rows.
    """
    rows = stage_table(with_fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = stage_table(
        rows.groupBy("fp").agg(
            F.min("id").alias("least"),
            F.min(F.struct(F.col("id").isNull(), "id", "tie")).alias("first"),
        ),
        "distinct",
    )
    links = stage_table(link_fingerprints(distinct.select("fp"), distance), "links")
    roots = connected_components(links)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", "first", F.coalesce("root", "fp").alias("root")
    )
    rooted = stage_table(rooted, "rooted")
    least = rooted.groupBy("root").agg(
        F.min("least").alias("component_id"), F.min("first").alias("first")
    )
    least = stage_table(least, "components")
    named = stage_table(rooted.select("fp", "root").join(least, "root").drop("root"), "named")
    same = (F.col("id").eqNullSafe(F.col("first.id"))) & (F.col("tie") == F.col("first.tie"))
    return rows.join(named, "fp").select("id", "tie", "fp", "component_id", same.alias("keep"))


@any_columns
def one_of_each(
    docs: DataFrame,
    words: int = 3,
    distance: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component stays.

    Repeated rows have equal id and text; the first by row content stays. Columns are unchanged.
    """
    one, two, nth = fresh(docs, "one", "two", "nth")

    def keys(identity, tie) -> list:
        """Columns without nulls that name an id and a text."""
        return [
            F.coalesce(identity.cast("string"), F.lit("")).alias(one),
            F.xxhash64(identity.isNull(), tie).alias(two),
        ]

    kept = (
        near_duplicates(docs, words, distance, id_col, text_col)
        .where("keep")
        .select(*keys(F.col("id"), F.col("tie")))
        .distinct()
    )
    named = docs.select("*", *keys(quoted(id_col), text_tie(text_col)))
    order = W.partitionBy(one, two).orderBy(F.xxhash64(*[quoted(c) for c in docs.columns]))
    return (
        named.join(kept, [one, two], "left_semi")
        .withColumn(nth, F.row_number().over(order))
        .where(F.col(nth) == 1)
        .select(*[quoted(c) for c in docs.columns])
    )
