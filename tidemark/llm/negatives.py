"""Hard-negative mining through Hilbert-ordered blocks with zone maps.

Vectors are ordered by label and place on a Hilbert curve and stored as Parquet blocks of bounded
size. A block's zone map holds the smallest and largest value of each dimension and of the label.
Interval arithmetic on it bounds the inner product of an anchor with any vector of the block.

Both searches are the same: a *window* asks for an anchor's best rows of its own or of other
labels with scores in an interval. Its most promising block is read first; the k-th score found
there raises the window's lower end. Then the blocks are read whose bounds still meet the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import any_columns, partitions, quoted
from tidemark.plans.staging import scratch_path, stage_table

#: Vectors of a block, zone maps that are bounded at a time, anchors that are searched together.
BLOCK = 1024
PAGE = 64
LOT = 512
#: Bits of a dimension on the curve.
BITS = 3

#: The interval of all scores; the negative of each is a 64-bit integer too.
LEAST, MOST = 1 - 2**63, 2**63 - 1
VECTORS = "ids array<bigint>, labels array<bigint>, vectors binary, wide boolean"
ZONE = "label_low bigint, label_high bigint, low array<double>, high array<double>"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (integers below ``2**bits``).

    Skilling's transform: undo the rotations and reflections from the highest bit down, then Gray
    code. The bits are read across the dimensions, highest first; the result is one row of bytes
    for each cell and compares like the place.
    """
    x = cells.astype(np.uint32).T.copy()
    dims, rows = x.shape
    if not dims:
        return np.zeros((rows, 0), np.uint8)
    high = np.uint32(1 << (bits - 1))
    q = high
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(set_, p, swap)
            x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(rows, np.uint32)
    q = high
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= t
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).astype(np.uint8).T, axis=1)


def score_bounds(
    queries: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Interval arithmetic: smallest and largest inner product of each query with each box."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    # Integers below 2**53 are exact; beyond, sums may be off by a share of their terms.
    size = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T
    slack = np.where(size < 2.0**52, 0.0, size * 1e-12)
    return least - slack, most + slack


def inner_products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole numbers, as long as they fit 64 bits."""
    largest = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * rows.shape[1]
    if largest < 2.0**52:
        return (rows @ queries.T).astype(np.int64)
    return rows.astype(np.int64) @ queries.astype(np.int64).T


def _matrix(vectors: bytes, wide: bool, rows: int, scale: float) -> np.ndarray:
    kind = np.float64 if wide else np.float32
    found = np.frombuffer(vectors, kind).reshape(rows, -1 if vectors else 0)
    return np.floor(scale * found.astype(np.float64))


def _flat(cells: pa.ListArray) -> np.ndarray:
    """A matrix of the vectors of rows of equal length."""
    flat = cells.flatten().to_numpy(zero_copy_only=False)
    if flat.dtype != np.float32:
        flat = flat.astype(np.float64)
    return flat.reshape(len(cells), -1 if len(flat) else 0)


def whole_rows(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """Distinct ``id, label, v, dim`` of the rows that take part."""
    bad = F.exists(
        quoted(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return (
        df.where(quoted(vector_col).isNotNull() & ~bad)
        .select(
            quoted(id_col).cast("bigint").alias("id"),
            quoted(label_col).cast("bigint").alias("label"),
            quoted(vector_col).alias("v"),
            F.size(quoted(vector_col)).alias("dim"),
        )
        .where("id IS NOT NULL AND label IS NOT NULL")
        .distinct()
    )


def _with_place(rows: DataFrame) -> DataFrame:
    """Add ``place`` on the curve. Cells are cut at multiples of the typical component."""
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    power, n = rows.agg(F.sum(squares), F.sum("dim")).first()
    typical = ((power or 0.0) / (n or 1)) ** 0.5 or 1.0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            keys: list[bytes] = [b""] * len(dims)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _flat(batch.column(2).take(pa.array(at))) / typical
                cells = np.clip(np.floor((x + 2) * 2.0 ** (BITS - 2)), 0, 2**BITS - 1)
                for i, key in zip(at, hilbert_keys(cells, BITS), strict=True):
                    keys[i] = key.tobytes()
            yield pa.record_batch(
                [*batch.columns, pa.array(keys, pa.binary())], names=["id", "label", "v", "dim", "place"]
            )

    kind = rows.schema["v"].dataType.simpleString()
    return rows.mapInArrow(place, f"id bigint, label bigint, v {kind}, dim int, place binary")


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Neighbours on the curve in rows of at most ``size`` vectors each, with their zone map.

    Stored below one folder for each range of the curve (``shelf``), so that a reader who needs
    some ranges opens only their files. Equal places are split by id.
    """
    order = ["dim", "label", "place", "id"]
    n = max(1, min(partitions(rows), -(-rows.count() // size)))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, labels, v = (
            pa.concat_arrays([p.column(i) for p in parts]) for i in range(3)
        )
        x = _flat(v)
        low, high = (f(x, axis=0).astype(np.float64) for f in (np.min, np.max))
        label = labels.to_numpy()
        cells = [
            [x.shape[1]], [ids.to_pylist()], [label.tolist()], [x.tobytes()],
            [x.dtype == np.float64], [label.min()], [label.max()], [low.tolist()], [high.tolist()],
        ]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=names)

    names = ["dim", "ids", "labels", "vectors", "wide", "label_low", "label_high", "low", "high"]
    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    kinds = [pa.int32(), longs, longs, pa.binary(), pa.bool_(), pa.int64(), pa.int64(), doubles, doubles]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, dim = 0, None
        for batch in batches:
            dims = batch.column(3).to_numpy()
            at = 0
            while at < len(dims):
                if dim is not None and (dims[at] != dim or count == size):
                    yield packed(held)
                    held, count = [], 0
                dim = dims[at]
                # Rows are sorted by length first.
                to = min(int(np.searchsorted(dims, dim, "right")), at + size - count)
                held.append(batch.slice(at, to - at))
                count += to - at
                at = to
        if held:
            yield packed(held)

    built = ranged.mapInArrow(build, f"dim int, {VECTORS}, {ZONE}").select(
        F.spark_partition_id().alias("shelf"), F.monotonically_increasing_id().alias("block"), "*"
    )
    path = scratch_path(rows.sparkSession, name)
    built.write.partitionBy("shelf").parquet(path)
    return rows.sparkSession.read.schema(built.schema).parquet(path)


def _lots(blocks: DataFrame, every: int) -> DataFrame:
    """The rows whose id is divisible by ``every``, in the order of the blocks, ``LOT`` together."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shelf, block, dim, ids, labels, vectors, wide in zip(
                *[c.to_pylist() for c in batch.columns], strict=True
            ):
                at = [i for i, x in enumerate(ids) if x % every == 0]
                n = len(vectors) // len(ids)
                own = [
                    [shelf] * len(at), [block] * len(at), at, [dim] * len(at), [wide] * len(at),
                    [ids[i] for i in at], [labels[i] for i in at],
                    [vectors[i * n : i * n + n] for i in at],
                ]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(own, kinds, strict=True)], names=names)

    names = ["shelf", "block", "at", "dim", "wide", "id", "label", "v"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    anchors = stage_table(
        blocks.select("shelf", "block", "dim", "ids", "labels", "vectors", "wide").mapInArrow(
            pick,
            "shelf int, block bigint, at int, dim int, wide boolean, id bigint, label bigint, v binary",
        ),
        "anchors",
    )
    # One row for each shelf, and no more shelves than partitions.
    counts = sorted(map(tuple, anchors.groupBy("shelf").count().collect()))
    before = np.cumsum([0, *[n for _, n in counts]]).tolist()
    starts = anchors.sparkSession.createDataFrame(
        [(shelf, b) for (shelf, _), b in zip(counts, before, strict=False)], "shelf int, before bigint"
    )
    place = F.row_number().over(W.partitionBy("shelf").orderBy("block", "at")) - 1
    lot = F.floor((F.col("before") + place) / LOT).cast("bigint")
    lots = anchors.join(starts, "shelf").withColumn("group", lot).groupBy("group", "dim", "wide").agg(
        F.collect_list(F.struct("id", "label", "v")).alias("rows")
    )

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, dim, wide, rows in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                row = [
                    [(group << 31) + dim], [dim], [[r["id"] for r in rows]],
                    [[r["label"] for r in rows]], [b"".join(r["v"] for r in rows)], [wide],
                ]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(row, bound_kinds, strict=True)], names=bound_names)

    bound_names = ["lot", "dim", "ids", "labels", "vectors", "wide"]
    longs = pa.list_(pa.int64())
    bound_kinds = [pa.int64(), pa.int32(), longs, longs, pa.binary(), pa.bool_()]
    return lots.mapInArrow(bound, f"lot bigint, dim int, {VECTORS}")


def _pages(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Zone maps in rows of about ``PAGE``, and how many of these there are."""
    zones = blocks.select(
        "dim", F.struct("shelf", "block", "label_low", "label_high", "low", "high").alias("z")
    )
    pages = -(-zones.count() // PAGE) or 1
    page = F.pmod(F.xxhash64("z.block"), F.lit(pages)).cast("int")
    return zones.groupBy("dim", page.alias("page")).agg(F.collect_list("z").alias("zones")), pages


class Asked:
    """A lot's anchors and windows as matrices."""

    def __init__(self, ids, labels, vectors, wide, windows, scale):
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        self.anchors = _matrix(vectors, wide, len(self.ids), scale)
        column = lambda name: np.array([w[name] for w in windows], np.int64)
        self.window, self.of = column("w"), column("anchor")
        self.floor, self.ceiling, self.first = column("floor"), column("ceiling"), column("first")

    def may_hold(self, zones: list[dict], same: bool, scale: float) -> tuple[np.ndarray, np.ndarray]:
        """Which blocks may hold rows of which windows, and how well they fit: windows x blocks."""
        low, high = (np.floor(scale * np.array([z[c] for z in zones], np.float64)) for c in ("low", "high"))
        shape = len(zones), self.anchors.shape[1]
        least, most = score_bounds(self.anchors, low.reshape(shape), high.reshape(shape))
        first, last = (np.array([z[c] for z in zones], np.int64) for c in ("label_low", "label_high"))
        label = self.labels[:, None]
        if same:
            labelled = (first <= label) & (label <= last)
        else:
            labelled = (first != label) | (last != label)
        may = labelled[self.of] & (most[self.of] >= self.floor[:, None])
        may &= least[self.of] <= self.ceiling[:, None]
        middle = (least + most)[self.of] / 2
        aim = np.minimum(self.ceiling, np.abs(middle).max(initial=0))[:, None]
        return may, -np.abs(middle - aim)


def _windowed_top(
    blocks: DataFrame, lots: DataFrame, windows: DataFrame, k: int, same: bool, scale: float
) -> DataFrame:
    """``lot, w, rank, id, score``: the ``k`` best rows of each window.

    ``windows`` holds ``lot, w, anchor, floor, ceiling``: the anchor's index in its lot and the
    least and largest score asked for. ``same`` asks for rows of the anchor's label, otherwise
    for rows of any other label. Rows with the anchor's id are left out.
    """
    pages, n_pages = _pages(blocks)
    keys = "lot bigint, shelf int, block bigint"
    window = F.struct("w", "anchor", "floor", "ceiling", "first")

    def asked(which: DataFrame) -> DataFrame:
        return lots.join(which.groupBy("lot").agg(F.collect_list(window).alias("windows")), "lot")

    def at_pages(which: DataFrame, fn, schema: str) -> DataFrame:
        spread = asked(which).withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))))
        met = spread.join(pages, ["dim", "page"]).select(
            "lot", "ids", "labels", "vectors", "wide", "windows", "zones"
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    lot, *own, zones = (c[row].as_py() for c in batch.columns)
                    found = fn(Asked(*own, scale), zones)
                    found["lot"] = pa.array([lot] * len(found["block"]), pa.int64())
                    out = pa.RecordBatch.from_pydict(found)
                    yield out.select([c.split()[0] for c in schema.split(", ")])

        return met.mapInArrow(run, schema)

    def read(wanted: DataFrame, which: DataFrame) -> DataFrame:
        """Score the windows ``ws`` of each lot against each block that they want."""
        wanted = stage_table(wanted, "wanted-blocks")
        # As many shelves at most as the blocks have partitions.
        shelves = [r[0] for r in wanted.select("shelf").distinct().collect()]
        some = blocks.where(F.col("shelf").isin(shelves)).select(
            "block",
            *[F.col(c).alias(f"r_{c}") for c in ("ids", "labels", "vectors", "wide")],
        )
        met = wanted.join(asked(which), "lot").join(some, "block").select(
            "lot", "ids", "labels", "vectors", "wide", "windows",
            "ws", "r_ids", "r_labels", "r_vectors", "r_wide",
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    lot, *own, ws, ids, labels, vectors, wide = (c[row].as_py() for c in batch.columns)
                    a = Asked(*own, scale)
                    rows = _matrix(vectors, wide, len(ids), scale)
                    yield scored(lot, a, np.isin(a.window, ws), np.array(ids), np.array(labels), rows)

        return met.mapInArrow(run, "lot bigint, w int, id bigint, score bigint")

    def scored(lot, a: Asked, wanted, ids, labels, rows) -> pa.RecordBatch:
        found: list[np.ndarray] = []
        products = inner_products(rows, a.anchors)
        for anchor in np.unique(a.of[wanted]):
            asked = np.flatnonzero(wanted & (a.of == anchor))
            scores = products[:, anchor]
            fits = ((labels == a.labels[anchor]) == same) & (ids != a.ids[anchor])
            fits &= (scores >= a.floor[asked].min()) & (scores <= a.ceiling[asked].max())
            own = np.flatnonzero(fits)
            own = own[np.lexsort((ids[own], -scores[own]))]
            scores = scores[own]
            for i in asked:
                # Scores fall, so a window is one stretch of them.
                start = np.searchsorted(-scores, -a.ceiling[i], "left")
                end = np.searchsorted(-scores, -a.floor[i], "right")
                best = np.arange(start, min(end, start + k))
                found.append(np.column_stack([np.full(len(best), a.window[i]), ids[own[best]], scores[best]]))
        table = np.concatenate(found).astype(np.int64) if found else np.zeros((0, 3), np.int64)
        return pa.record_batch(
            [
                pa.array(np.full(len(table), lot, np.int64)), pa.array(table[:, 0].astype(np.int32)),
                pa.array(table[:, 1].copy()), pa.array(table[:, 2].copy()),
            ],
            names=["lot", "w", "id", "score"],
        )

    def most_promising(a: Asked, zones: list[dict]) -> dict[str, pa.Array]:
        may, fit = a.may_hold(zones, same, scale)
        best = np.where(may, fit, -np.inf).argmax(axis=1)
        rows = np.flatnonzero(may.any(axis=1))
        return {
            "w": pa.array(a.window[rows].astype(np.int32)),
            "shelf": pa.array([zones[b]["shelf"] for b in best[rows]], pa.int32()),
            "block": pa.array([zones[b]["block"] for b in best[rows]], pa.int64()),
            "fit": pa.array(fit[rows, best[rows]]),
        }

    def others(a: Asked, zones: list[dict]) -> dict[str, pa.Array]:
        may, _ = a.may_hold(zones, same, scale)
        block = np.array([z["block"] for z in zones], np.int64)
        may &= block[None] != a.first[:, None]
        hit = np.flatnonzero(may.any(axis=0))
        return {
            "shelf": pa.array([zones[b]["shelf"] for b in hit], pa.int32()),
            "block": pa.array(block[hit]),
            "ws": pa.array([a.window[may[:, b]].tolist() for b in hit], pa.list_(pa.int32())),
        }

    windows = stage_table(windows.withColumn("first", F.lit(-1).cast("bigint")), "windows")
    first = at_pages(windows, most_promising, f"{keys}, w int, fit double")
    first = first.groupBy("lot", "w").agg(
        F.max_by(F.struct("shelf", "block"), F.struct("fit", "block")).alias("b")
    )
    first = stage_table(first.select("lot", "w", "b.shelf", "b.block"), "first-blocks")
    wanted = first.groupBy("lot", "shelf", "block").agg(F.collect_list("w").alias("ws"))
    head = stage_table(read(wanted, windows), "first-scores")
    order = W.partitionBy("lot", "w").orderBy(F.col("score").desc(), "id")
    kth = (
        head.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") == k)
        .select("lot", "w", "score")
    )
    raised = (
        windows.drop("first")
        .join(first.select("lot", "w", F.col("block").alias("first")), ["lot", "w"])
        .join(kth, ["lot", "w"], "left")
        .withColumn("floor", F.coalesce("score", "floor"))
        .drop("score")
    )
    raised = stage_table(raised, "raised-windows")
    rest = read(at_pages(raised, others, f"{keys}, ws array<int>"), raised)
    return (
        head.unionByName(rest)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


@any_columns
def mine(
    df: DataFrame,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    every: int = 50,
    scale: float = 256.0,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``; a score is the inner product of these integers, which
    must fit 64 bits. Higher scores come first, ties by smaller id. Anchors are the rows whose id
    is divisible by ``every``; an anchor's positives are its first ``positives`` rows of its
    label. For each positive the first ``negatives`` rows of other labels are returned whose
    score is between ``low`` and ``high`` percent of the positive's, both included; a positive of
    negative score has none. Fewer rows give fewer.

    Rows without id or label and vectors that are null or hold null, NaN or infinite components
    take no part. Repeated rows count once; an id with several vectors or labels is several rows,
    none of which is a positive or negative of another. Vectors of different lengths have no
    score with each other, empty ones 0. An empty table gives no rows; other columns are not read.
    """
    rows = stage_table(_with_place(whole_rows(df, id_col, label_col, vector_col)), "places")
    blocks = _blocks(rows, BLOCK, "blocks")
    lots = stage_table(_lots(blocks, every), "lots")
    everything = lots.select(
        "lot", F.posexplode("ids").alias("anchor", "_id")
    ).selectExpr("lot", "anchor AS w", "anchor", f"{LEAST}L AS floor", f"{MOST}L AS ceiling")
    best = stage_table(
        _windowed_top(blocks, lots, everything, positives, True, scale), "positives"
    )
    # Whole numbers: 100 * negative between low * positive and high * positive.
    pairs = stage_table(
        best.where("score >= 0").join(lots.select("lot", F.col("ids").alias("anchors")), "lot").selectExpr(
            "lot",
            f"w * {positives} + rank - 1 AS w",
            "w AS anchor",
            f"score div 100 * {low} + (score % 100 * {low} + 99) div 100 AS floor",
            f"score div 100 * {high} + score % 100 * {high} div 100 AS ceiling",
            "anchors[w] AS anchor_id",
            "id AS positive_id",
            "score AS positive_score",
        ),
        "pairs",
    )
    asked = pairs.select("lot", "w", "anchor", "floor", "ceiling")
    found = _windowed_top(blocks, lots, asked, negatives, False, scale).select(
        "lot", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    return found.join(pairs, ["lot", "w"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
