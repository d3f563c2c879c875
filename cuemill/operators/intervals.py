"""Continuous periods and gaps of overlapping intervals, by compressed run bitmaps.

Time is cut into exact cells (1 ms by default).  A *shard* is 2**16 cells and a
*block* is 2**10 shards.  Every interval becomes runs of set cells in the shards it
touches; a stretch of whole shards becomes one run of shard numbers in its block, so
a long interval costs a few rows, not one per shard.  Runs are kept as pairs of
little-endian uint16 (first, last), the run container of compressed bitmaps.

1. ``_encode``: each task unites its own rows per (entity, block, shard), so that what
   is shuffled is bounded by 2**15 runs a shard and task, however many rows an entity has.
2. ``_extract``: bitmaps are united per (entity, block) while they stream past in sorted
   order; set runs and clear runs inside a block are final.
3. ``_stitch``: only the first and last run of every block are joined across blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_BITS = 16
BLOCK_SHARDS_BITS = 10
BLOCK_BITS = SHARD_BITS + BLOCK_SHARDS_BITS
MAX_CELL = 1 << 52
_BUFFER_ROWS = 400_000

_BITMAP_SCHEMA = "entity long, block long, shard int, runs binary"
_RUN_SCHEMA = "entity long, block long, kind string, first_cell long, end_cell long, edge int"


def cell(seconds: Column, per_second: int = 1000) -> Column:
    """Seconds as a whole number of cells, ties to even; null where not finite or out of range."""
    units = F.rint(seconds * F.lit(float(per_second)))
    return F.when(F.abs(units) < F.lit(float(MAX_CELL)), units.cast("long"))


def _merge(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite half-open runs of equal key; rows come back sorted by (key, lo)."""
    if not len(key):
        return key, lo, hi
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    # hi is lifted by the key's rank so that one running maximum serves all keys
    rank = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
    lift = rank * (np.int64(1) << 33)
    reach = np.maximum.accumulate(hi + lift)
    fresh = np.concatenate(([True], (lo + lift)[1:] > reach[:-1]))
    # a touching run of another key is never reached: the lift is larger than any shard
    starts = np.flatnonzero(fresh)
    ends = np.concatenate((starts[1:], [len(key)])) - 1
    return key[starts], lo[starts], (reach - lift)[ends]


def _pieces(entity: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cut intervals at shard borders: (entity, block, shard, lo, hi); shard -1 holds runs of whole shards."""
    shard_cells, per_block = 1 << SHARD_BITS, 1 << BLOCK_SHARDS_BITS
    first, last = start >> SHARD_BITS, (end - 1) >> SHARD_BITS
    parts = []

    def add(mask: np.ndarray, shard: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        if mask.any():
            s = shard[mask]
            parts.append((entity[mask], s >> BLOCK_SHARDS_BITS, s & (per_block - 1), lo[mask], hi[mask]))

    one = first == last
    base = first << SHARD_BITS
    add(one, first, start - base, end - base)
    add(~one, first, start - base, np.full_like(start, shard_cells))
    add(~one, last, np.zeros_like(start), end - (last << SHARD_BITS))
    inner = (last - first) > 1
    if inner.any():
        e, a, b = entity[inner], first[inner] + 1, last[inner]  # whole shards a .. b-1
        blocks = ((b - 1) >> BLOCK_SHARDS_BITS) - (a >> BLOCK_SHARDS_BITS) + 1
        e, a, b = np.repeat(e, blocks), np.repeat(a, blocks), np.repeat(b, blocks)
        step = np.arange(len(e)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        block = (a >> BLOCK_SHARDS_BITS) + step
        lo = np.maximum(a, block << BLOCK_SHARDS_BITS) - (block << BLOCK_SHARDS_BITS)
        hi = np.minimum(b, (block + 1) << BLOCK_SHARDS_BITS) - (block << BLOCK_SHARDS_BITS)
        parts.append((e, block, np.full(len(e), -1, np.int64), lo, hi))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _keys(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense rank of the row tuples in sort order, and the index of each rank's first row."""
    order = np.lexsort(columns[::-1])
    change = np.zeros(len(order), bool)
    change[:1] = True
    for c in columns:
        s = c[order]
        change[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(change) - 1
    return rank, order[change]


def _bitmaps(pieces: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    entity, block, shard, lo, hi = pieces
    key, at = _keys(entity, block, shard)
    key, lo, hi = _merge(key, lo, hi)
    runs = np.empty((len(lo), 2), "<u2")
    runs[:, 0], runs[:, 1] = lo, hi - 1
    counts = np.bincount(key, minlength=len(at))
    offsets = np.concatenate(([0], np.cumsum(counts * 4))).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(runs.tobytes())])
    return pa.RecordBatch.from_arrays(
        [pa.array(entity[at]), pa.array(block[at]), pa.array(shard[at].astype(np.int32)), packed], ["entity", "block", "shard", "runs"]
    )


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(_pieces(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)))
        rows += len(held[-1][0])
        if rows >= _BUFFER_ROWS:
            yield _bitmaps(tuple(np.concatenate(c) for c in zip(*held, strict=True)))
            held, rows = [], 0
    if held:
        yield _bitmaps(tuple(np.concatenate(c) for c in zip(*held, strict=True)))


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    entity, block, shard = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    runs = batch.column(3)
    counts = pc.binary_length(runs).to_numpy(zero_copy_only=False) // 4
    flat = np.frombuffer(b"".join(x.as_py() for x in runs), "<u2").reshape(-1, 2).astype(np.int64)
    lo, hi = flat[:, 0], flat[:, 1] + 1
    shard = np.repeat(shard.astype(np.int64), counts)
    whole = shard < 0
    base = shard << SHARD_BITS
    lo = np.where(whole, lo << SHARD_BITS, base + lo)
    hi = np.where(whole, hi << SHARD_BITS, base + hi)
    return np.repeat(entity, counts), np.repeat(block, counts), lo, hi


def _runs(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Set runs and inner clear runs of whole (entity, block) groups."""
    entity, block, lo, hi = (np.concatenate(c) for c in zip(*parts, strict=True))
    key, at = _keys(entity, block)
    key, lo, hi = _merge(key, lo, hi)
    ent, blk = entity[at][key], block[at][key]
    base = blk << BLOCK_BITS
    lo, hi = lo + base, hi + base
    first = np.concatenate(([True], key[1:] != key[:-1]))
    last = np.concatenate((first[1:], [True]))
    edge = first.astype(np.int32) + 2 * last.astype(np.int32)
    between = ~last[:-1]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((ent, ent[:-1][between]))),
            pa.array(np.concatenate((blk, blk[:-1][between]))),
            pa.array(["period"] * len(key) + ["gap"] * int(between.sum()), pa.string()),
            pa.array(np.concatenate((lo, hi[:-1][between]))),
            pa.array(np.concatenate((hi, lo[1:][between]))),
            pa.array(np.concatenate((edge, np.zeros(int(between.sum()), np.int32)))),
        ],
        ["entity", "block", "kind", "first_cell", "end_cell", "edge"],
    )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (entity, block): a group that may go on is carried to the next batch."""
    carry: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        entity, block, lo, hi = _unpack(batch)
        if carry is not None:
            entity, block, lo, hi = (np.concatenate(c) for c in zip(carry, (entity, block, lo, hi), strict=True))
        open_ = (entity == entity[-1]) & (block == block[-1])
        if not open_.all():
            yield _runs([(entity[~open_], block[~open_], lo[~open_], hi[~open_])])
        lo, hi = lo[open_], hi[open_]
        _, lo, hi = _merge(np.zeros(len(lo), np.int64), lo, hi)
        carry = (np.full(len(lo), entity[-1]), np.full(len(lo), block[-1]), lo, hi)
    if carry is not None:
        yield _runs([carry])


def _stitch(runs: DataFrame) -> DataFrame:
    """Join the outermost runs of neighbouring blocks; all other runs are final already."""
    edges = runs.where("edge > 0")
    order = Window.partitionBy("entity").orderBy("first_cell")
    marked = edges.select(
        "*",
        F.lag("end_cell").over(order).alias("before"),
        F.lag("block").over(order).alias("block_before"),
    ).withColumn("opens", F.when(F.col("before") == F.col("first_cell"), 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("opens").over(order))
    periods = islands.groupBy("entity", "island").agg(F.min("first_cell").alias("first_cell"), F.max("end_cell").alias("end_cell"))
    gaps = marked.where((F.col("before") < F.col("first_cell")) & (F.col("block_before") != F.col("block")))
    final = runs.where("edge = 0").select("entity", "kind", "first_cell", "end_cell")
    return final.unionAll(periods.select("entity", F.lit("period").alias("kind"), "first_cell", "end_cell")).unionAll(
        gaps.select("entity", F.lit("gap").alias("kind"), F.col("before").alias("first_cell"), F.col("first_cell").alias("end_cell"))
    )


def periods_and_gaps(intervals: DataFrame, entity: str, first_cell: str, end_cell: str) -> DataFrame:
    """Continuous periods of each entity and the gaps between them.

    ``intervals`` has a long entity column and two long columns with half-open cells.
    Rows with a null in any of the three or with end <= first are ignored.  Intervals
    that touch are one period.  Repeated rows change nothing, further columns are
    ignored, an empty table gives an empty result.  Result: ``entity``, ``kind``
    (period or gap), ``first_cell``, ``end_cell``.
    """
    clean = intervals.select(
        F.col(entity).cast("long").alias("entity"), F.col(first_cell).cast("long").alias("a"), F.col(end_cell).cast("long").alias("b")
    ).where("entity is not null and a is not null and b is not null and b > a")
    bitmaps = clean.mapInArrow(_encode, _BITMAP_SCHEMA)
    ordered = bitmaps.repartition("entity", "block").sortWithinPartitions("entity", "block")
    return _stitch(ordered.mapInArrow(_extract, _RUN_SCHEMA))


def cue_periods(cues: DataFrame, key: str = "track_id", min_gap: float = 0.08, per_second: int = 1000) -> DataFrame:
    """Periods, gaps and small gaps of cues with ``start`` and ``duration`` in seconds.

    Cues with null or non-finite start or duration, or duration <= 0, are ignored; so
    are cues of a null key.  A gap shorter than ``min_gap`` has kind ``small_gap``.
    Result: key, ``kind``, ``start_ms``, ``end_ms`` (cells of 1/``per_second`` s).
    """
    spans = cues.where("duration > 0").select(
        F.col(key).alias("entity"),
        cell(F.col("start"), per_second).alias("a"),
        cell(F.col("start") + F.col("duration"), per_second).alias("b"),
    )
    least = round(min_gap * per_second)
    found = periods_and_gaps(spans, "entity", "a", "b")
    small = (F.col("kind") == "gap") & (F.col("end_cell") - F.col("first_cell") < least)
    return found.select(
        F.col("entity").alias(key),
        F.when(small, "small_gap").otherwise(F.col("kind")).alias("kind"),
        F.col("first_cell").alias("start_ms"),
        F.col("end_cell").alias("end_ms"),
    )


def small_gap_audit(cues: DataFrame, delivered: DataFrame, min_gap: float = 0.08) -> DataFrame:
    """Small gaps of every track beside the delivered ``gaps_too_small``.

    Tracks without usable cues have no row; a track without a delivered count keeps a
    null ``delivered`` and ``agrees``.  Of several delivered rows of a track the
    largest count stands.
    """
    counted = (
        cue_periods(cues, min_gap=min_gap)
        .groupBy("track_id")
        .agg(
            F.count_if(F.col("kind") == "period").alias("periods"),
            F.count_if(F.col("kind") != "period").alias("gaps"),
            F.count_if(F.col("kind") == "small_gap").alias("small_gaps"),
            F.sum(F.when(F.col("kind") == "period", F.col("end_ms") - F.col("start_ms")).otherwise(0)).alias("covered_ms"),
        )
    )
    told = delivered.groupBy("track_id").agg(F.max("gaps_too_small").cast("long").alias("delivered"))
    return counted.join(told, "track_id", "left").withColumn("agrees", F.col("delivered") == F.col("small_gaps"))
