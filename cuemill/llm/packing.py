"""Filling containers of fixed capacity, by vector best-fit.

An item has three sizes: tokens, one document, and attention cost (tokens squared).  In
falling order of tokens each item goes to the open container in which the weighted norm
of what is left, over all three capacities, is least; none that breaks any capacity is
considered.  Items above the token capacity are cut into full pieces and a rest.

Items are dealt to shards by hash, as many as keep ``SHARD_BINS`` containers each, and
packed there independently; containers that stay below ``FULL`` are opened again and
their items packed anew in ever fewer shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.session import cut

SHARD_BINS = 3000
FULL = 0.97


@dataclass(frozen=True)
class Capacity:
    """Limits of one container and the weights of the residuals."""

    tokens: int
    documents: int
    attention: float
    weights: tuple[float, float, float] = (1.0, 0.1, 0.2)


def best_fit(items: list[tuple[int, int]], cap: Capacity) -> list[list[int]]:
    """Containers as lists of item numbers; ``items`` are (number, tokens) with 1 <= tokens <= capacity.

    The attention limit never keeps an item from a container of its own.
    """
    bins: list[list] = []  # [tokens left, documents left, attention left, members]
    order: list[tuple[int, int]] = []  # (tokens left, bin), sorted
    wt, wd, wa = cap.weights
    for number, size in sorted(items, key=lambda x: (-x[1], x[0])):
        cost = float(size) * size
        best = None
        at = bisect_left(order, (size, -1))
        while at < len(order):
            left, b = order[at]
            if best is not None:
                # what this and every later container leaves at least: tokens, and attention, of which no more is spent than tokens used squared
                spare = max(0.0, cap.attention - float(cap.tokens - left) ** 2 - cost)
                if wt * ((left - size) / cap.tokens) ** 2 + wa * (spare / cap.attention) ** 2 > best[0] + 1e-12:
                    break
            bin_ = bins[b]
            if bin_[1] >= 1 and bin_[2] >= cost:
                norm = wt * ((left - size) / cap.tokens) ** 2 + wd * ((bin_[1] - 1) / cap.documents) ** 2 + wa * ((bin_[2] - cost) / cap.attention) ** 2
                if best is None or norm < best[0]:
                    best = (norm, at, b)
            at += 1
        if best is None:
            bins.append([cap.tokens - size, cap.documents - 1, cap.attention - cost, [number]])
            b = len(bins) - 1
        else:
            _, at, b = best
            order.pop(at)
            bin_ = bins[b]
            bin_[0] -= size
            bin_[1] -= 1
            bin_[2] -= cost
            bin_[3].append(number)
        if bins[b][0] > 0 and bins[b][1] > 0:
            insort(order, (bins[b][0], b))
    return [b[3] for b in bins]


def pieces(items: DataFrame, key: str, tokens: str, capacity: int) -> DataFrame:
    """Items cut at the capacity: ``key``, ``piece`` from 0, ``tokens``; items of null or no size are left out."""
    size = F.col(tokens)
    return (
        items.where(size > 0)
        .select(F.col(key).cast("long").alias("item"), size.cast("long").alias("size"))
        .select("item", "size", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / capacity).cast("int"))).alias("piece"))
        .select("item", "piece", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece").cast("long") * capacity).alias("tokens"))
    )


def _pack_round(parts: DataFrame, cap: Capacity, shards: int, turn: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(shard: int, rows: list[tuple]) -> pa.RecordBatch:
            bins = best_fit([(n, r[2]) for n, r in enumerate(rows)], cap)
            out = [(f"{turn}-{shard}-{b}", rows[n][0], rows[n][1], rows[n][2], sum(rows[m][2] for m in members)) for b, members in enumerate(bins) for n in members]
            c = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64())],
                ["container", "item", "piece", "tokens", "filled"],
            )

        shard, rows = None, []
        for batch in batches:
            for s, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard and rows:
                    yield finish(shard, rows)
                    rows = []
                shard = s
                rows.append(tuple(row))
        if rows:
            yield finish(shard, rows)

    dealt = parts.select(F.pmod(F.xxhash64("item", "piece", F.lit(turn)), F.lit(shards)).cast("int").alias("shard"), "item", "piece", "tokens")
    ordered = dealt.repartition(min(shards, 2000), "shard").sortWithinPartitions("shard", "item", "piece")
    return ordered.mapInArrow(work, "container string, item long, piece int, tokens long, filled long")


def pack(items: DataFrame, key: str, tokens: str, cap: Capacity, rounds: int = 3, shard_bins: int = SHARD_BINS) -> DataFrame:
    """Every piece of every item with its container.

    Repeated rows are items of their own; items with null key or without tokens are left
    out; an empty table gives an empty result.  Result: ``container``, ``item``,
    ``piece``, ``tokens``, ``filled`` (tokens in the container).
    """
    parts = cut(pieces(items.where(F.col(key).isNotNull()), key, tokens, cap.tokens))
    done = None
    for turn in range(rounds):
        total = parts.agg(F.sum("tokens")).first()[0] or 0
        shards = max(1, -(-total // (cap.tokens * shard_bins)))
        packed = cut(_pack_round(parts, cap, int(shards), turn))
        last = turn == rounds - 1 or shards == 1 and turn > 0
        full = packed if last else packed.where(F.col("filled") >= FULL * cap.tokens)
        done = full if done is None else done.unionAll(full)
        if last:
            break
        parts = packed.where(F.col("filled") < FULL * cap.tokens).select("item", "piece", "tokens")
    return done


def containers(packed: DataFrame, cap: Capacity) -> DataFrame:
    """Content and use of each container; ``binding`` is the limit it is nearest to (tokens, documents or attention)."""
    held = packed.groupBy("container").agg(
        F.count("*").alias("pieces"),
        F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / cap.tokens).alias("fill"),
        (F.count("*") / cap.documents).alias("documents"),
        (F.sum(F.col("tokens").cast("double") * F.col("tokens")) / cap.attention).alias("attention"),
        F.array_sort(F.collect_list(F.struct("item", "piece", "tokens"))).alias("content"),
    )
    nearest = F.greatest("fill", "documents", F.least("attention", F.lit(1.0)))
    return held.withColumn("binding", F.when(F.col("documents") == nearest, "documents").when(F.col("fill") == nearest, "tokens").otherwise("attention"))
