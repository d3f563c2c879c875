from __future__ import annotations

import random

from cuemill.operators.intervals import MAX_CELL, cue_periods, periods_and_gaps, small_gap_audit

SCHEMA = "track_id long, start double, duration double"


def brute(rows):
    """Periods and gaps of (entity, a, b), straight from the definition."""
    out = set()
    for entity in {r[0] for r in rows if r[0] is not None}:
        spans = sorted((a, b) for e, a, b in rows if e == entity and a is not None and b is not None and b > a)
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(entity, "period", a, b) for a, b in merged}
        out |= {(entity, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def found(df):
    return {tuple(r) for r in df.collect()}


def test_random_intervals_of_all_lengths(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(4000):
        a = rng.choice([rng.randrange(0, 3000), rng.randrange(0, 10**6), rng.randrange(-(10**6), 10**9)])
        length = rng.choice([rng.randrange(1, 50), rng.randrange(1, 10**5), 65536, 65536 * 3, rng.choice([1, 10**8 // 3])])
        rows.append((rng.randrange(3), a, a + length))
    df = spark.createDataFrame(rows, "e long, a long, b long").repartition(7)
    assert found(periods_and_gaps(df, "e", "a", "b")) == brute(rows)


def test_shard_and_block_borders(spark):
    shard, block = 1 << 16, 1 << 26
    rows = [(1, 0, shard), (1, shard, shard + 5), (1, block - 3, block), (1, block, block + 1), (1, block + 3, 5 * block), (2, block - 1, 3 * block + 1)]
    assert found(periods_and_gaps(spark.createDataFrame(rows, "e long, a long, b long"), "e", "a", "b")) == brute(rows)


def test_hot_entity_and_repeated_rows(spark):
    rows = [(7, 10 * k, 10 * k + 10) for k in range(20_000)] * 2 + [(8, 0, 5)]
    df = spark.createDataFrame(rows, "e long, a long, b long").repartition(16)
    assert found(periods_and_gaps(df, "e", "a", "b")) == {(7, "period", 0, 200_000), (8, "period", 0, 5)}


def test_unusable_rows_and_empty_table(spark):
    rows = [(1, None, 1.0), (1, 1.0, None), (1, 1.0, 0.0), (1, 1.0, -2.0), (None, 1.0, 1.0), (1, float("nan"), 1.0), (1, float("inf"), 1.0), (1, float(MAX_CELL), 1.0)]
    assert found(cue_periods(spark.createDataFrame(rows, SCHEMA))) == set()
    assert found(cue_periods(spark.createDataFrame([], SCHEMA))) == set()


def test_gap_kinds_and_clashing_columns(spark):
    rows = [(1, 0.0, 1.0, "x"), (1, 1.0, 1.0, "y"), (1, 2.079, 1.0, None), (1, 3.159, 1.0, "z")]
    df = spark.createDataFrame(rows, "track_id long, start double, duration double, kind string")
    assert found(cue_periods(df)) == {(1, "period", 0, 2000), (1, "small_gap", 2000, 2079), (1, "period", 2079, 3079), (1, "gap", 3079, 3159), (1, "period", 3159, 4159)}


def test_audit_against_delivered_counts(spark):
    cues = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.05, 1.0), (2, 0.0, 1.0)], SCHEMA)
    told = spark.createDataFrame([(1, 1), (1, None), (3, 4)], "track_id long, gaps_too_small int")
    rows = {r.track_id: (r.periods, r.small_gaps, r.delivered, r.agrees) for r in small_gap_audit(cues, told).collect()}
    assert rows == {1: (2, 1, 1, True), 2: (1, 0, None, None)}
