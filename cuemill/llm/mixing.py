"""Mixing sources to target weights.

Weights are a temperature mixture: target shares and the sources' own token shares are
exponentiated and multiplied, ``target^(1-a) * own^a`` normalised.  The exponent is
bisected to the least at which no source needs more repeats than it may have; where an
entropy is asked for instead of targets, the weights are ``own^a`` with the exponent
bisected to it, flattened further where a source would need too many repeats.  The weights
are realised as budgeted block permutations: a source's records lie in hashed blocks,
each pass uses the blocks in another order, whole passes come first, and only the block
at the budget's edge is cut record by record.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.session import cut

STEPS = 60
BLOCK_RECORDS = 512
MOST_BLOCKS = 65_536  # a source's blocks grow instead, so that ordering them stays a small task
SOURCES = 100_000


def normalised(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total else dict.fromkeys(weights, 0.0)


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def exponent_for_entropy(own: dict[str, float], wanted: float) -> float:
    """Exponent of the own shares at which the mixture has the wanted entropy (clipped to what can be reached)."""
    low, high = 0.0, 8.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        if entropy(normalised({k: p**middle for k, p in own.items() if p > 0})) > wanted:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def weights(own_tokens: dict[str, float], targets: dict[str, float], repeats: dict[str, int], total: float) -> tuple[dict[str, float], float]:
    """(weights, exponent): least exponent at which every source's budget fits its repeats; at 1 with a rest, budgets are capped."""
    own = normalised({k: v for k, v in own_tokens.items() if k in targets and v > 0})
    aim = normalised({k: targets[k] for k in own if targets[k] > 0})

    def mixed(a: float) -> dict[str, float]:
        return normalised({k: aim[k] ** (1 - a) * own[k] ** a for k in aim})

    def fits(a: float) -> bool:
        return all(w * total <= repeats[k] * own_tokens[k] * (1 + 1e-9) for k, w in mixed(a).items())

    if not aim:
        return {}, 0.0
    if fits(0.0):
        return mixed(0.0), 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return mixed(high), high


def weights_for_entropy(own_tokens: dict[str, float], repeats: dict[str, int], total: float, wanted: float) -> tuple[dict[str, float], float]:
    """(weights, exponent) of the own shares' mixture of the wanted entropy, or of the nearest one whose budgets fit the repeats."""
    own = normalised({k: v for k, v in own_tokens.items() if k in repeats and v > 0})
    if not own:
        return {}, 0.0
    mixed = lambda a: normalised({k: p**a for k, p in own.items()})
    fits = lambda a: all(w * total <= repeats[k] * own_tokens[k] * (1 + 1e-9) for k, w in mixed(a).items())
    exponent = exponent_for_entropy(own, wanted)
    if fits(exponent):
        return mixed(exponent), exponent
    # the own shares (exponent 1) need the same number of passes of every source
    low, high = exponent, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return mixed(high), high


def _few(sources: DataFrame) -> list:
    """Rows of a table with one row per source; more than ``SOURCES`` are refused, not cut."""
    rows = sources.limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    return rows


def mix(records: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, wanted_entropy: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selection, shares, schedule).

    ``records``: ``doc_id``, ``source``, ``tokens``; sources are compared without case and
    outer blanks; records of a null source, of a source without target or without tokens
    are left out and shown with weight 0 in the shares.  ``targets``: ``source``,
    ``target_share``, ``max_repeats``.  ``total_tokens`` is by default what the sources
    hold; with ``wanted_entropy`` (nats) the target shares are replaced by a temperature
    mixture of that entropy.  Selection: ``doc_id``, ``source``, ``tokens``, ``times`` (1 to
    max_repeats), ``block``, ``rank`` (order within the block).  Shares: per source the
    target, own and reached shares and the passes used.  Schedule: ``source``, ``pass``
    (from 1), ``position`` (from 1), ``block``: the order in which a pass takes the blocks;
    of the last pass's last block only records up to ``times`` of at least that pass count.
    """
    clean = cut(
        records.where("doc_id is not null and tokens > 0").select(
            "doc_id", F.lower(F.trim("source")).alias("source"), F.col("tokens").cast("long").alias("tokens")
        ).where("source is not null")
    )
    held = {r[0]: (r[1], r[2]) for r in _few(clean.groupBy("source").agg(F.sum("tokens"), F.count("*")))}
    aims = {r[0]: (r[1], r[2]) for r in _few(targets.select(F.lower(F.trim("source")), "target_share", "max_repeats").where("target_share is not null"))}
    own_tokens = {k: float(v[0]) for k, v in held.items()}
    total = float(total_tokens or sum(v for k, v in own_tokens.items() if k in aims))
    repeats = {k: int(v[1] or 1) for k, v in aims.items()}
    if wanted_entropy is None:
        share, exponent = weights(own_tokens, {k: v[0] for k, v in aims.items()}, repeats, total)
    else:
        share, exponent = weights_for_entropy(own_tokens, repeats, total, wanted_entropy)
    session = records.sparkSession
    plan = []
    for k, w in sorted(share.items()):
        budget = min(w * total, repeats[k] * own_tokens[k])
        plan.append((k, w, int(budget // own_tokens[k]), float(budget % own_tokens[k]), min(MOST_BLOCKS, max(1, held[k][1] // BLOCK_RECORDS))))
    plans = session.createDataFrame(plan, "source string, weight double, passes int, budget double, blocks long")
    dealt = clean.join(F.broadcast(plans), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
    sums = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("held"), F.first("budget").alias("budget"), F.first("passes").alias("passes"))
    turn = lambda nth: F.xxhash64("block", nth + seed + 1)
    # the running sum over a source's blocks, in the order of the pass that is not whole, is the only ordered step over a source
    order = Window.partitionBy("source").orderBy(turn(F.col("passes") + 1), "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.coalesce(F.sum("held").over(order), F.lit(0))).select(
        "source", "block", "passes", F.when(F.col("before") + F.col("held") <= F.col("budget"), 1).when(F.col("before") >= F.col("budget"), 0).otherwise(2).alias("state"), "before"
    )
    joined = dealt.join(placed.drop("passes"), ["source", "block"])
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id")
    ranked = joined.withColumn("rank", F.row_number().over(inside)).withColumn("upto", F.col("before") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    extra = F.when(F.col("state") < 2, F.col("state")).otherwise((F.col("upto") - F.col("tokens") / 2 <= F.col("budget")).cast("int"))
    selection = ranked.select("doc_id", "source", "tokens", (F.col("passes") + extra).alias("times"), "block", "rank").where("times > 0")
    used = F.col("passes") + (F.col("state") > 0).cast("int")
    schedule = (
        placed.where(used > 0).select("source", "block", F.explode(F.sequence(F.lit(1), used)).alias("pass"))
        .withColumn("position", F.row_number().over(Window.partitionBy("source", "pass").orderBy(turn(F.col("pass")), "block")))
        .select("source", "pass", "position", "block")
    )
    reached = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("used"), F.max("times").alias("most"), F.count("*").alias("records"))
    overall = sum(own_tokens.values()) or 1.0
    facts = [
        (k, float(aims[k][0]) if k in aims else None, own_tokens.get(k, 0.0) / overall, float(share.get(k, 0.0)), repeats.get(k), exponent)
        for k in sorted({*held, *aims})
    ]
    known = session.createDataFrame(facts, "source string, target_share double, own_share double, weight double, max_repeats int, exponent double")
    every = Window.partitionBy()
    shares = known.join(reached, "source", "left").select(
        "source", "target_share", "own_share", "weight", "exponent", "max_repeats",
        F.coalesce("used", F.lit(0)).alias("tokens"),
        (F.coalesce("used", F.lit(0)) / F.sum("used").over(every)).alias("reached_share"),
        F.coalesce("most", F.lit(0)).alias("most_repeats"),
        F.coalesce("records", F.lit(0)).alias("records"),
    )
    return selection, shares, schedule
