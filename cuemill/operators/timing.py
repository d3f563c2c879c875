"""Time algebra, overlaps, margins and validation over cues keyed by track and position."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.operators import streams

from cuemill.functions.timecode import on_grid

BIN_MS = 30_000


def end_of() -> Column:
    return F.col("start") + F.col("duration")


def shift_time(cues: DataFrame, seconds: float) -> DataFrame:
    """Shifted cues; those that end at or before 0 go, those that begin before are cut to 0."""
    moved = F.col("start") + F.lit(seconds)
    end = end_of() + F.lit(seconds)
    return cues.where(end > 0).withColumns({"start": F.greatest(F.lit(0.0), moved), "duration": F.when(moved < 0, end).otherwise(F.col("duration"))})


def apply_offset(cues: DataFrame, seconds: float) -> DataFrame:
    """Shifted without cutting."""
    return cues.withColumn("start", F.col("start") + F.lit(seconds))


def trim(cues: DataFrame, end: float, start: float = 0.0) -> DataFrame:
    """Cues clamped into [start, end] on the 48 kHz grid; the duration may become negative."""
    early = F.greatest(F.lit(0.0), F.lit(start) - F.col("start"))
    late = F.greatest(F.lit(0.0), end_of() - F.lit(end))
    return cues.withColumns({"start": F.greatest(F.lit(start), F.col("start")), "duration": on_grid(F.col("duration"), -early, -late)})


def overlap_pairs(cues: DataFrame, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """All pairs of cues of a track of which the later begins before the earlier ends.

    Cues are ordered by start, then position.  A range join in bins of ``BIN_MS``: each cue
    lies in every bin it covers, and a pair is counted in the bin the later one begins in,
    so a track of any length is joined bin by bin.  Cues with null times are ignored.
    """
    ms = lambda c: F.floor(c * F.lit(1000.0 / BIN_MS)).cast("long")
    base = cues.select(F.col(track).alias("track"), F.col(position).alias("pos"), "start", end_of().alias("end")).where("start is not null and end is not null")
    spread = base.withColumn("bin", F.explode(F.sequence(ms(F.col("start")), F.greatest(ms(F.col("start")), ms(F.col("end"))))))
    later = base.select("track", F.col("pos").alias("second"), F.col("start").alias("s2"), ms(F.col("start")).alias("bin"))
    after = (F.col("s2") > F.col("start")) | ((F.col("s2") == F.col("start")) & (F.col("second") > F.col("pos")))
    return (
        spread.join(later, ["track", "bin"])
        .where(after & (F.col("s2") < F.col("end")))
        .select(F.col("track").alias(track), F.col("pos").alias("first"), "second")
    )


def overlap_groups(cues: DataFrame, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """``cues`` with ``group``: cues joined by overlaps, in order of start."""
    order = Window.partitionBy(track).orderBy("start", position)
    reach = F.max(end_of()).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") < reach, 0).otherwise(1)
    return cues.where("start is not null and duration is not null").withColumn("opens", opens).withColumn("group", F.sum("opens").over(order)).drop("opens")


def merge_overlaps(cues: DataFrame, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """One cue per group: least start, greatest end, texts as ``- speaker: text`` lines, the speaker if there is one."""
    grouped = overlap_groups(cues, track, position)
    line = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit("- "), F.col("speaker"), F.lit(": "), F.coalesce("text", F.lit("")))).otherwise(F.concat(F.lit("- "), F.coalesce("text", F.lit(""))))
    said = F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), F.col(position).alias("p"), line.alias("line"), F.col("text").alias("text"))))
    return grouped.groupBy(track, "group").agg(
        F.min("start").alias("start"),
        (F.max(end_of())).alias("end"),
        F.count("*").alias("merged"),
        F.when(F.count_distinct("speaker") == 1, F.max("speaker")).alias("speaker"),
        F.when(F.count("*") == 1, F.max("text")).otherwise(F.array_join(F.transform(said, lambda x: x["line"]), "\n")).alias("text"),
    )


def trim_overlaps(cues: DataFrame, gap: float = 0.05, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """In a group each cue but the last ends ``gap`` before the next begins, but lasts at least ``gap``."""
    order = Window.partitionBy(track, "group").orderBy("start", position)
    nxt = F.lead("start").over(order)
    allowed = F.greatest(F.lit(gap), nxt - F.col("start") - F.lit(gap))
    return overlap_groups(cues, track, position).withColumn("next", nxt).withColumn(
        "duration", F.when(F.col("next").isNull(), F.col("duration")).otherwise(F.least(F.col("duration"), allowed))
    ).drop("next", "group")


def with_margins(words: DataFrame, before: float, after: float, collision: str = "trim", min_gap: float = 0.08) -> DataFrame:
    """Cue extents from their first and last word with margins.

    ``words``: ``track_id``, ``cue_idx``, ``first_word``, ``last_word``.  If a cue would
    begin before the previous new end, mode ``trim`` begins at that end, mode ``gap`` a
    ``min_gap`` later.
    """
    order = Window.partitionBy("track_id").orderBy("first_word", "cue_idx")
    out = words.withColumns({"new_start": F.greatest(F.lit(0.0), F.col("first_word") - before), "new_end": F.col("last_word") + after})
    prior = F.lag("new_end").over(order) + F.lit(min_gap if collision == "gap" else 0.0)
    return out.withColumn("prior", prior).withColumn("new_start", F.when(F.col("prior") > F.col("new_start"), F.least(F.col("prior"), F.col("first_word"))).otherwise(F.col("new_start"))).drop("prior")


def validate(cues: DataFrame, min_duration: float = 0.8, max_duration: float = 7.0, min_gap: float = 0.08, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """Quality metrics per track: mean characters a second, longest line, short and long cues, small gaps, validity.

    Cues of null start or duration are ignored.
    """
    order = Window.partitionBy(track).orderBy(position)
    text = F.coalesce("text", F.lit(""))
    gap = F.col("start") - F.lag(end_of()).over(order)
    cps = F.when(F.col("duration") > 0, F.length(F.replace(text, F.lit("\n"), F.lit(""))) / F.col("duration")).otherwise(0.0)
    longest = F.array_max(F.transform(F.split(text, "\n"), lambda x: F.length(x)))
    out = (
        cues.where("start is not null and duration is not null")
        .select(track, position, "duration", cps.alias("cps"), longest.alias("cpl"), gap.alias("gap"))
        .groupBy(track)
        .agg(
            F.avg("cps").alias("avg_cps"),
            F.max("cpl").alias("max_cpl"),
            F.count_if(F.col("duration") < min_duration).alias("segments_too_short"),
            F.count_if(F.col("duration") > max_duration).alias("segments_too_long"),
            F.count_if((F.col("gap") >= 0) & (F.col("gap") < min_gap - 1e-6)).alias("gaps_too_small"),
        )
    )
    return out.withColumn("valid", (F.col("segments_too_short") == 0) & (F.col("segments_too_long") == 0) & (F.col("gaps_too_small") == 0))


def sanitize_timeline(cues: DataFrame, min_duration: float = 0.8, min_gap: float = 0.08, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """Gaps and least durations enforced in order, in whole milliseconds.

    A cue nearer than ``min_gap`` to the one before shortens it if that keeps
    ``min_duration``, else begins later (lasting at least 100 ms); then a short cue is
    extended up to ``min_gap`` before the next original start.  The fold needs the
    modified previous cue only, so a track streams past in order.  Track ids are longs.
    """
    least, gap = round(min_duration * 1000), round(min_gap * 1000)
    unit = lambda c: F.rint(c * 1000).cast("long")

    def make():
        held: list[tuple] = []  # the cue before as it now is, and the present one as it came

        def settle(following: int | None) -> Iterator[tuple]:
            track_, start, place, length = held.pop()
            if held:
                _, s, p, d = held.pop()
                close = start - (s + d) < gap
                if close and start - gap - s >= least:
                    d = start - gap - s
                elif close:
                    length, start = max(100, length - (s + d + gap - start)), s + d + gap
                yield track_, p, s, d
            if length < least:
                length = least if following is None else min(least, max(following - start - gap, length))
            held.append((track_, start, place, length))

        def step(row: tuple | None) -> Iterator[tuple]:
            if row is None:
                yield from settle(None)
                track_, s, p, d = held.pop()
                yield track_, p, s, d
                return
            if pending:
                held.append(pending.pop())
                yield from settle(row[1])
            pending.append(row)

        pending: list[tuple] = []

        def run(row: tuple | None) -> Iterator[tuple]:
            if row is None and pending:
                held.append(pending.pop())
            yield from step(row)

        return run

    rows = cues.where("start is not null and duration is not null").select(F.col(track).cast("long").alias("t"), unit(F.col("start")).alias("s"), F.col(position).cast("long").alias("p"), unit(F.col("duration")).alias("d")).where("t is not null")
    done = streams.fold(rows, "t", ["s", "p", "d"], "t long, p long, s long, d long", make)
    return done.select(F.col("t").alias(track), F.col("p").alias(position), F.col("s").alias("start_ms"), F.col("d").alias("duration_ms"))
