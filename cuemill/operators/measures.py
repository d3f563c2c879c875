"""Figures of tracks and of neighbouring cues: spans, speakers, words, styles, gaps, numbering.

``cues`` holds one row per position; null times make null figures, empty speakers count as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.operators.segments import words_of

DEFAULT_SECONDS = {"fcpxml": 3600.0, "premiere_xml": 60.0, "json3": 0.0}
LAST_LINE_SECONDS = 5.0
COLORS = 10


def _order(track: str, position: str):
    return Window.partitionBy(track).orderBy(position)


def named(speaker: Column) -> Column:
    return F.nullif(speaker, F.lit(""))


def span(cues: DataFrame, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """``start``, ``end`` and ``span`` from the first cue to the last one in order of position, whatever lies between."""
    timed = cues.where("start is not null and duration is not null")
    end = F.max_by(F.col("start") + F.col("duration"), position)
    start = F.min_by("start", position)
    return timed.groupBy(track).agg(start.alias("start"), end.alias("end"), (end - start).alias("span"))


def document_stats(cues: DataFrame, track: str = "track_id") -> DataFrame:
    """``duration`` (the latest end, four digits), ``num_segments`` and the sorted ``speakers``."""
    return cues.groupBy(track).agg(F.round(F.max(F.col("start") + F.col("duration")), 4).alias("duration"), F.count("*").alias("num_segments"), F.array_sort(F.collect_set(named(F.col("speaker")))).alias("speakers"))


def speaker_counts(cues: DataFrame, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """Rows and positions of every speaker of a track."""
    return cues.where("speaker <> ''").groupBy(track, "speaker").agg(F.count("*").alias("lines"), F.count_distinct(position).alias("cues"))


def word_counts(cues: DataFrame, track: str = "track_id") -> DataFrame:
    """Cues with words and the number of words, of aligned words where there are any, else of the text."""
    n = F.size(words_of(F.coalesce("text", F.lit(""))))
    if "words" in cues.columns:
        n = F.when(F.size("words") > 0, F.size("words")).otherwise(n)
    return cues.groupBy(track).agg(F.count_if(n > 0).alias("with_words"), F.sum(n).cast("long").alias("words"))


def style_histogram(cues: DataFrame, style: Column, track: str = "track_id") -> DataFrame:
    """Cues and tracks of every style."""
    return cues.groupBy(style.alias("style")).agg(F.count("*").alias("cues"), F.count_distinct(track).alias("tracks"))


def total_duration(cues: DataFrame, default: float = DEFAULT_SECONDS["fcpxml"], track: str = "track_id") -> DataFrame:
    """The latest end of a track, a default where it has no times."""
    return cues.groupBy(track).agg(F.coalesce(F.max(F.col("start") + F.col("duration")), F.lit(default)).alias("total"))


def speaker_places(cues: DataFrame, colors: int = COLORS, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """Speakers in order of first appearance, with their place and its colour in a palette."""
    first = cues.where("speaker <> ''").groupBy(track, "speaker").agg(F.min(position).alias("__first"))
    place = (F.row_number().over(Window.partitionBy(track).orderBy("__first")) - 1).cast("long")
    return first.withColumn("place", place).withColumn("color", F.col("place") % colors).drop("__first")


def with_gaps(cues: DataFrame, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """``gap`` from the end of the cue before."""
    return cues.withColumn("gap", F.col("start") - F.lag(F.col("start") + F.col("duration")).over(_order(track, position)))


def with_lead_duration(cues: DataFrame, last: float = LAST_LINE_SECONDS, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """``shown`` until the next cue begins, the last one for ``last`` seconds."""
    return cues.withColumn("shown", F.coalesce(F.lead("start").over(_order(track, position)) - F.col("start"), F.lit(last)))


def carried_forward(cues: DataFrame, column: str, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """``carried``: the last value of a column up to this cue that is not empty."""
    upto = _order(track, position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cues.withColumn("carried", F.last(named(F.col(column)), ignorenulls=True).over(upto))


def numbered(cues: DataFrame, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """``number`` from 1 with the ``marker`` and ``segment`` names made of it."""
    n = F.row_number().over(_order(track, position))
    return cues.withColumns({"number": n, "marker": F.format_string("Marker %03d", n), "segment": F.format_string("segment_%05d", n - 1)})
