"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.sentences_queries import tracks_of
from cuemill.llm.turns import turns
from cuemill.session import table


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of transcript tracks of both tables in one shape."""
    ids = tracks_of(spark, sf_dir, "transcript")
    cues = table(spark, sf_dir, "supervisions", "track_id", "cue_idx", "start", "duration", "text", "speaker").select(
        F.col("track_id").alias("track"), F.col("cue_idx").cast("long").alias("line"), F.lit(False).alias("header"),
        "start", (F.col("start") + F.col("duration")).alias("stop"), "text", "speaker",
    )
    segments = table(spark, sf_dir, "markdown_segments", "track_id", "line_number", "segment_type", "timestamp", "end_timestamp", "text", "speaker").select(
        F.col("track_id").alias("track"), F.col("line_number").cast("long").alias("line"),
        F.coalesce(F.col("segment_type") == "section_header", F.lit(False)).alias("header"),
        F.col("timestamp").alias("start"), F.coalesce("end_timestamp", "timestamp").alias("stop"), "text", "speaker",
    )
    return cues.unionAll(segments).join(ids.withColumnRenamed("track_id", "track"), "track", "left_semi")


def p3_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by time, split at pauses beyond the track's own."""
    return turns(transcript_lines(spark, sf_dir), table(spark, sf_dir, "speakers"), by_time=True, split_at_pauses=True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by position, which pauses do not end."""
    return turns(transcript_lines(spark, sf_dir), table(spark, sf_dir, "speakers")).select("track_id", F.col("first_line").cast("int").alias("first_line"), F.col("last_line").cast("int").alias("last_line"), "speaker_id")


QUERIES = {"p3_found": p3_found, "p3_turns": p3_turns}
