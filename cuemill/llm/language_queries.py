"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.encoding_queries import profiles
from cuemill.llm.language import classify, foreign_cues, label_cases, mixed_segments, stretches, track_languages
from cuemill.session import cut, table


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = table(spark, sf_dir, "supervisions", "row_id", "track_id", "cue_idx", "text")
    return cut(classify(cues, profiles(spark, sf_dir), "row_id", "track_id", "cue_idx"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _classified(spark, sf_dir)
    languages = track_languages(cues)
    tracks = label_cases(cues, table(spark, sf_dir, "text_tracks", "track_id", "language", "ingested_at"), languages)
    foreign = foreign_cues(cues, languages)
    return tracks.select(F.lit("track").alias("level"), F.col("track_id").alias("item_id"), "lang").unionAll(
        foreign.select(F.lit("cue").alias("level"), F.col("row_id").alias("item_id"), "lang")
    )


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every track (no positions) and of every foreign stretch."""
    cues = _classified(spark, sf_dir)
    languages = track_languages(cues)
    runs = stretches(foreign_cues(cues, languages))
    return languages.select(
        "track_id", F.lit(None).cast("int").alias("first_cue"), F.lit(None).cast("int").alias("last_cue"), "lang", "confidence", "cues"
    ).unionAll(runs.select("track_id", "first_cue", "last_cue", "lang", "confidence", "cues"))


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_segments(table(spark, sf_dir, "supervisions", "row_id", "text"), profiles(spark, sf_dir))


QUERIES = {"p6_segments": p6_segments, "p6_found": p6_found, "p6_languages": p6_languages}
