"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuemill.llm.sentences import corpus, sentence_ends
from cuemill.session import table


def tracks_of(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Distinct ids of tracks of the given kinds."""
    tracks = table(spark, sf_dir, "text_tracks", "track_id", "kind")
    return tracks.where(tracks["kind"].isin(*kinds)).select("track_id").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = table(spark, sf_dir, "supervisions", "row_id", "track_id", "cue_idx", "text")
    subtitles = cues.join(tracks_of(spark, sf_dir, "subtitles"), "track_id", "left_semi")
    return sentence_ends(subtitles, corpus(subtitles))


QUERIES = {"p5_found": p5_found}
