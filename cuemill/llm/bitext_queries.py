"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuemill.llm.bitext import align
from cuemill.llm.sentences_queries import tracks_of
from cuemill.session import table


def p4_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "markdown_segments", "track_id", "line_number", "seg_id", "text", "translation", "translation_id")
    return align(segments.join(tracks_of(spark, sf_dir, "bilingual"), "track_id", "left_semi"), table(spark, sf_dir, "lexicon"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_alignment(spark, sf_dir).select("seg_id", "translation_id")


QUERIES = {"p4_found": p4_found, "p4_alignment": p4_alignment}
