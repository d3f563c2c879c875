"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.runs import event_runs
from cuemill.session import table


def p7_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_runs(table(spark, sf_dir, "supervisions", "track_id", "cue_idx", "start", "duration", "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_events(spark, sf_dir).where("events >= 2").select(
        "track_id", F.col("first_position").cast("int").alias("first_cue"), F.col("last_position").cast("int").alias("last_cue")
    )


QUERIES = {"p7_found": p7_found, "p7_events": p7_events}
