"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuemill.llm.compress import Profiles
from cuemill.llm.encoding import find_garbled, fit, garbled_keys
from cuemill.session import table


def profiles(spark: SparkSession, sf_dir: str, leads: bool = True) -> Profiles:
    return fit(table(spark, sf_dir, "supervisions", "text", "language"), table(spark, sf_dir, "lexicon"), leads)


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(table(spark, sf_dir, "supervisions", "row_id", "text"), profiles(spark, sf_dir, leads=False))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_keys(table(spark, sf_dir, "supervisions", "row_id", "text"), profiles(spark, sf_dir, leads=False))


QUERIES = {"p2_found": p2_found, "p2_restored": p2_restored}
