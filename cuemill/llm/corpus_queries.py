"""Queries of problems 8, 9 and 10."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.mixing import mix
from cuemill.llm.packing import Capacity, containers, pack
from cuemill.llm.reading import profile, reading_levels
from cuemill.llm.tokens import with_tokens
from cuemill.session import cut, table

KIND = "base_window"


def capacity(spark: SparkSession, sf_dir: str, kind: str = KIND) -> Capacity:
    """Limits of a kind: its tokens, a document for 64 of them, and three quarters of the attention one full document costs."""
    tokens = table(spark, sf_dir, "containers").where(F.col("container_kind") == kind).agg(F.max("capacity_tokens")).first()[0]
    return Capacity(int(tokens), max(1, int(tokens) // 64), 0.75 * float(tokens) ** 2)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = capacity(spark, sf_dir)
    sized = with_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    return containers(pack(sized, "doc_id", "tokens", cap), cap)


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed, and containers beyond a limit (a full document may cost more attention alone)."""
    cap = capacity(spark, sf_dir)
    packed = cut(pack(with_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id"), "doc_id", "tokens", cap))
    over = containers(packed, cap).where("fill > 1 or documents > 1 or (attention > 1 and pieces > 1)").agg(F.count("*").alias("over_limit"))
    return packed.agg(F.count_distinct("item").alias("documents")).crossJoin(over)  # one row each


def _mixed(spark: SparkSession, sf_dir: str, **how: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mix(with_tokens(docs, "doc_id", "source"), table(spark, sf_dir, "source_targets"), **how)


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p9_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[2]


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mixture of given entropy (nine tenths of the most six sources can have)."""
    sources = table(spark, sf_dir, "source_targets").count()
    return _mixed(spark, sf_dir, wanted_entropy=0.9 * math.log(max(2, sources)))[1]


def p9_within_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and weights by source: weights equal the targets unless repeats forbid it, and none uses a record too often."""
    shares = cut(_mixed(spark, sf_dir)[1])
    return shares.where("target_share is not null").select(
        "source", F.round("target_share", 6).alias("target_share"), "max_repeats",
        (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"),
        (F.abs(F.col("reached_share") - F.col("weight")) < 0.01).alias("reached"),
    )


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return reading_levels(docs, table(spark, sf_dir, "reading_labels", "doc_id", "grade"))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(cut(_levels(spark, sf_dir)))


def p10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and those with a level, by clean source and language."""
    return _levels(spark, sf_dir).groupBy(F.lower(F.trim("source")).alias("source"), "lang").agg(F.count("*").alias("documents"), F.count("level").alias("levels"))


QUERIES = {
    "p8_containers": p8_containers, "p8_kept": p8_kept, "p9_selection": p9_selection, "p9_shares": p9_shares, "p9_schedule": p9_schedule,
    "p9_tempered": p9_tempered, "p9_within_caps": p9_within_caps, "p10_levels": p10_levels, "p10_profile": p10_profile, "p10_counts": p10_counts,
}
ORACLES = {
    "p8_kept": "select count(distinct doc_id) filter (where length(text) > 0) documents, 0::bigint over_limit from documents",
    "p9_within_caps": "select lower(trim(source)) source, round(target_share, 6) target_share, max_repeats, true within_repeats, true reached from source_targets where target_share is not null",
    "p10_counts": "select lower(trim(source)) source, lang, count(*) documents, count(*) filter (where regexp_matches(text, '\\p{L}')) levels from documents group by all",
}
