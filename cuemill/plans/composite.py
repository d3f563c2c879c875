"""Queries of composite operators; whole tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.operators import pipelines
from cuemill.plans.timing import _CUES, _cues
from cuemill.session import table


def c01_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipelines.standardize(_cues(spark, sf_dir, "speaker", "text"))
    return out.select("track_id", "cue_idx", "part", F.rint(F.col("start") * 1000).cast("long").alias("start_ms"), F.rint(F.col("duration") * 1000).cast("long").alias("duration_ms"), "text")


def a04_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.warnings(_cues(spark, sf_dir, "text"))


def xp06_set_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cue's text written in as its own translation."""
    cues = _cues(spark, sf_dir, "text")
    return pipelines.set_translations(cues, cues.select("track_id", "cue_idx", F.concat(F.lit("~ "), "text").alias("translation")), "en").select("row_id", "translation")


def k25_renewed_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "markdown_segments", "seg_id", "text", "timestamp").where("text is not null and (timestamp is null or timestamp >= 0)")
    return lines.select("seg_id", pipelines.renew_stamp(F.col("text"), F.col("timestamp")).alias("line"))


QUERIES = {f.__name__: f for f in (c01_standardize, a04_warnings, xp06_set_translations, k25_renewed_stamps)}
_STAMP = "printf('[%02d:%02d:%02d]', cast(floor(timestamp) as bigint) // 3600, (cast(floor(timestamp) as bigint) % 3600) // 60, cast(floor(timestamp) as bigint) % 60)"
_P = r"\[\d{1,2}:\d{2}(?::\d{2})?(?:\.\d{1,3})?\]"
ORACLES = {
    "a04_warnings": f"""with {_CUES}, f as (select track_id, cue_idx, duration, start - lag(start + duration) over (partition by track_id order by cue_idx) gap,
 list_max(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x))) cpl, case when duration > 0 then length(replace(coalesce(text, ''), chr(10), '')) / duration else 0 end cps
 from cues where start is not null and duration is not null)
 select track_id, cue_idx, 'short' as what from f where duration < 0.8 union all select track_id, cue_idx, 'long' from f where duration > 7
 union all select track_id, cue_idx, 'gap' from f where gap >= 0 and gap < 0.08 - 1e-6 union all select track_id, cue_idx, 'line' from f where cpl > 42
 union all select track_id, cue_idx, 'speed' from f where cps > 25.5""",
    "xp06_set_translations": f"with {_CUES} select row_id, '~ ' || text as translation from cues",
    "k25_renewed_stamps": f"""select seg_id, case when timestamp is null then text when regexp_matches(text, '{_P}') then regexp_replace(text, '{_P}', {_STAMP}) else text || ' ' || {_STAMP} end as line
 from markdown_segments where text is not null and (timestamp is null or timestamp >= 0)""",
}
