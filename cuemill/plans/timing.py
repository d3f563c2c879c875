"""Queries over time: projections, overlaps, margins, validation; whole tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.operators import cues, measures, segments, timing
from cuemill.session import table

MS = lambda c: F.rint(F.col(c) * 1000).cast("long")


def _cues(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Every position of a track once."""
    cues = table(spark, sf_dir, "supervisions", "track_id", "cue_idx", "row_id", "start", "duration", *more)
    first = Window.partitionBy("track_id", "cue_idx").orderBy("row_id")
    return cues.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


_CUES = "cues as (select * from supervisions qualify row_number() over (partition by track_id, cue_idx order by row_id) = 1)"


def _ms_of(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, MS("start").alias("start_ms"), MS("duration").alias("duration_ms"))


def p01_filter_by_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supervisions", "row_id", "track_id", "speaker").where("speaker is not null and speaker <> ''")


def p02_shift_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ms_of(cues.shift_time(table(spark, sf_dir, "supervisions", "row_id", "start", "duration"), -30.0), "row_id")


def p03_apply_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ms_of(cues.timecode_offset(table(spark, sf_dir, "supervisions", "row_id", "start", "duration"), 3600.0), "row_id")


def p05_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timing.trim(table(spark, sf_dir, "supervisions", "row_id", "start", "duration"), 60.0, 10.0)
    return out.select("row_id", MS("start").alias("start_ms"), F.rint(F.col("duration") * 48000).cast("long").alias("duration_samples"))


def p12_valid_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supervisions", "row_id", "start", "duration").where("start is not null and duration > 0").select("row_id")


def p13_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supervisions", "row_id", "text").where(segments.is_event(F.col("text"))).select("row_id")


def p14_custom_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "supervisions", "row_id", "custom").where("custom is not null")
    return held.select("row_id", cues.custom_get(F.from_json("custom", "map<string,string>"), "ass_style").alias("style"))


def p16_include_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = cues.include_speaker(True, F.col("speaker"), F.get_json_object("custom", "$.original_speaker").cast("boolean"))
    return table(spark, sf_dir, "supervisions", "row_id", "speaker", "custom").select("row_id", shown.alias("shown"))


def p20_derived_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "supervisions", "row_id", "start", "duration").withColumn("end", cues.derived_end(F.col("start"), F.col("duration")))
    return ends.select("row_id", MS("end").alias("end_ms"))


def j01_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.overlap_pairs(_cues(spark, sf_dir))


def w02_trim_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ms_of(timing.trim_overlaps(_cues(spark, sf_dir)), "row_id")


def w03_overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.overlap_groups(_cues(spark, sf_dir)).select("row_id", F.col("group").cast("long").alias("grp"))


def a08_merge_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = timing.merge_overlaps(_cues(spark, sf_dir, "text", "speaker"))
    return merged.select("track_id", F.col("group").cast("long").alias("grp"), MS("start").alias("start_ms"), MS("end").alias("end_ms"), "merged", "speaker", "text")


def w01_sanitize_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.sanitize_timeline(_cues(spark, sf_dir))


def c02_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timing.validate(_cues(spark, sf_dir, "text"))
    return out.withColumn("avg_cps", F.rint(F.col("avg_cps") * 1000).cast("long"))


def w09_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.with_gaps(_cues(spark, sf_dir)).select("row_id", MS("gap").alias("gap_ms"))


def w06_lead_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.with_lead_duration(_cues(spark, sf_dir)).select("row_id", MS("shown").alias("shown_ms"))


def w04_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _cues(spark, sf_dir).where("start is not null and duration > 0").select("track_id", "cue_idx", "row_id", (F.col("start") + 0.1).alias("first_word"), (F.col("start") + F.col("duration") - 0.05).alias("last_word"))
    out = timing.with_margins(words, 0.08, 0.2)
    return out.select("row_id", F.rint(F.col("new_start") * 1000).cast("long").alias("start_ms"), F.rint(F.col("new_end") * 1000).cast("long").alias("end_ms"))


_ISLANDS = """
, reached as (select *, max(start + duration) over (partition by track_id order by start, cue_idx rows between unbounded preceding and 1 preceding) reach
  from cues where start is not null and duration is not null
), grouped as (select *, sum(case when start < reach then 0 else 1 end) over (partition by track_id order by start, cue_idx rows unbounded preceding) grp from reached)
"""

QUERIES = {
    f.__name__: f
    for f in (
        p01_filter_by_speaker, p02_shift_time, p03_apply_offset, p05_trim, p12_valid_cues, p13_events, p14_custom_field, p16_include_speaker, p20_derived_end,
        j01_overlap_pairs, w02_trim_overlaps, w03_overlap_groups, a08_merge_overlaps, w01_sanitize_timeline, c02_validate, w09_gaps, w06_lead_durations, w04_margins,
    )
}
# p1_.. to p10_.. name the dealt problems, so projections carry an x
QUERIES = {(f"x{k}" if k.startswith("p") else k): v for k, v in QUERIES.items()}
_R = "cast(round_even(1000 * ({}), 0) as bigint)"
ORACLES = {
    "xp01_filter_by_speaker": "select row_id, track_id, speaker from supervisions where speaker is not null and speaker <> ''",
    "xp02_shift_time": f"select row_id, {_R.format('greatest(0, start - 30)')} start_ms, {_R.format('case when start - 30 < 0 then start + duration - 30 else duration end')} duration_ms from supervisions where start + duration - 30 > 0",
    "xp03_apply_offset": f"select row_id, {_R.format('start + 3600')} start_ms, {_R.format('duration')} duration_ms from supervisions",
    "xp05_trim": f"""select row_id, case when start is null then 10000 else {_R.format('greatest(10, start)')} end start_ms,
 cast(round_even(duration * 48000, 0) as bigint) + cast(round_even(-greatest(0, 10 - start) * 48000, 0) as bigint) + cast(round_even(-greatest(0, start + duration - 60) * 48000, 0) as bigint) duration_samples from supervisions""",
    "xp12_valid_cues": "select row_id from supervisions where start is not null and duration > 0",
    "xp13_events": "select row_id from supervisions where regexp_matches(trim(text), '(?s)^\\[.*\\]$')",
    "xp14_custom_field": "select row_id, json_extract_string(custom, '$.ass_style') style from supervisions where custom is not null",
    "xp16_include_speaker": "select row_id, coalesce(speaker, '') <> '' and coalesce(cast(json_extract_string(custom, '$.original_speaker') as boolean), true) shown from supervisions",
    "xp20_derived_end": f"select row_id, {_R.format('start + duration')} end_ms from supervisions",
    "j01_overlap_pairs": f"""with {_CUES} select a.track_id, a.cue_idx as first, b.cue_idx as second from cues a join cues b on a.track_id = b.track_id
 and (b.start > a.start or b.start = a.start and b.cue_idx > a.cue_idx) and b.start < a.start + a.duration where b.duration is not null""",
    "w02_trim_overlaps": f"""with {_CUES} {_ISLANDS}, ahead as (select *, lead(start) over (partition by track_id, grp order by start, cue_idx) nxt from grouped)
select row_id, {_R.format('start')} start_ms, {_R.format('case when nxt is null then duration else least(duration, greatest(0.05, nxt - start - 0.05)) end')} duration_ms from ahead""",
    "w03_overlap_groups": f"with {_CUES} {_ISLANDS} select row_id, cast(grp as bigint) grp from grouped",
    "a08_merge_overlaps": f"""with {_CUES} {_ISLANDS} select track_id, cast(grp as bigint) grp, {_R.format('min(start)')} start_ms, {_R.format('max(start + duration)')} end_ms, count(*) merged,
 case when count(distinct speaker) = 1 then max(speaker) end speaker,
 case when count(*) = 1 then max(text) else string_agg(case when coalesce(speaker, '') <> '' then '- ' || speaker || ': ' || coalesce(text, '') else '- ' || coalesce(text, '') end, chr(10) order by start, cue_idx) end as text
 from grouped group by track_id, grp""",
    "c02_validate": f"""with {_CUES}, facts as (select track_id, duration, case when duration > 0 then length(replace(coalesce(text, ''), chr(10), '')) / duration else 0 end cps,
 list_max(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x))) cpl,
 start - lag(start + duration) over (partition by track_id order by cue_idx) gap from cues where start is not null and duration is not null)
select track_id, {_R.format('avg(cps)')} avg_cps, max(cpl) max_cpl, count(*) filter (duration < 0.8) segments_too_short, count(*) filter (duration > 7) segments_too_long,
 count(*) filter (gap >= 0 and gap < 0.08 - 1e-6) gaps_too_small,
 count(*) filter (duration < 0.8) = 0 and count(*) filter (duration > 7) = 0 and count(*) filter (gap >= 0 and gap < 0.08 - 1e-6) = 0 as valid from facts group by track_id""",
    "w09_gaps": f"with {_CUES} select row_id, {_R.format('start - lag(start + duration) over (partition by track_id order by cue_idx)')} gap_ms from cues",
    "w06_lead_durations": f"with {_CUES} select row_id, {_R.format('coalesce(lead(start) over (partition by track_id order by cue_idx) - start, 5.0)')} shown_ms from cues",
    "w04_margins": f"""with {_CUES}, w as (select row_id, track_id, cue_idx, start + 0.1 fw, start + duration - 0.05 lw from cues where start is not null and duration > 0),
e as (select *, greatest(0.0, fw - 0.08) ns, lw + 0.2 ne, lag(lw + 0.2) over (partition by track_id order by fw, cue_idx) prior from w)
select row_id, {_R.format('case when prior > ns then least(prior, fw) else ns end')} start_ms, {_R.format('ne')} end_ms from e""",
    "w01_sanitize_timeline": f"""with recursive {_CUES}, base as (
 select track_id, cue_idx, {_R.format('start')} s, {_R.format('duration')} d from cues where start is not null and duration is not null
), ranked as (select *, row_number() over w rn, lead(s) over w n from base window w as (partition by track_id order by s, cue_idx)
), walk as (
 select track_id, rn, cue_idx, s, case when d < 800 then case when n is null then 800 else least(800, greatest(n - s - 80, d)) end else d end d, cast(null as bigint) cut from ranked where rn = 1
 union all
 select track_id, rn, cue_idx, s, case when l < 800 then case when n is null then 800 else least(800, greatest(n - s - 80, l)) end else l end, cut
 from (select r.track_id, r.rn, r.cue_idx, r.n,
   case when r.s - (w.s + w.d) < 80 and r.s - 80 - w.s < 800 then w.s + w.d + 80 else r.s end s,
   case when r.s - (w.s + w.d) < 80 and r.s - 80 - w.s < 800 then greatest(100, r.d - (w.s + w.d + 80 - r.s)) else r.d end l,
   case when r.s - (w.s + w.d) < 80 and r.s - 80 - w.s >= 800 then r.s - 80 - w.s end cut
  from walk w join ranked r on r.track_id = w.track_id and r.rn = w.rn + 1) x
)
select track_id, cue_idx, s as start_ms, coalesce(lead(cut) over (partition by track_id order by rn), d) as duration_ms from walk""",
}
