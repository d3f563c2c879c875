"""Queries of aggregations, windows, pairings, set operations and re-segmentation; whole tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.functions import text as T
from cuemill.operators import bilingual, cues, measures, segments
from cuemill.plans.timing import _CUES, _cues
from cuemill.session import table

_R = "cast(round_even(1000 * ({}), 0) as bigint)"
_ms = lambda c: F.rint(c * 1000).cast("long")
_TRACK = lambda: Window.partitionBy("track_id").orderBy("cue_idx")
_WS = r"[\s\x{00A0}\x{3000}\x{2000}-\x{200A}\x{202F}\x{0085}\x{1680}\x{2028}\x{2029}\x{205F}]+"
_SQUASH = f"trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g'))"
_WORDS = f"list_filter(string_split({_SQUASH}, ' '), lambda w: w <> '')"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


@query(f"with {_CUES} select track_id, {_R.format('arg_max(start, cue_idx) + arg_max(duration, cue_idx) - arg_min(start, cue_idx)')} span_ms, {_R.format('arg_min(start, cue_idx)')} first_ms from (select * from cues where start is not null and duration is not null) group by track_id")
def a01_track_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.span(_cues(spark, sf_dir)).select("track_id", _ms(F.col("span")).alias("span_ms"), _ms(F.col("start")).alias("first_ms"))


@query(f"with {_CUES} select track_id, {_R.format('max(start + duration)')} end_ms, count(*) num_segments, coalesce(list_sort(list_distinct(list(case when speaker <> '' then speaker end))), []) speakers from cues group by track_id")
def a02_document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _cues(spark, sf_dir, "speaker")
    return cues.groupBy("track_id").agg(_ms(F.max(F.col("start") + F.col("duration"))).alias("end_ms"), F.count("*").alias("num_segments"), F.array_sort(F.collect_set(F.when(F.col("speaker") != "", F.col("speaker")))).alias("speakers"))


@query("select track_id, speaker, count(*) lines, count(distinct cue_idx) cues from supervisions where speaker <> '' group by track_id, speaker")
def a03_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.speaker_counts(table(spark, sf_dir, "supervisions", "track_id", "cue_idx", "speaker"))


@query(f"select track_id, count(*) filter (len({_WORDS}) > 0) with_words, cast(sum(len({_WORDS})) as bigint) as words from supervisions group by track_id")
def a09_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.word_counts(table(spark, sf_dir, "supervisions", "track_id", "text"))


@query("select json_extract_string(custom, '$.ass_style') style, count(*) cues, count(distinct track_id) tracks from supervisions where custom is not null group by 1")
def a12_style_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = table(spark, sf_dir, "supervisions", "track_id", "custom").where("custom is not null")
    return measures.style_histogram(cues, F.get_json_object("custom", "$.ass_style"))


@query(f"with {_CUES} select track_id, coalesce({_R.format('max(start + duration)')}, 3600000) total_ms from cues group by track_id")
def a14_total_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.total_duration(_cues(spark, sf_dir)).select("track_id", _ms(F.col("total")).alias("total_ms"))


@query("select track_id, speaker, row_number() over (partition by track_id order by first_cue) - 1 as place, (row_number() over (partition by track_id order by first_cue) - 1) % 10 as color from (select track_id, speaker, min(cue_idx) first_cue from supervisions where speaker <> '' group by 1, 2)")
def w21_speaker_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers in order of first appearance with their place in a palette of ten."""
    return measures.speaker_places(table(spark, sf_dir, "supervisions", "track_id", "cue_idx", "speaker"))


@query(f"with {_CUES} select row_id, coalesce(speaker, '') <> '' and speaker is distinct from lag(speaker) over (partition by track_id order by cue_idx) as is_new from cues")
def w05_speaker_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.new_speaker(_cues(spark, sf_dir, "speaker")).select("row_id", F.col("new_speaker").alias("is_new"))


@query(f"with {_CUES} select row_id, printf('Marker %03d', row_number() over w) marker, printf('segment_%05d', row_number() over w - 1) segment from cues window w as (partition by track_id order by cue_idx)")
def w22_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.numbered(_cues(spark, sf_dir)).select("row_id", "marker", "segment")


@query(f"with {_CUES} select row_id, last_value(speaker ignore nulls) over (partition by track_id order by cue_idx rows unbounded preceding) carried from (select * replace (nullif(speaker, '') as speaker) from cues)")
def w11_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.carried_forward(_cues(spark, sf_dir, "speaker"), "speaker").select("row_id", "carried")


@query(f"""with {_CUES}, m as (select *, case when speaker is not distinct from lag(speaker) over w and start - lag(start + duration) over w <= 2.0 then 0 else 1 end opens
 from cues where start is not null and duration is not null window w as (partition by track_id order by start, cue_idx)),
 r as (select *, sum(opens) over (partition by track_id order by start, cue_idx rows unbounded preceding) run from m)
 select track_id, {_R.format('min(start)')} start_ms, {_R.format('max(start + duration)')} end_ms, max(speaker) speaker, count(*) merged, string_agg(coalesce(text, ''), ' ' order by start, cue_idx) as text from r group by track_id, run""")
def w13_merge_same_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.merge_same_speaker(_cues(spark, sf_dir, "speaker", "text"))
    return out.select("track_id", _ms(F.col("start")).alias("start_ms"), _ms(F.col("end")).alias("end_ms"), "speaker", "merged", "text")


@query(f"""select row_id, cast(i - 1 as integer) word_idx, w[i] as word, {_R.format('start + (i - 1) * (duration / len(w))')} start_ms
 from (select row_id, start, duration, {_WORDS} w from supervisions where duration > 0 and start is not null) t, unnest(range(1, len(w) + 1)) u(i)""")
def g01_expand_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = table(spark, sf_dir, "supervisions", "row_id", "start", "duration", "text").where("duration > 0 and start is not null")
    out = segments.expand_words(segments.with_even_words(cues)).where("word_idx is not null")
    return out.select("row_id", "word_idx", F.col("text").alias("word"), _ms(F.col("start")).alias("start_ms"))


_CHUNK = "list_reduce(list_transform({w}, lambda w: [w]), lambda a, b: case when length(a[-1]) + 1 + length(b[1]) <= {n} then list_concat(a[:-2], [a[-1] || ' ' || b[1]]) else list_concat(a, b) end)"


@query(f"""with c as (select row_id, start, duration, speaker, trim(coalesce(text, '')) body, {_WORDS} w from supervisions),
 p as (select row_id, start, duration, speaker, case when length(body) <= 60 then [body] else {_CHUNK.format(w='w', n=60)} end parts from c)
 select row_id, cast(i - 1 as integer) part, case when i = 1 then speaker end speaker, {_R.format('start + (i - 1) * (duration / len(parts))')} start_ms, length(replace(parts[i], chr(10), ' ')) chars
 from p, unnest(range(1, len(parts) + 1)) u(i)""")
def g02_split_long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = table(spark, sf_dir, "supervisions", "row_id", "start", "duration", "speaker", "text")
    body = F.trim(F.coalesce("text", F.lit("")))
    parts = F.when(F.length(body) <= 60, F.array(body)).otherwise(T.chunks(body, 60))
    cut = cues.withColumn("parts", parts).select("row_id", "start", "duration", "speaker", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "piece"))
    return cut.select("row_id", "part", F.when(F.col("part") == 0, F.col("speaker")).alias("speaker"), _ms(F.col("start") + F.col("part") * (F.col("duration") / F.col("n"))).alias("start_ms"), F.length(F.replace("piece", F.lit("\n"), F.lit(" "))).alias("chars"))


def g04_split_long_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = table(spark, sf_dir, "supervisions", "row_id", "start", "duration", "text").where("start is not null and duration > 0")
    return segments.split_long_cues(cues, 42, 4.0).select("row_id", "part", _ms(F.col("start")).alias("start_ms"), "text")


QUERIES["g04_split_long_cues"] = g04_split_long_cues


@query("select seg_id, 'primary' side, text said from markdown_segments where text <> '' union all select seg_id, 'secondary', translation from markdown_segments where translation <> ''")
def g08_bilingual_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.extract_sides(table(spark, sf_dir, "markdown_segments", "seg_id", "text", "translation"))
    return out.select("seg_id", "side", F.col("text").alias("said"))


@query(f"with {_CUES} select row_id, split_part(text, chr(10), 1) as text, case when contains(text, chr(10)) then substring(text, instr(text, chr(10)) + 1) end translation from cues")
def c06_merge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.merge_lines(_cues(spark, sf_dir, "text")).select("row_id", "text", "translation")


@query(f"""with {_CUES}, m as (select *, case when abs(start - lag(start) over w) <= 0.01 and abs(duration - lag(duration) over w) <= 0.01 then 0 else 1 end opens from cues window w as (partition by track_id order by cue_idx)),
 r as (select *, sum(opens) over (partition by track_id order by cue_idx rows unbounded preceding) run from m),
 n as (select *, row_number() over (partition by track_id, run order by cue_idx) - 1 nth from r)
 select track_id, min(cue_idx) cue_idx, max(case when nth % 2 = 0 then text end) as text, max(case when nth % 2 = 1 then text end) translation from n group by track_id, run, nth // 2""")
def j05_merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.merge_pairs(_cues(spark, sf_dir, "text")).select("track_id", "cue_idx", "text", "translation")


@query(f"""with {_CUES}, a as (select track_id, cue_idx, start + 1 s2, duration * 0.5 d2 from cues where cue_idx % 3 = 0)
 select row_id, {_R.format('coalesce(s2, start)')} start_ms, {_R.format('coalesce(d2, duration)')} duration_ms from cues left join a using (track_id, cue_idx)""")
def j02_apply_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _cues(spark, sf_dir)
    aligned = cues.where("cue_idx % 3 = 0").select("track_id", "cue_idx", (F.col("start") + 1).alias("start"), (F.col("duration") * 0.5).alias("duration"))
    out = segments.apply_alignment(cues, aligned, ["track_id", "cue_idx"])
    return out.select("row_id", _ms(F.col("start")).alias("start_ms"), _ms(F.col("duration")).alias("duration_ms"))


@query("select track_id, regexp_extract(text, '^([A-Z][a-zA-Z\\x{00C0}-\\x{024F}''-]+(?:\\s+[A-Z][a-zA-Z\\x{00C0}-\\x{024F}''-]+){0,3})[:：]\\s+', 1) as name, count(*) as lines from supervisions where regexp_matches(text, '^([A-Z][a-zA-Z\\x{00C0}-\\x{024F}''-]+(?:\\s+[A-Z][a-zA-Z\\x{00C0}-\\x{024F}''-]+){0,3})[:：]\\s+') group by 1, 2 having count(*) >= 2")
def a07_speaker_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.frequent_names(table(spark, sf_dir, "supervisions", "track_id", "text"), 2)


@query("select s.row_id from supervisions s where s.speaker in (select full_name from speakers)")
def j08_candidate_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "speakers", F.col("full_name").alias("speaker"))
    return segments.by_candidates(table(spark, sf_dir, "supervisions", "row_id", "speaker"), people, exact=True).select("row_id")


@query("select t.track_id from (select distinct track_id from text_tracks) t where not exists (select 1 from validation_results v where v.track_id = t.track_id)")
def j10_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_tracks", "track_id").distinct().join(table(spark, sf_dir, "validation_results", "track_id"), "track_id", "left_anti")


@query("select track_id, cue_idx, count(*) copies from supervisions group by 1, 2 having count(*) > 1")
def s_repeated_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supervisions", "track_id", "cue_idx").groupBy("track_id", "cue_idx").agg(F.count("*").alias("copies")).where("copies > 1")


@query("select track_id, row_id, cast(place as integer) place from (select track_id, row_id, row_number() over (partition by track_id order by duration desc, row_id) place from supervisions where duration is not null) where place <= 3")
def s05_longest_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest cues of each track: a top-k report."""
    held = table(spark, sf_dir, "supervisions", "track_id", "row_id", "duration").where("duration is not null")
    order = Window.partitionBy("track_id").orderBy(F.desc("duration"), "row_id")
    return held.withColumn("place", F.row_number().over(order)).where("place <= 3").drop("duration")


@query("select track_id from supervisions intersect select track_id from validation_results")
def u04_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supervisions", "track_id").intersect(table(spark, sf_dir, "validation_results", "track_id"))


@query("select track_id, 'cue' as what, cue_idx as place, text from supervisions union all select track_id, 'line', line_number, text from markdown_segments")
def u01_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = table(spark, sf_dir, "supervisions").select("track_id", F.lit("cue").alias("what"), F.col("cue_idx").alias("place"), "text")
    return cues.unionByName(table(spark, sf_dir, "markdown_segments").select("track_id", F.lit("line").alias("what"), F.col("line_number").alias("place"), "text"))


@query("select kind, source_format, count(*) tracks, grouping_id(kind, source_format) level from text_tracks group by rollup(kind, source_format)")
def a_rollup_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_tracks", "kind", "source_format").rollup("kind", "source_format").agg(F.count("*").alias("tracks"), F.grouping_id().alias("level"))


@query("select user_id, event_type, date_trunc('hour', ts) as \"hour\", count(*) n, cast(round_even(sum(value * 100), 0) as bigint) cents from events group by 1, 2, 3")
def t_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the streaming activity windows."""
    events = table(spark, sf_dir, "events", "user_id", "event_type", "ts", "value")
    return events.groupBy("user_id", "event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.rint(F.sum(F.col("value") * 100)).cast("long").alias("cents"))


def a05_bilingual_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilingual.bilingual_mode(_cues(spark, sf_dir, "text")).select("track_id", "mode")


QUERIES["a05_bilingual_mode"] = a05_bilingual_mode
