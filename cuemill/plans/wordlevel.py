"""Queries of word-level operators; whole tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions import color
from cuemill.functions import text as T
from cuemill.operators import segments, words
from cuemill.plans.analysis import _SQUASH, _WORDS
from cuemill.plans.formats import _SOURCE, cues_of, positions_of
from cuemill.plans.timing import _CUES, _cues
from cuemill.session import table
from cuemill.sources import document_formats, text_formats

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = table(spark, sf_dir, "supervisions", "row_id", "track_id", "start", "duration", "text").where("start is not null and duration > 0 and text is not null and text <> ''")
    return segments.with_even_words(cues)


@query(f"""select row_id, list_reduce(list_prepend({{'at': 1, 'n': cast(0 as bigint), 'w': ''}}, list_transform(w, lambda x: {{'at': 0, 'n': cast(0 as bigint), 'w': x}})), lambda a, b:
 {{'at': case when instr(substring(t, a['at']), b['w']) > 0 then a['at'] + instr(substring(t, a['at']), b['w']) - 1 + length(b['w']) else a['at'] end,
 'n': a['n'] + case when instr(substring(t, a['at']), b['w']) > 0 then 1 else 0 end, 'w': b['w']}})['n'] as placed from (select row_id, {_SQUASH} t, {_WORDS} w from supervisions where start is not null and duration > 0 and text is not null and text <> '')""")
def j06_word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = F.transform("words", lambda w: w["symbol"])
    found = words.word_offsets(T.squash(F.col("text")), symbols)
    return _worded(spark, sf_dir).select("row_id", F.size(F.filter(found, lambda k: k > 0)).cast("long").alias("placed"))


@query(None)
def f78_karaoke_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worded(spark, sf_dir).select("row_id", words.karaoke_text(F.col("words")).alias("text"))


@query(f"select row_id, cast(len({_WORDS}) as bigint) syllables, array_to_string({_WORDS}, ' ') said from supervisions where start is not null and duration > 0 and text is not null and text <> '' and not contains(text, '{{')")
def f26_parse_karaoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The karaoke text of every cue, read back."""
    made = _worded(spark, sf_dir).where(~F.contains("text", F.lit("{"))).select("row_id", words.parse_karaoke(words.karaoke_text(F.col("words"))).alias("k"))
    return made.select("row_id", F.size("k").cast("long").alias("syllables"), F.array_join(F.transform("k", lambda s: F.trim(s["symbol"])), " ").alias("said"))


@query(f"""select row_id, string_agg(x, ' ' order by i) said, count(*) > 0 as whole from (select row_id, unnest({_WORDS}) x, generate_subscripts({_WORDS}, 1) i from supervisions where start is not null and duration > 0 and text is not null and text <> '') group by row_id""")
def w17_split_with_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces within both budgets; joined they give the text back."""
    pieces = words.split_with_words(_worded(spark, sf_dir), 24, 2.5)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), " ")
    fits = F.bool_and((F.length("text") <= 24) | ~F.contains("text", F.lit(" ")))
    return pieces.groupBy("row_id").agg(said.alias("said"), fits.alias("whole"))


@query(f"""with a as (select track_id, row_id id, {_SQUASH} t from supervisions), q as (select * from a where id % 50 = 0),
 s as (select q.track_id, q.id, a.id m, case when q.t = a.t then 1.0 else least(length(q.t), length(a.t)) / greatest(length(q.t), length(a.t)) end score from q join a on q.track_id = a.track_id and q.id <> a.id
  where q.t <> '' and a.t <> '' and (contains(q.t, a.t) or contains(a.t, q.t)))
 select track_id, id, cast(m as bigint) as "match", cast(floor(score * 1000 + 1e-6) as bigint) permille from s where score > 0.8 qualify row_number() over (partition by track_id, id order by score desc, m) = 1""")
def j04_match_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth cue as a query against all others of its track."""
    lines = table(spark, sf_dir, "supervisions", "track_id", "row_id", "text").select("track_id", F.col("row_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    out = words.match_texts(lines.where("id % 50 = 0"), lines)
    return out.select("track_id", "id", "match", F.floor(F.col("score") * 1000 + 1e-6).cast("long").alias("permille"))


@query(None)
def w14_event_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.event_tiers(_cues(spark, sf_dir))


@query(f"""with {_CUES} select track_id, cast(count(*) as bigint) cues, cast(sum(length(replace({_SQUASH}, ' ', ''))) as bigint) letters from cues where start is not null and duration is not null and {_SQUASH} <> '' group by track_id""")
def c05_split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every track, summed up: each cue lies in some, and no letter is lost."""
    cues = _cues(spark, sf_dir, "text", "speaker")
    sentences = words.split_sentences(cues)
    letters = sentences.groupBy("track_id").agg(F.sum(F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("long").alias("letters"))
    counted = cues.where(F.col("start").isNotNull() & F.col("duration").isNotNull() & (T.squash(F.coalesce("text", F.lit(""))) != "")).groupBy("track_id").agg(F.count("*").alias("cues"))
    return counted.join(letters, "track_id")


@query("select translation_id, translation as joined from markdown_segments where translation_id is not null and translation is not null")
def f39_split_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations in three slices by share; joined they are what they were."""
    lines = table(spark, sf_dir, "markdown_segments", "translation_id", "translation").where("translation_id is not null and translation is not null")
    parts = words.split_translation(F.col("translation"), F.array(F.lit(1.0), F.lit(2.0), F.lit(1.0)))
    return lines.select("translation_id", F.array_join(parts, "").alias("joined"))


@query("select row_id, case when start <= 120 and length(text) <= 50 and regexp_matches(lower(text), 'www\\.|\\.(?:com|tv|net|org)') then 'branding' end kind from supervisions where text is not null")
def f24_line_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supervisions", "row_id", "text", "start").where("text is not null").select("row_id", words.line_type(F.col("text"), F.coalesce("start", F.lit(999.0)), F.lit("")).alias("kind"))


@query(f"""select row_id, text <> '' and duration > 0.01 as alignable, coalesce(nullif(speaker, ''), '') <> '' as labelled, len({_WORDS}) >= 3 as long_enough from supervisions where text is not null and duration is not null""")
def xp10_alignable(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = table(spark, sf_dir, "supervisions", "row_id", "text", "duration", "speaker").where("text is not null and duration is not null")
    return cues.select("row_id", ((F.col("text") != "") & (F.col("duration") > 0.01)).alias("alignable"), (F.coalesce("speaker", F.lit("")) != "").alias("labelled"), (F.size(segments.words_of(F.col("text"))) >= 3).alias("long_enough"))


@query("select track_id, bool_or(translation <> '') has_translation, count(*) filter (translation <> '') as translated from markdown_segments group by track_id")
def xp08_has_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "markdown_segments", "track_id", "translation")
    return lines.groupBy("track_id").agg(F.bool_or(F.col("translation") != "").alias("has_translation"), F.count_if(F.col("translation") != "").alias("translated"))


def _word_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.with_even_words(positions_of(spark, sf_dir))


@query(None)
def k04_word_vtt_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_formats.write_word_vtt(_word_documents(spark, sf_dir)).select("doc_id", F.length("content").alias("chars"))


@query(None)
def k23_word_lrc_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_formats.write_word_lrc(_word_documents(spark, sf_dir)).select("doc_id", F.length("content").alias("chars"))


@query(None)
def k06_word_ass_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_formats.write_word_ass(_word_documents(spark, sf_dir)).select("doc_id", F.length("content").alias("chars"))


@query(
    "with " + _SOURCE + f""", w as (select *, {_WORDS} ws from cues where not contains(text, '<') and not contains(text, '>') and not contains(text, '&')),
 k as (select * from w where len(ws) > 1 and duration >= 0.02 * len(ws))
 select doc_id, cast(round_even(1000 * "start", 0) as bigint) first, cast(len(ws) as bigint) as "words", array_to_string(ws, ' ') said from k"""
)
def r03_word_vtt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-level documents of the cues its SQL names, read back with their words."""
    plain = cues_of(spark, sf_dir).where("not contains(text, '<') and not contains(text, '>') and not contains(text, '&')")
    cues = segments.with_even_words(plain).where("size(words) > 1 and duration >= 0.02 * size(words)")
    back = document_formats.read_word_vtt(text_formats.write_word_vtt(cues))
    return back.select("doc_id", F.rint(F.col("start") * 1000).cast("long").alias("first"), F.size("words").cast("long").alias("words"), F.col("text").alias("said"))
