"""Cues as a container: selection, offsets and trims with their words, custom fields, dictionaries, user functions.

Words are ``array<struct<symbol, start, duration[, score]>>`` in the column ``words``; a frame
without that column is handled without it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.functions.vectorised import vectorised

GRID = 48_000
# Formats that write words where there are any, unless told otherwise; the others that can, do so on demand.
LOSSLESS = frozenset(("json", "textgrid"))
NO_WORDS = frozenset(("sbv", "csv", "tsv", "aud", "txt", "avid_ds", "audition_csv", "edimarker_csv", "markdown", "md", "gemini"))
FIELDS = ("id", "recording_id", "start", "duration", "channel", "text", "language", "speaker", "gender", "score", "translation", "target_lang", "custom", "words")


def grid_sum(*seconds: Column) -> Column:
    """A sum of seconds, each first put on the grid of 1/48,000."""
    total = F.lit(0)
    for s in seconds:
        total = total + F.bround(s * GRID).cast("long")
    return total / GRID


def filter_by_speaker(cues: DataFrame, speaker: str) -> DataFrame:
    """Cues of exactly this speaker."""
    return cues.where(F.col("speaker") == F.lit(speaker))


def has_translation(cues: DataFrame, track: str = "track_id") -> DataFrame:
    """Per track whether any cue has a translation."""
    return cues.groupBy(track).agg(F.coalesce(F.bool_or(F.length("translation") > 0), F.lit(False)).alias("has_translation"))


def include_speaker(include: bool, speaker: Column, original_speaker: Column) -> Column:
    """Whether a writer puts the speaker before the text: wanted, given, and not marked as added later."""
    return F.lit(include) & F.coalesce(speaker != "", F.lit(False)) & F.coalesce(original_speaker, F.lit(True))


def custom_get(custom: Column, key: str) -> Column:
    return F.try_element_at(custom, F.lit(key))


def custom_set(custom: Column, key: str, value: Column) -> Column:
    """A map with one field set; a null value takes the field away."""
    rest = F.map_filter(F.coalesce(custom, F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), value.cast("string"))))


def custom_drop(custom: Column, *keys: str) -> Column:
    return F.map_filter(custom, lambda k, _: ~k.isin(*keys))


def _with_words(cues: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    return cues.withColumn("words", F.transform("words", change)) if "words" in cues.columns else cues


def with_offset(cues: DataFrame, seconds: float) -> DataFrame:
    """Starts moved, rounded to eight digits; words stay where they are."""
    return cues.withColumn("start", F.bround(F.col("start") + F.lit(float(seconds)), 8))


def words_with_offset(cues: DataFrame, seconds: float) -> DataFrame:
    """Words moved on the grid; cues stay where they are."""
    return _with_words(cues, lambda w: w.withField("start", grid_sum(w["start"], F.lit(float(seconds)))))


def timecode_offset(cues: DataFrame, seconds: float) -> DataFrame:
    """Cues and words moved by a plain sum; nothing is clipped."""
    moved = cues.withColumn("start", F.col("start") + F.lit(float(seconds)))
    return _with_words(moved, lambda w: w.withField("start", w["start"] + F.lit(float(seconds))))


def shift_time(cues: DataFrame, seconds: float) -> DataFrame:
    """Cues and words moved; what ends by 0 is dropped, what begins before 0 begins there."""
    s = F.lit(float(seconds))
    start, end = F.col("start") + s, F.col("start") + F.col("duration") + s
    moved = cues.where(end > 0).withColumns({"start": F.greatest(start, F.lit(0.0)), "duration": end - F.greatest(start, F.lit(0.0))})
    if "words" not in cues.columns:
        return moved
    kept = F.filter("words", lambda w: w["start"] + w["duration"] + s > 0)
    return moved.withColumn("words", F.transform(kept, lambda w: w.withField("duration", w["start"] + w["duration"] + s - F.greatest(w["start"] + s, F.lit(0.0))).withField("start", F.greatest(w["start"] + s, F.lit(0.0)))))


def _trimmed(start: Column, duration: Column, low: float, high: float) -> tuple[Column, Column]:
    before = F.greatest(F.lit(low) - start, F.lit(0.0))
    behind = F.greatest(F.bround(start + duration, 8) - F.lit(high), F.lit(0.0))
    return F.greatest(start, F.lit(low)), grid_sum(duration, -behind, -before)


def trim(cues: DataFrame, end: float, start: float = 0.0) -> DataFrame:
    """Cues and words cut to a range; what lies outside gets no or a negative duration."""
    if start < 0:
        raise ValueError("start is negative")
    s, d = _trimmed(F.col("start"), F.col("duration"), float(start), float(end))
    cut = cues.withColumns({"start": s, "duration": d})

    def word(w: Column) -> Column:
        s, d = _trimmed(w["start"], w["duration"], float(start), float(end))
        return w.withField("start", s).withField("duration", d)

    return _with_words(cut, word)


def derived_end(start: Column, duration: Column) -> Column:
    return F.round(start + duration, 8)


def with_alignment(cues: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The words of another frame by key; cues without a partner keep theirs."""
    joined = cues.join(words.select(*keys, F.col("words").alias("__w")), list(keys), "left")
    own = F.col("words") if "words" in cues.columns else F.lit(None)
    return joined.withColumn("words", F.coalesce("__w", own)).drop("__w")


def word_level(wanted: bool | None, with_words: int, total: int, fmt: str) -> bool:
    """Whether a writer puts out words: asked for and there, or by the format's custom; warnings name what falls back."""
    if fmt in NO_WORDS:
        return False
    if wanted is None:
        return fmt in LOSSLESS and with_words > 0
    if not wanted:
        return False
    if with_words < total:
        logging.getLogger("cuemill").warning("%s: %d of %d cues have no words and are written whole", fmt, total - with_words, total)
    return with_words > 0


def word_levels(cues: DataFrame, wanted: bool | None, fmt: str, track: str = "track_id") -> DataFrame:
    """The same decision for each track, with the counts it rests on."""
    counted = cues.groupBy(track).agg(F.count_if(F.size("words") > 0).alias("with_words"), F.count("*").alias("total"))
    if fmt in NO_WORDS or wanted is False or wanted is None and fmt not in LOSSLESS:
        return counted.withColumn("word_level", F.lit(False))
    return counted.withColumn("word_level", F.col("with_words") > 0)


def document(cues: DataFrame, track: str = "track_id", position: str = "cue_idx", **facts: str | None) -> DataFrame:
    """One row per track out of its cues: ``cues`` (ordered) and document-level facts (language, kind, source format and path)."""
    columns = [c for c in cues.columns if c != track]
    held = F.array_sort(F.collect_list(F.struct(position, *(c for c in columns if c != position))))
    return cues.groupBy(track).agg(held.alias("cues")).withColumns({k: F.lit(v).cast("string") for k, v in facts.items()})


def from_rows(spark: SparkSession, rows: Sequence[dict], language: str | None = None, track_id: int = 0) -> DataFrame:
    """Cues out of dictionaries: unknown keys are ignored, positions follow the order given."""
    schema = "track_id long, cue_idx int, id string, start double, duration double, text string, speaker string, language string, translation string"
    out = [(track_id, k, r.get("id"), r.get("start"), r.get("duration"), r.get("text"), r.get("speaker"), r.get("language") or language, r.get("translation")) for k, r in enumerate(rows)]
    return spark.createDataFrame(out, schema)


def to_dict(cues: DataFrame) -> Column:
    """A cue as JSON without its null fields."""
    return F.to_json(F.struct(*(c for c in FIELDS if c in cues.columns)))


def from_dict(value: Column) -> Column:
    """The struct of a cue's JSON; unknown fields are ignored, missing ones null."""
    return F.from_json(value, "id string, recording_id string, start double, duration double, text string, language string, speaker string, gender string, score double, translation string, target_lang string, custom map<string,string>, words array<struct<symbol:string,start:double,duration:double,score:double>>")


def transform_text(cues: DataFrame, change: Callable[[str], str]) -> DataFrame:
    """A user's function over every text, in Arrow batches; null texts stay null."""
    return cues.withColumn("text", vectorised(lambda t: None if t is None else change(t), "string")(F.col("text")))


def transform_words(cues: DataFrame, change: Callable[[str], str] | Callable[[Column], Column], native: bool = False) -> DataFrame:
    """A user's function over every word's symbol: a column function where ``native``, else one over strings in Arrow batches."""
    if native:
        return _with_words(cues, lambda w: w.withField("symbol", change(w["symbol"])))
    changed = vectorised(lambda ws: None if ws is None else [None if w is None else change(w) for w in ws], "array<string>")(F.transform("words", lambda w: w["symbol"]))
    zipped = F.transform("words", lambda w, i: w.withField("symbol", F.get(F.col("__new"), i)))
    return cues.withColumn("__new", changed).withColumn("words", zipped).drop("__new")


def append(first: DataFrame, second: DataFrame, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """The second frame's cues behind the first one's, positions going on."""
    last = first.groupBy(track).agg((F.max(position) + 1).alias("__off"))
    order = Window.partitionBy(track).orderBy(position)
    moved = second.withColumn("__nr", F.row_number().over(order) - 1).join(last, track, "left").withColumn(position, (F.coalesce("__off", F.lit(0)) + F.col("__nr")).cast("int"))
    return first.unionByName(moved.drop("__off", "__nr"), allowMissingColumns=True)


def new_speaker(cues: DataFrame, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """``new_speaker``: whether a cue's speaker is given and not that of the cue before."""
    before = F.lag("speaker").over(Window.partitionBy(track).orderBy(position))
    return cues.withColumn("new_speaker", F.coalesce((F.col("speaker") != "") & ~F.col("speaker").eqNullSafe(before), F.lit(False)))


def segment_ids(cues: DataFrame, track: str = "track_id", position: str = "cue_idx", prefix: str = "segment_") -> DataFrame:
    """``segment_id`` by order of position, five digits wide."""
    nr = F.row_number().over(Window.partitionBy(track).orderBy(position)) - 1
    return cues.withColumn("segment_id", F.concat(F.lit(prefix), F.lpad(nr.cast("string"), 5, "0")))


def first_n(cues: DataFrame, n: int, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """The first cues of every track."""
    return cues.withColumn("__nr", F.row_number().over(Window.partitionBy(track).orderBy(position))).where(F.col("__nr") <= n).drop("__nr")
