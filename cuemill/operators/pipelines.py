"""Composite operators: broadcast standardisation, translations written in, stamps renewed, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.config import StandardizationConfig
from cuemill.functions import text as T
from cuemill.functions import timecode as K
from cuemill.operators import segments, timing


def standardize(cues: DataFrame, config: StandardizationConfig | None = None, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """Gaps and least durations enforced, long cues split, texts wrapped.

    Result: track, position, ``part``, ``start``, ``duration``, ``speaker``, ``text``; cues
    without usable times are left out.
    """
    c = config or StandardizationConfig()
    timed = timing.sanitize_timeline(cues, c.min_duration, c.min_gap, track, position).select(
        track, position, (F.col("start_ms") / 1000.0).alias("start"), (F.col("duration_ms") / 1000.0).alias("duration")
    )
    said = timed.join(cues.select(track, position, "speaker", "text"), [track, position])
    pieces = segments.split_long_cues(said, c.max_chars_per_line * c.max_lines, c.max_duration)
    return pieces.select(track, position, "part", "start", "duration", "speaker", T.wrap(F.col("text"), c.max_chars_per_line, c.max_lines).alias("text"))


def set_translations(cues: DataFrame, translations: DataFrame, language: str, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """Translations by position; a track whose counts differ is refused when the result is read."""
    have = Window.partitionBy(track)
    joined = cues.join(translations.select(track, position, F.col("translation").alias("__t"), F.lit(True).alias("__has")), [track, position], "full")
    checked = joined.withColumn("__bad", F.max((F.col("__has").isNull() | F.col("start").isNull() & F.col("text").isNull()).cast("int")).over(have))
    value = F.when(F.col("__bad") == 1, F.raise_error(F.concat(F.lit("translations and cues differ in number: "), F.col(track).cast("string"))).cast("string")).otherwise(F.col("__t"))
    return checked.withColumns({"translation": value, "target_lang": F.lit(language)}).drop("__t", "__has", "__bad")


def strip_translations(cues: DataFrame) -> DataFrame:
    return cues.withColumns({"translation": F.lit(None).cast("string"), "target_lang": F.lit(None).cast("string")})


def renew_stamp(line: Column, seconds: Column) -> Column:
    """A transcript line with its first ``[HH:MM:SS]`` stamp replaced, or one added at its end."""
    p = "\\[\\d{1,2}:\\d{2}(?::\\d{2})?(?:\\.\\d{1,3})?\\]"
    stamp = K.markdown_stamp(seconds)
    parts = F.split(line, p, 2)
    return F.when(seconds.isNull(), line).when(line.rlike(p), F.concat(F.get(parts, F.lit(0)), stamp, F.get(parts, F.lit(1)))).otherwise(F.concat(line, F.lit(" "), stamp))


def warnings(cues: DataFrame, config: StandardizationConfig | None = None, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """One row per finding: ``what`` is short, long, gap, line or speed."""
    c = config or StandardizationConfig()
    order = Window.partitionBy(track).orderBy(position)
    body = F.coalesce("text", F.lit(""))
    gap = F.col("start") - F.lag(F.col("start") + F.col("duration")).over(order)
    longest = F.array_max(F.transform(F.split(body, "\n"), lambda x: F.length(x)))
    speed = F.when(F.col("duration") > 0, F.length(F.replace(body, F.lit("\n"), F.lit(""))) / F.col("duration")).otherwise(0.0)
    found = F.array_compact(
        F.array(
            F.when(F.col("duration") < c.min_duration, F.lit("short")),
            F.when(F.col("duration") > c.max_duration, F.lit("long")),
            F.when((gap >= 0) & (gap < c.min_gap - 1e-6), F.lit("gap")),
            F.when(longest > c.max_chars_per_line, F.lit("line")),
            F.when(speed > 1.5 * c.optimal_cps, F.lit("speed")),
        )
    )
    usable = cues.where("start is not null and duration is not null")
    return usable.select(track, position, found.alias("found")).select(track, position, F.explode("found").alias("what"))
