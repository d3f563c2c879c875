"""Languages of tracks and of foreign stretches, by compression classification.

Every cue is encoded with the raw-content dictionary of each language of its script and
gets the one of least size, with the margin to the next as confidence; narrow margins
are rejected.  The next may be a rival of the script that knows letters but no language:
a language must lead it as texts of that language and length do, so that a text in none
of the known languages is rejected even where its script has one dictionary only.  A track has the language of most of its cues.  A cue is foreign if it is
clearly in another language, or doubtful between two cues of one and the same foreign
language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.compress import Profiles, bare
from cuemill.llm.encoding import Mender, _high
from cuemill.llm.labels import BY_NAME

MARGIN = 0.08
LONE_MARGIN = 0.45
CLEAR_MARGIN = 0.3  # a language so far before all others of its script leads the rival too
_NOTE = re.compile(r"[\[(（【*♪♫][^\])）】*♪♫]*[\])）】*♪♫]?")
_LABEL = re.compile(r"^\s*(?:\[?[A-Z]+_\d+\]?\s*:|>>+)\s*")
_MARKED = re.compile(r"[\[(（【*♪♫<{_>]")
_SENTENCE = re.compile(r"[^.!?。！？।\n]+(?:[.!?。！？।]+[”\"»“)」]*|\n|$)\s*")
_FOUR = re.compile(r"(?s)(?:[^\W\d_].*?){4}")
_TWO = re.compile(r"(?s)(?:[^\W\d_].*?){2}")


def _spoken(text: str) -> str:
    """Text without tags, machine labels and sound notes; empty for a bare sound note."""
    if not _MARKED.search(text):
        return " ".join(text.split())
    return bare(_NOTE.sub(" ", _LABEL.sub("", bare(text))))


class Classifier:
    def __init__(self, profiles: Profiles, margin: float = MARGIN):
        self.profiles, self.margin, self.mender = profiles, margin, Mender(profiles)
        self.classify = lru_cache(20_000)(self._classify)  # neighbours often repeat a text

    def _classify(self, text: str | None) -> tuple[str | None, float]:
        """(language or None, confidence 0..1); None for no letters, a sound note, garbling or a narrow margin."""
        if not text:
            return None, 0.0
        spoken = _spoken(text)
        if not (_FOUR if spoken.isascii() else _TWO).search(spoken) or not spoken.isascii() and self.mender.is_odd(spoken, _high(spoken)) and self.mender.is_garbled(text):
            return None, 0.0
        sizes = self.profiles.sizes(spoken)
        ranked = sorted(sizes.items(), key=lambda x: (x[1], x[0]))
        best, least = ranked[0]
        clear = len(ranked) > 1 and (ranked[1][1] - least) / ranked[1][1] >= CLEAR_MARGIN
        rival = None if clear else self.profiles.rival(spoken)
        if rival:
            lead = (rival - least) / rival
            if lead < self.profiles.least_lead(best, len(spoken.encode("utf-8", "surrogatepass"))):
                return None, max(0.0, lead)
        if len(ranked) == 1:
            return best, 1.0 if not rival else lead
        confidence = (ranked[1][1] - least) / ranked[1][1]
        return (best if confidence >= self.margin and ranked[1][1] - least >= 2 else None), confidence

    def segments(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(from, to, language, confidence) of the stretches of a text, where it holds several languages; else none.

        Stretches are whole sentences or lines; a doubtful one joins the stretch before it.
        """
        found: list[list] = []
        for m in _SENTENCE.finditer(text or ""):
            lang, confidence = self.classify(m.group())
            if lang and (not found or found[-1][2] != lang):
                found.append([m.start() if found else 0, m.end(), lang, [confidence]])
            elif found:
                found[-1][1] = m.end()
                if lang:
                    found[-1][3].append(confidence)
        return [(a, b, lang, sum(c) / len(c)) for a, b, lang, c in found] if len(found) > 1 else []


def classify(rows: DataFrame, profiles: Profiles, *keys: str, text: str = "text") -> DataFrame:
    """``keys`` with ``lang`` (null where rejected) and ``confidence`` of each row's text."""
    schema = rows.select(*keys).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(profiles)
        for batch in batches:
            found = [classifier.classify(t) for t in batch.column(len(keys)).to_pylist()]
            lang, confidence = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], pa.array(lang, pa.string()), pa.array(confidence, pa.float64())], [*keys, "lang", "confidence"]
            )

    full = schema.add("lang", "string").add("confidence", "double")
    return rows.select(*keys, text).mapInArrow(work, full)


def mixed_segments(rows: DataFrame, profiles: Profiles, key: str = "row_id", text: str = "text") -> DataFrame:
    """Stretches of texts in several languages: key, ``first`` and ``last`` (code points, the last excluded), ``lang``, ``confidence``.

    Texts in one language, null and empty ones give no row; repeated rows each count.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(profiles)
        for batch in batches:
            out = [(k, *part) for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for part in classifier.segments(t)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["k", "first", "last", "lang", "confidence"])

    return rows.select(key, text).mapInArrow(work, "k long, first int, last int, lang string, confidence double").withColumnRenamed("k", key)


def label_code(label: Column) -> Column:
    """``code_of`` as a column."""
    head = F.split(F.lower(F.trim(label)), r"[-_\s(]", 2)[0]
    return F.create_map(*(F.lit(x) for pair in sorted(BY_NAME.items()) for x in pair))[head]


def track_languages(cues: DataFrame) -> DataFrame:
    """Language of most cues of each track; each position counts once, ties go to the more confident language.

    ``cues`` is the result of ``classify`` with ``track_id`` and ``cue_idx``.  Result:
    ``track_id``, ``lang`` (null if no cue is clear), ``confidence`` (share of its cues
    times their mean margin), ``cues``.
    """
    once = cues.groupBy("track_id", "cue_idx").agg(F.max(F.struct("lang", "confidence")).alias("x"))
    counts = once.groupBy("track_id", F.col("x.lang").alias("lang")).agg(F.count("*").alias("n"), F.sum("x.confidence").alias("c"))
    return counts.groupBy("track_id").agg(
        F.max(F.when(F.col("lang").isNotNull(), F.struct("n", "c", "lang"))).alias("top"), F.sum("n").alias("cues")
    ).select(
        "track_id",
        F.col("top.lang").alias("lang"),
        F.coalesce(F.col("top.n") / F.col("cues") * (F.col("top.c") / F.col("top.n")), F.lit(0.0)).alias("confidence"),
        "cues",
    )


def foreign_cues(cues: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rows of ``classify`` (with ``row_id``) in another language than their track's.

    A rejected cue with words takes the language of its neighbours where both are the
    same foreign one; a cue with no cue of its language within two positions needs
    ``LONE_MARGIN``, as names and scraps are often nearer to a wrong language.
    Result: ``row_id``, ``track_id``, ``cue_idx``, ``lang``, ``confidence``.
    """
    home = tracks.where("lang is not null").select("track_id", F.col("lang").alias("home"))
    odd = cues.where("confidence > 0 or lang is not null").join(home, "track_id").where("lang is null or lang <> home")
    sure = odd.where("lang is not null").select("track_id", "cue_idx", "lang").distinct()
    # neighbours by position, so that no track is ever one task
    at = lambda k, name: sure.select("track_id", (F.col("cue_idx") + k).alias("cue_idx"), F.col("lang").alias(name))
    doubtful = odd.where("lang is null").drop("lang").join(at(1, "before"), ["track_id", "cue_idx"]).join(at(-1, "after"), ["track_id", "cue_idx"])
    taken = doubtful.where("before = after").select("row_id", "track_id", "cue_idx", F.col("before").alias("lang"), "confidence")
    near = sure.withColumn("k", F.explode(F.array(*map(F.lit, (-2, -1, 1, 2))))).select("track_id", (F.col("cue_idx") + F.col("k")).alias("cue_idx"), "lang").distinct()
    judged = odd.where("lang is not null").select("row_id", "track_id", "cue_idx", "lang", "confidence")
    backed = judged.where(F.col("confidence") < LONE_MARGIN).join(near, ["track_id", "cue_idx", "lang"], "left_semi").select(judged.columns)
    return judged.where(F.col("confidence") >= LONE_MARGIN).unionAll(backed).unionAll(taken)


def stretches(foreign: DataFrame) -> DataFrame:
    """Runs of neighbouring foreign cues of one language: first and last position, cues, mean confidence."""
    once = foreign.groupBy("track_id", "cue_idx", "lang").agg(F.max("confidence").alias("confidence"))
    order = Window.partitionBy("track_id", "lang").orderBy("cue_idx")
    return (
        once.withColumn("run", F.col("cue_idx") - F.row_number().over(order))
        .groupBy("track_id", "lang", "run")
        .agg(F.min("cue_idx").alias("first_cue"), F.max("cue_idx").alias("last_cue"), F.count("*").alias("cues"), F.avg("confidence").alias("confidence"))
        .drop("run")
    )


def label_cases(cues: DataFrame, tracks: DataFrame, languages: DataFrame) -> DataFrame:
    """Tracks whose delivered label is missing, undetermined or names another language.

    Of several deliveries of a track the newest counts.
    """
    delivered = tracks.groupBy("track_id").agg(F.max(F.struct("ingested_at", "language")).alias("x"))
    labelled = delivered.select("track_id", label_code(F.col("x.language")).alias("told"))
    return languages.where("lang is not null").join(labelled, "track_id").where("told is null or told <> lang").select("track_id", "lang", "confidence")
