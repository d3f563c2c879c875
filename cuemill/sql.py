"""The SQL surface: functions and views by name."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from cuemill.functions import breaks
from cuemill.session import table
from cuemill.sources import transcripts

# SQL bodies of functions that are one expression.
FUNCTIONS = {
    "cue_end(s DOUBLE, d DOUBLE) RETURNS DOUBLE": "bround(s + d, 8)",
    "srt_stamp(s DOUBLE) RETURNS STRING": "format_string('%02d:%02d:%02d,%03d', floor(floor(s * 1000) / 3600000), floor(pmod(floor(s * 1000), 3600000) / 60000), floor(pmod(floor(s * 1000), 60000) / 1000), pmod(floor(s * 1000), 1000))",
    "cue_squash(t STRING) RETURNS STRING": "trim(regexp_replace(t, '(?U)\\\\s+', ' '))",
    "cue_plain(t STRING) RETURNS STRING": "trim(regexp_replace(regexp_replace(t, '\\\\{\\\\\\\\[^}]*\\\\}', ''), '(?U)\\\\s+', ' '))",
}


class SplitCue:
    """Table function: a cue in pieces of at most some characters, times by share of characters."""

    def eval(self, text: str, start: float, duration: float, most: int):
        pieces = breaks.text_chunks(text, most) if text else []
        total, at = sum(map(len, pieces)) or 1, start
        for k, piece in enumerate(pieces):
            length = duration * len(piece) / total
            yield k, piece, at, length
            at += length


class TranscriptCues:
    """Table function: the cues of a Markdown transcript."""

    def eval(self, content: str):
        yield from ((speaker, text, float(start), float(length)) for start, length, speaker, text in transcripts.cues(content or ""))


VIEWS = ("text_tracks", "supervisions", "markdown_segments", "alignment_plans", "validation_results", "documents", "speakers")


def register_functions(spark: SparkSession) -> None:
    """Functions of one expression, and table functions ``split_cue(text, start, duration, most)`` and ``transcript_cues(content)``."""
    spark.udtf.register("split_cue", udtf(SplitCue, returnType="part int, text string, start double, duration double"))
    spark.udtf.register("transcript_cues", udtf(TranscriptCues, returnType="speaker string, text string, start double, duration double"))
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Temp views of the tables, and ``cues``: every position of a track once with its end."""
    for name in VIEWS:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY VIEW cues AS SELECT *, bround(start + duration, 8) AS end FROM"
        " (SELECT *, row_number() OVER (PARTITION BY track_id, cue_idx ORDER BY row_id) AS nth FROM supervisions) WHERE nth = 1"
    )
