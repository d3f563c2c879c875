"""Live cue feeds on Structured Streaming: the batch operators' twins over event time.

Feeds have ``event_ts`` (timestamp), ``track_id``, ``cue_idx``, ``start``, ``duration``,
``speaker`` and ``text``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FEED = "event_ts timestamp, track_id long, cue_idx int, start double, duration double, speaker string, text string"
LATENESS = "30 seconds"


def read_feed(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a feed."""
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_delivered(feed: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each position of a track once; later deliveries within the watermark are dropped."""
    return feed.withWatermark("event_ts", lateness).dropDuplicatesWithinWatermark(["track_id", "cue_idx"])


def reading_speed(feed: DataFrame, width: str = "1 minute", slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Cues, characters and talk time per track and window, tumbling or sliding."""
    window = F.window("event_ts", width, slide) if slide else F.window("event_ts", width)
    out = feed.withWatermark("event_ts", lateness).groupBy("track_id", window).agg(
        F.count("*").alias("cues"), F.sum(F.length("text")).alias("chars"), F.sum("duration").alias("seconds")
    )
    return out.select("track_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "cues", "chars", "seconds")


def utterances(feed: DataFrame, gap: str = "2 seconds", lateness: str = LATENESS) -> DataFrame:
    """Cues of one speaker with gaps up to ``gap`` as sessions."""
    window = F.session_window("event_ts", gap)
    out = feed.withWatermark("event_ts", lateness).groupBy("track_id", F.coalesce("speaker", F.lit("")).alias("speaker"), window).agg(F.count("*").alias("cues"), F.min("start").alias("start"), F.max(F.col("start") + F.col("duration")).alias("end"))
    return out.select("track_id", "speaker", F.col("session_window.start").alias("from_ts"), F.col("session_window.end").alias("to_ts"), "cues", "start", "end")


class _Gaps(StatefulProcessor):
    """Keeps each track's last end and speaker, so that a cue is judged by the one before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "end double, speaker string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows).sort_values(["start", "cue_idx"], kind="stable")
        known = self.last.get() if self.last.exists() else None
        end, speaker = (known[0], known[1]) if known else (None, None)
        out = []
        for r in frame.itertuples(index=False):
            gap = None if end is None else r.start - end
            out.append((key[0], r.cue_idx, gap, bool(r.speaker) and r.speaker != speaker))
            end, speaker = r.start + r.duration, r.speaker
        self.last.update((float(end), speaker))
        yield pd.DataFrame(out, columns=["track_id", "cue_idx", "gap", "new_speaker"])

    def close(self) -> None:
        pass


def gaps_and_speakers(feed: DataFrame) -> DataFrame:
    """Gap to the cue before and whether the speaker is new, with state per track (needs the RocksDB state store)."""
    return feed.where("start is not null and duration is not null").groupBy("track_id").transformWithStateInPandas(
        _Gaps(), outputStructType="track_id long, cue_idx int, gap double, new_speaker boolean", outputMode="Append", timeMode="None"
    )
