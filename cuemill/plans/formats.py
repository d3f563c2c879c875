"""Queries over formats: every writer's documents, every reader on them, detection; all tracks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.sources import registry
from cuemill.session import table

#: What a stamp keeps: units a second, and whether it is cut or rounded.
PRECISION = {
    "srt": (1000, "round"), "vtt": (1000, "round"), "ass": (100, "round"), "ssa": (100, "round"), "sub": (25, "round"), "sami": (1000, "round"), "sbv": (1000, "cut"),
    "srv3": (1000, "cut"), "json": (10000, "round"), "json3": (1000, "cut"), "csv": (1000, "round"), "tsv": (1000, "round"), "aud": (1000000, "text"), "txt": (100, "text"),
    "textgrid": (1000, "text"), "ttml": (1000, "round"), "imsc1": (1000, "round"), "ebu_tt_d": (1000, "round"), "fcpxml": (1000, "round"), "premiere_xml": (25, "round"), "avid_ds": (25, "round"), "audition_csv": (1000, "text"),
    "lrc": (1000, "round"),
}
ONE_LINE = {"csv", "tsv", "aud", "txt", "textgrid", "avid_ds", "audition_csv", "lrc"}


def positions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position of every track with usable times and text, its text as delivered."""
    cues = table(spark, sf_dir, "supervisions", "track_id", "cue_idx", "row_id", "start", "duration", "text", "speaker")
    first = Window.partitionBy("track_id", "cue_idx").orderBy("row_id")
    kept = cues.withColumn("nth", F.row_number().over(first)).where("nth = 1 and start >= 0 and duration > 0 and length(trim(text)) > 0")
    return kept.select(F.col("track_id").alias("doc_id"), "cue_idx", "start", "duration", "text", "speaker")


def cues_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position of every track with usable times and text without blank ends, as ``doc_id, cue_idx, ...``."""
    kept = positions_of(spark, sf_dir).where("duration >= 0.1")
    return kept.select("doc_id", "cue_idx", "start", "duration", F.regexp_replace("text", "[^\\x{20}-\\x{FFFD}\\n]|[\\x{7F}-\\x{9F}\\x{A0}\\x{3000}\\x{AD}]|[|{}\\\\]", " ").alias("text"), "speaker")


def _written(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = registry.write(cues_of(spark, sf_dir), fmt)
        return docs.select("doc_id", F.md5(F.encode("content", "UTF-8")).alias("digest"), F.length("content").cast("long").alias("chars"))

    return query


def _round_trip(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    per, _ = PRECISION[fmt]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cues = registry.read(registry.write(cues_of(spark, sf_dir), fmt, speakers=False), fmt, normalize=False)
        unit = lambda c: F.rint(c * per).cast("long")
        said = F.trim(F.regexp_replace("text", "\\s+", " "))
        shown = [unit(F.col("start")).alias("first")] + ([] if fmt == "lrc" else [unit(F.col("start") + F.col("duration")).alias("last")])
        return cues.select("doc_id", *shown, said.alias("said"))

    return query


def d01_detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every writer's documents of every track, named by their content."""
    cues = cues_of(spark, sf_dir)
    out = None
    for fmt in ("srt", "vtt", "ass", "ssa", "sub", "sami", "sbv", "lrc", "srv3", "json", "json3", "csv", "tsv", "aud", "textgrid", "ttml", "fcpxml", "premiere_xml", "audition_csv", "avid_ds"):
        told = registry.write(cues, fmt, speakers=False).select("doc_id", F.lit(fmt).alias("written"), registry.detect_format(F.col("content")).alias("detected"))
        out = told if out is None else out.unionAll(told)
    return out


_SOURCE = """cues as (select track_id doc_id, cue_idx, "start", duration, speaker, regexp_replace(text, '[^\\x{20}-\\x{FFFD}\\n]|[\\x{7F}-\\x{9F}\\x{A0}\\x{3000}\\x{AD}]|[|{}\\\\]', ' ', 'g') as text
 from (select * from supervisions qualify row_number() over (partition by track_id, cue_idx order by row_id) = 1) where "start" >= 0 and duration >= 0.1 and length(trim(text)) > 0)"""


def _trip_sql(fmt: str) -> str:
    per, how = PRECISION[fmt]
    rule = {"round": f"cast(round_even({{}} * {per}, 0) as bigint)", "cut": f"cast(floor({{}} * {per}) as bigint)", "text": f"cast(round_even({{}} * {per}, 0) as bigint)"}[how]
    end = '"start" + duration'
    if fmt == "json":
        last = f"cast(round_even((round(\"start\", 4) + round(duration, 4)) * {per}, 0) as bigint)"
    elif fmt == "fcpxml":
        last = f"{rule.format(chr(34) + 'start' + chr(34))} + {rule.format('duration')}"
    elif fmt == "audition_csv":
        last = f"{rule.format(chr(34) + 'start' + chr(34))} + {rule.format('duration')}"
    else:
        last = rule.format(f"({end})")
    first = "cast(round_even(round(\"start\", 4) * 10000, 0) as bigint)" if fmt == "json" else rule.format('"start"')
    keep = f"where {last} > {first}" if fmt not in ("lrc", "json") else ""
    return f"with {_SOURCE} select doc_id, {first} as first{'' if fmt == 'lrc' else f', {last} as last'}, trim(regexp_replace(text, '[ \\n\\t]+', ' ', 'g')) said from cues {keep}"


QUERIES = {f"r_{fmt}_round_trip": _round_trip(fmt) for fmt in PRECISION} | {f"k_{fmt}_written": _written(fmt) for fmt in registry.WRITERS} | {"d01_detect_format": d01_detect_format}
ORACLES = {f"r_{fmt}_round_trip": _trip_sql(fmt) for fmt in PRECISION}
ORACLES["d01_detect_format"] = f"with {_SOURCE}, docs as (select distinct doc_id from cues) select doc_id, f as written, f as detected from docs, unnest(['srt', 'vtt', 'ass', 'ssa', 'sub', 'sami', 'sbv', 'lrc', 'srv3', 'json', 'json3', 'csv', 'tsv', 'aud', 'textgrid', 'ttml', 'fcpxml', 'premiere_xml', 'audition_csv', 'avid_ds']) t(f)"
_STAMPS = {
    "srt": ("cast(row_number() over w as varchar) || chr(10) || {c0} || ' --> ' || {c1} || chr(10) || text", "", "chr(10)", "chr(10) || chr(10)"),
    "vtt": ("cast(row_number() over w as varchar) || chr(10) || {v0} || ' --> ' || {v1} || chr(10) || text", "'WEBVTT' || chr(10) || chr(10)", "chr(10)", "chr(10) || chr(10)"),
    "sbv": ("{s0} || ',' || {s1} || chr(10) || text", "", "chr(10)", "chr(10) || chr(10)"),
    "txt": ("printf('[%d.%02d-%d.%02d] ', {t0} // 100, {t0} % 100, {t1} // 100, {t1} % 100) || trim(regexp_replace(text, '[ \\n\\t]+', ' ', 'g'))", "", "chr(10)", "chr(10)"),
}


def _clock_sql(value: str, form: str, how: str) -> str:
    t = f"cast({how}({value} * 1000{', 0' if how == 'round_even' else ''}) as bigint)"
    return f"printf('{form}', {t} // 3600000, ({t} % 3600000) // 60000, ({t} % 60000) // 1000, {t} % 1000)"


for _fmt, (_part, _head, _tail, _sep) in _STAMPS.items():
    _a, _b = '"start"', '("start" + duration)'
    _part = _part.format(
        c0=_clock_sql(_a, "%02d:%02d:%02d,%03d", "round_even"), c1=_clock_sql(_b, "%02d:%02d:%02d,%03d", "round_even"),
        v0=_clock_sql(_a, "%02d:%02d:%02d.%03d", "round_even"), v1=_clock_sql(_b, "%02d:%02d:%02d.%03d", "round_even"),
        t0='cast(round_even("start" * 100, 0) as bigint)', t1='cast(round_even(("start" + duration) * 100, 0) as bigint)',
        s0=_clock_sql(_a, "%d:%02d:%02d.%03d", "floor"), s1=_clock_sql(_b, "%d:%02d:%02d.%03d", "floor"),
    )
    ORACLES[f"k_{_fmt}_written"] = f"""with {_SOURCE}, parts as (select doc_id, cue_idx, {_part} p from cues window w as (partition by doc_id order by cue_idx)),
 docs as (select doc_id, {_head + ' || ' if _head else ''}string_agg(p, {_sep} order by cue_idx) || {_tail} as content from parts group by doc_id)
 select doc_id, md5(content) digest, cast(length(content) as bigint) chars from docs"""
