"""Readers and writers of line-based cue formats, as column expressions over whole documents.

A reader takes ``doc_id, content`` and gives ``doc_id, cue_idx, start, duration, speaker,
text``; a writer takes those (and ``translation`` where there is one) and gives ``doc_id,
content``.  Content with CRLF reads like LF.  Cues without usable times are skipped by
readers and writers alike; a null content gives no cue.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import text as T
from cuemill.functions import timecode as K

CUE_COLUMNS = ("doc_id", "cue_idx", "start", "duration", "speaker", "text")


def _clean(docs: DataFrame) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace(F.col("content"), "\\r\\n?", "\n"), "^\\x{FEFF}", "")
    return docs.where("content is not null").select("doc_id", plain.alias("content"))


def _exploded(docs: DataFrame, pattern: str) -> DataFrame:
    return _clean(docs).select("doc_id", F.posexplode(F.split("content", pattern)).alias("at", "part"))


def _numbered(cues: DataFrame, normalize: bool, keep_newlines: bool = True) -> DataFrame:
    """Positions from 0 in document order, speaker labels taken off, text normalised."""
    order = Window.partitionBy("doc_id").orderBy("at")
    body = T.normalize_text(F.col("text"), keep_newlines) if normalize else F.col("text")
    labelled = cues.withColumn("text", body)
    if normalize:
        read = T.speaker_of(F.col("text"))
        labelled = labelled.withColumn("read", read).withColumns({"speaker": F.coalesce("speaker", "read.speaker"), "text": F.when(F.col("speaker").isNull(), F.col("read.text")).otherwise(F.col("text"))})
    return labelled.where("start is not null and duration is not null").select(
        "doc_id", (F.row_number().over(order) - 1).alias("cue_idx"), "start", F.round("duration", 8).alias("duration"), "speaker", "text"
    )


_NO_SPEAKER = "string"


def _block_reader(pattern: str, clamp: bool = False) -> Callable[..., DataFrame]:
    def read(docs: DataFrame, normalize: bool = True) -> DataFrame:
        part = F.col("part")
        start, end = K.parse_clock(F.regexp_extract(part, pattern, 1)), K.parse_clock(F.regexp_extract(part, pattern, 2))
        span = F.greatest(F.lit(0.0), end - start) if clamp else end - start
        found = _exploded(docs, "\\n[ \\t]*\\n+").where(part.rlike(pattern))
        body = F.regexp_extract(part, pattern, 3)
        voice = T.voice_tag(body)
        cues = found.select("doc_id", "at", start.alias("start"), span.alias("duration"), voice.alias("speaker"), F.when(voice.isNotNull(), F.regexp_replace(body, "</?v[^>]*>", "")).otherwise(body).alias("text"))
        return _numbered(cues if clamp else cues.where("duration > 0"), normalize)

    return read


read_srt = _block_reader("(?s)(\\d+:\\d+:\\d+[,.]\\d+)[ \\t]*-->[ \\t]*(\\d+:\\d+:\\d+[,.]\\d+)[^\\n]*\\n(.*?)\\n*$")
read_vtt = _block_reader("(?s)((?:\\d+:)?\\d+:\\d+[,.]\\d+)[ \\t]*-->[ \\t]*((?:\\d+:)?\\d+:\\d+[,.]\\d+)[^\\n]*\\n(.*?)\\n*$", clamp=True)
read_sbv = _block_reader("(?s)(\\d+:\\d+:\\d+\\.\\d+),(\\d+:\\d+:\\d+\\.\\d+)\\n(.*?)\\n*$")


def read_lrc(docs: DataFrame, normalize: bool = True) -> DataFrame:
    """Lines with a stamp; a cue lasts to the next start, the last 5 s."""
    p = "^\\[(\\d+:\\d+(?:\\.\\d+)?)\\](.*)$"
    lines = _exploded(docs, "\\n").where(F.col("part").rlike(p))
    start = K.parse_clock(F.regexp_extract("part", p, 1))
    order = Window.partitionBy("doc_id").orderBy("at")
    said = F.trim(F.regexp_replace(F.regexp_extract("part", p, 2), "<\\d+:\\d+(?:\\.\\d+)?>", ""))
    cues = lines.select("doc_id", "at", start.alias("start"), said.alias("text"))
    return _numbered(
        cues.select("doc_id", "at", "start", F.coalesce(F.lead("start").over(order) - F.col("start"), F.lit(5.0)).alias("duration"), F.lit(None).cast("string").alias("speaker"), "text"), normalize
    )


def _delimited(sep: str) -> Callable[..., DataFrame]:
    def read(docs: DataFrame, normalize: bool = True) -> DataFrame:
        """``start, end[, speaker], text`` in milliseconds, by header; bad rows are skipped."""
        columns = "a string, b string, c string, d string"
        lines = _exploded(docs, "\\n").where(F.trim("part") != "")
        if sep == ",":
            row = F.from_csv("part", columns, {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"})
        else:  # tabs are never quoted
            cell = F.split("part", sep, 4)
            row = F.struct(*(F.get(cell, F.lit(k)).alias(name) for k, name in enumerate("abcd")))
        parsed = lines.select("doc_id", "at", row.alias("r"))
        # the speaker's place is told by the header
        head = parsed.where("at = 0").select("doc_id", (F.lower("r.a") == "speaker").alias("first"), (F.lower("r.c") == "speaker").alias("third"))
        joined = parsed.join(head, "doc_id", "left")
        shift, third = F.coalesce("first", F.lit(False)), F.coalesce("third", F.lit(False))
        start = F.when(shift, F.col("r.b")).otherwise(F.col("r.a")).try_cast("double") / 1000
        end = F.when(shift, F.col("r.c")).otherwise(F.col("r.b")).try_cast("double") / 1000
        speaker = F.when(shift, F.col("r.a")).when(third, F.col("r.c"))
        body = F.when(shift | third, F.col("r.d")).otherwise(F.concat_ws(",", "r.c", "r.d"))
        cues = joined.select("doc_id", "at", start.alias("start"), (end - start).alias("duration"), F.nullif(speaker, F.lit("")).alias("speaker"), body.alias("text"))
        return _numbered(cues.where("duration > 0"), normalize)

    return read


read_csv, read_tsv = _delimited(","), _delimited("\t")


def read_aud(docs: DataFrame, normalize: bool = True) -> DataFrame:
    """Label tracks: start, end, text with an optional ``[[speaker]]``."""
    part = F.split("part", "\t", 3)
    p = "^\\[\\[([^\\]]+)\\]\\]\\s*"
    start, end, said = F.get(part, F.lit(0)).try_cast("double"), F.get(part, F.lit(1)).try_cast("double"), F.get(part, F.lit(2))
    cues = _exploded(docs, "\\n").select(
        "doc_id", "at", start.alias("start"), (end - start).alias("duration"), F.nullif(F.regexp_extract(said, p, 1), F.lit("")).alias("speaker"), F.regexp_replace(said, p, "").alias("text")
    )
    return _numbered(cues.where("duration > 0"), normalize)


def read_txt(docs: DataFrame, normalize: bool = True) -> DataFrame:
    """Every line with text; ``[start-end]`` in front gives times, else both are 0."""
    lines = _exploded(docs, "\\n").where(F.trim("part") != "").select("doc_id", "at", T.stamped_text(F.col("part")).alias("x"))
    cues = lines.select(
        "doc_id", "at", F.coalesce("x.start", F.lit(0.0)).alias("start"), F.coalesce(F.col("x.end") - F.col("x.start"), F.lit(0.0)).alias("duration"), F.lit(None).cast("string").alias("speaker"), F.col("x.text").alias("text")
    )
    return _numbered(cues, normalize)


def read_microdvd(docs: DataFrame, normalize: bool = True, fps: float = 25.0) -> DataFrame:
    p = "^\\{(\\d+)\\}\\{(\\d+)\\}(.*)$"
    number = lambda k: F.regexp_extract("part", p, k).try_cast("double") / fps
    cues = _exploded(docs, "\\n").where(F.col("part").rlike(p)).select(
        "doc_id", "at", number(1).alias("start"), (number(2) - number(1)).alias("duration"), F.lit(None).cast("string").alias("speaker"), F.replace(F.regexp_extract("part", p, 3), F.lit("|"), F.lit("\n")).alias("text")
    )
    return _numbered(cues, normalize)


def read_sami(docs: DataFrame, normalize: bool = True) -> DataFrame:
    """``SYNC`` blocks; a cue lasts to the next block, blanks only close."""
    parts = _exploded(docs, "(?i)<SYNC\\s+Start\\s*=\\s*\"?").where("at > 0")
    p = "(?s)^(\\d+)\"?[^>]*>\\s*(?:<P[^>]*>)?(.*?)(?:</P>)?\\s*(?:</SYNC>)?\\s*(?:</BODY>.*)?$"
    order = Window.partitionBy("doc_id").orderBy("at")
    start = F.regexp_extract("part", p, 1).try_cast("double") / 1000
    body = F.trim(F.regexp_replace(F.regexp_extract("part", p, 2), "(?i)<br\\s*/?>", "\n"))
    timed = parts.select("doc_id", "at", start.alias("start"), body.alias("text")).withColumn("duration", F.lead("start").over(order) - F.col("start"))
    return _numbered(timed.where("text <> '' and text <> '&nbsp;'").withColumn("speaker", F.lit(None).cast("string")), normalize)


def read_ass(docs: DataFrame, normalize: bool = True) -> DataFrame:
    """Events of ASS and SSA; override tags are taken off, ``\\N`` breaks lines, comments are skipped."""
    events = _exploded(docs, "\\n").where(F.startswith("part", F.lit("Dialogue:")))
    field = F.split(F.regexp_replace("part", "^Dialogue:\\s*", ""), ",", 10)
    start, end = K.parse_clock(F.get(field, F.lit(1))), K.parse_clock(F.get(field, F.lit(2)))
    raw = F.get(field, F.lit(9))
    plain = F.regexp_replace(F.regexp_replace(raw, "\\{[^}]*\\}", ""), "\\\\[Nn]", "\n")
    cues = events.select("doc_id", "at", start.alias("start"), (end - start).alias("duration"), F.nullif(F.trim(F.get(field, F.lit(4))), F.lit("")).alias("speaker"), plain.alias("text"))
    return _numbered(cues, normalize)


def read_json(docs: DataFrame, normalize: bool = True) -> DataFrame:
    """A list of cues, or an object with ``supervisions``; ``duration`` wins over ``end``."""
    item = "array<struct<text:string,start:double,duration:double,end:double,speaker:string>>"
    whole = F.coalesce(F.from_json("content", f"struct<supervisions:{item}>")["supervisions"], F.from_json("content", item))
    cues = _clean(docs).select("doc_id", F.posexplode(whole).alias("at", "c")).select(
        "doc_id", "at", "c.start", F.coalesce("c.duration", F.col("c.end") - F.col("c.start")).alias("duration"), "c.speaker", "c.text"
    )
    return _numbered(cues, normalize)


def read_json3(docs: DataFrame, normalize: bool = True) -> DataFrame:
    """Timed-text events with segments; appended and empty events are skipped."""
    kind = "struct<events:array<struct<tStartMs:double,dDurationMs:double,aAppend:int,segs:array<struct<utf8:string,tOffsetMs:double>>>>>"
    events = _clean(docs).select("doc_id", F.posexplode(F.from_json("content", kind)["events"]).alias("at", "e"))
    said = F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), "")
    cues = events.where("e.segs is not null and coalesce(e.aAppend, 0) = 0 and e.dDurationMs > 0").select(
        "doc_id", "at", (F.col("e.tStartMs") / 1000).alias("start"), (F.col("e.dDurationMs") / 1000).alias("duration"), F.lit(None).cast("string").alias("speaker"), said.alias("text")
    )
    return _numbered(cues.where(F.trim("text") != ""), normalize)


def vtt_header(content: Column) -> Column:
    """What stands before the first cue: struct of ``kind, language, regions, styles, notes`` and the ``pairs`` of one-line notes."""
    plain = F.regexp_replace(F.regexp_replace(content, "\\r\\n?", "\n"), "^\\x{FEFF}", "")
    trimmed = F.transform(F.split(plain, "\\n\\s*\\n"), lambda b: F.regexp_replace(b, "^\\s+|\\s+$", ""))
    is_head = lambda b: b.rlike("^(?:WEBVTT|REGION|STYLE|NOTE)")

    def read(blocks: Column) -> Column:
        stop = F.array_position(F.transform(blocks, lambda b: F.contains(b, F.lit("-->")) & ~is_head(b)), F.lit(True))
        heads = F.filter(F.when(stop > 0, F.slice(blocks, F.lit(1), stop - 1)).otherwise(blocks), is_head)
        of = lambda name: F.filter(heads, lambda b: F.startswith(b, F.lit(name)))
        body = lambda b, name: F.regexp_replace(F.substring(b, len(name) + 1, 1 << 30), "^\\s+", "")
        fact = lambda name: F.nullif(F.trim(F.regexp_extract(F.get(of("WEBVTT"), F.lit(0)), f"(?m)^\\s*{name}:(.*)$", 1)), F.lit(""))
        parts = lambda b: F.filter(F.split(b, "\n"), lambda x: F.contains(x, F.lit(":")))
        pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("value"))
        regions = F.transform(of("REGION"), lambda b: F.map_from_entries(F.transform(parts(b), pair)))
        notes = F.filter(F.transform(of("NOTE"), lambda b: body(b, "NOTE")), lambda x: x != "")
        single = F.filter(notes, lambda x: x.rlike("^\\w+:\\s*.+$") & ~F.contains(x, F.lit("\n")))
        told = F.transform(single, lambda x: F.struct(F.lower(F.regexp_extract(x, "^(\\w+):", 1)).alias("key"), F.trim(F.regexp_extract(x, "^\\w+:\\s*(.+)$", 1)).alias("value")))
        return F.struct(
            fact("Kind").alias("kind"), fact("Language").alias("language"), regions.alias("regions"),
            F.filter(F.transform(of("STYLE"), lambda b: body(b, "STYLE")), lambda x: x != "").alias("styles"), notes.alias("notes"), F.map_from_entries(told).alias("pairs"),
        )

    return T.let(trimmed, read)


def vtt_head(meta: Column) -> Column:
    """The text before the first cue out of the struct ``vtt_header`` gives."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    first = F.concat_ws("\n", F.lit("WEBVTT"), line("Kind", meta["kind"]), line("Language", meta["language"]))
    regions = F.transform(meta["regions"], lambda m: F.concat(F.lit("REGION\n"), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"])), "\n")))
    styles = F.transform(meta["styles"], lambda x: F.concat(F.lit("STYLE\n"), x))
    notes = F.transform(meta["notes"], lambda x: F.concat(F.lit("NOTE"), F.when(F.contains(x, F.lit("\n")), "\n").otherwise(" "), x))
    return F.concat(F.array_join(F.concat(F.array(first), regions, styles, notes), "\n\n"), F.lit("\n\n"))


def read_vtt_settings(docs: DataFrame) -> DataFrame:
    """``doc_id, cue_idx, cue_id, settings`` (a map) of every cue of WebVTT documents, in the order ``read_vtt`` numbers them."""
    stamp = "(?:\\d+:)?\\d+:\\d+[,.]\\d+"
    p = f"(?s)^\\n*(?:([^\\n]*)\\n)?{stamp}[ \\t]*-->[ \\t]*{stamp}[ \\t]*([^\\n]*)"
    found = _exploded(docs, "\\n[ \\t]*\\n+").where(F.col("part").rlike(p))
    order = Window.partitionBy("doc_id").orderBy("at")
    return found.select(
        "doc_id", (F.row_number().over(order) - 1).alias("cue_idx"), F.nullif(F.trim(F.regexp_extract("part", p, 1)), F.lit("")).alias("cue_id"), T.cue_settings(F.regexp_extract("part", p, 2)).alias("settings")
    )


# ---- writers


def usable(cues: DataFrame) -> DataFrame:
    return cues.where("start >= 0 and duration > 0 and text is not null")


def gathered(cues: DataFrame, part: Column, sep: str, head: Column | str = "", tail: Column | str = "", extra: tuple[Column, ...] = ()) -> DataFrame:
    """One content per document: ``part`` of each cue in order of position; a document is one file by definition."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    order = Window.partitionBy("doc_id").orderBy("cue_idx")
    numbered = usable(cues).withColumn("nr", F.row_number().over(order)).withColumn("__part", part)
    if extra:
        numbered = numbered.select("*", *extra)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nr", "__part"))), lambda x: x["__part"]), sep)
    return numbered.groupBy("doc_id").agg(F.concat(lit(head), joined, lit(tail)).alias("content"))


def _end() -> Column:
    return F.col("start") + F.col("duration")


def _said(speakers: bool) -> Column:
    body = F.col("text")
    return F.concat(T.speaker_prefix(F.col("speaker")), body) if speakers else body


def _nr() -> Column:
    return F.col("nr").cast("string")


def write_srt(cues: DataFrame, speakers: bool = False) -> DataFrame:
    return gathered(cues, F.concat(_nr(), F.lit("\n"), K.vtt_stamp_comma(F.col("start")), F.lit(" --> "), K.vtt_stamp_comma(_end()), F.lit("\n"), _said(speakers)), "\n\n", tail="\n")


def write_srt_content(cues: DataFrame, include_speaker: bool = True, byte_order_mark: bool = True) -> DataFrame:
    """A second way to SRT: cut milliseconds, a byte-order mark, and no label where ``original_speaker`` is false."""
    own = F.col("original_speaker") if "original_speaker" in cues.columns else F.lit(None).cast("boolean")
    named = F.lit(include_speaker) & F.coalesce(F.col("speaker") != "", F.lit(False)) & F.coalesce(own, F.lit(True))
    label = F.when(named, F.concat(F.col("speaker"), F.when(F.col("speaker") == ">>", " ").otherwise(": "))).otherwise("")
    part = F.concat_ws("\n", _nr(), F.concat(K.srt_stamp(F.col("start")), F.lit(" --> "), K.srt_stamp(_end())), F.concat(label, F.trim("text")))
    return gathered(cues, part, "\n\n", head="\ufeff" if byte_order_mark else "", tail="\n")


def write_vtt(cues: DataFrame, speakers: bool = False) -> DataFrame:
    return gathered(cues, F.concat(_nr(), F.lit("\n"), K.vtt_stamp(F.col("start")), F.lit(" --> "), K.vtt_stamp(_end()), F.lit("\n"), _said(speakers)), "\n\n", head="WEBVTT\n\n", tail="\n")


def write_sbv(cues: DataFrame, speakers: bool = False) -> DataFrame:
    return gathered(cues, F.concat(K.sbv_stamp(F.col("start")), F.lit(","), K.sbv_stamp(_end()), F.lit("\n"), _said(speakers)), "\n\n", tail="\n")


def write_lrc(cues: DataFrame, speakers: bool = False) -> DataFrame:
    return gathered(cues, F.concat(F.lit("["), K.lrc_stamp(F.col("start")), F.lit("]"), T.squash(_said(speakers))), "\n", tail="\n")


def _quoted(value: Column) -> Column:
    return F.when(value.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def write_csv(cues: DataFrame, speakers: bool = False) -> DataFrame:
    ms = lambda c: F.rint(c * 1000).cast("long").cast("string")
    cells = [F.coalesce("speaker", F.lit(""))] if speakers else []
    return gathered(
        cues, F.concat_ws(",", *(_quoted(c) for c in cells), ms(F.col("start")), ms(_end()), _quoted(T.squash(_said(speakers)))), "\n", head="speaker,start,end,text\n" if speakers else "start,end,text\n", tail="\n"
    )


def write_tsv(cues: DataFrame, speakers: bool = False) -> DataFrame:
    ms = lambda c: F.rint(c * 1000).cast("long").cast("string")
    cells = [F.coalesce("speaker", F.lit(""))] if speakers else []
    return gathered(cues, F.concat_ws("\t", *cells, ms(F.col("start")), ms(_end()), T.squash(F.col("text"))), "\n", head="speaker\tstart\tend\ttext\n" if speakers else "start\tend\ttext\n", tail="\n")


def write_aud(cues: DataFrame, speakers: bool = False) -> DataFrame:
    tag = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit("[["), F.col("speaker"), F.lit("]]"))).otherwise("") if speakers else F.lit("")
    return gathered(cues, F.concat(F.concat(K.fixed(F.col("start"), 6), F.lit("\t"), K.fixed(_end(), 6), F.lit("\t")), tag, T.squash(F.col("text"))), "\n", tail="\n")


def write_txt(cues: DataFrame, speakers: bool = False) -> DataFrame:
    return gathered(cues, F.concat(F.concat(F.lit("["), K.fixed(F.col("start"), 2), F.lit("-"), K.fixed(_end(), 2), F.lit("] ")), T.squash(_said(speakers))), "\n", tail="\n")


def write_microdvd(cues: DataFrame, speakers: bool = False, fps: float = 25.0) -> DataFrame:
    n = lambda c: K.frames(c, fps).cast("string")
    return gathered(cues, F.concat(F.lit("{"), n(F.col("start")), F.lit("}{"), n(_end()), F.lit("}"), F.replace(_said(speakers), F.lit("\n"), F.lit("|"))), "\n", tail="\n")


def write_sami(cues: DataFrame, speakers: bool = False) -> DataFrame:
    ms = lambda c: F.rint(c * 1000).cast("long").cast("string")
    block = F.concat(F.lit("<SYNC Start="), ms(F.col("start")), F.lit("><P>"), F.replace(_said(speakers), F.lit("\n"), F.lit("<br>")), F.lit("\n<SYNC Start="), ms(_end()), F.lit("><P>&nbsp;"))
    return gathered(cues, block, "\n", head="<SAMI><BODY>\n", tail="\n</BODY></SAMI>\n")


ASS_HEAD = """[Script Info]
ScriptType: v4.00+

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,Arial,20,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,2,2,10,10,10,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""
SSA_HEAD = ASS_HEAD.replace("v4.00+", "v4.00").replace("[V4+ Styles]", "[V4 Styles]").replace("Format: Layer,", "Format: Marked,")


def _ass(first: str, head: str) -> Callable[..., DataFrame]:
    def write(cues: DataFrame, speakers: bool = False) -> DataFrame:
        name = F.replace(F.coalesce("speaker", F.lit("")), F.lit(","), F.lit(" ")) if speakers else F.lit("")
        line = F.concat(F.lit(f"Dialogue: {first},"), K.ass_stamp(F.col("start")), F.lit(","), K.ass_stamp(_end()), F.lit(",Default,"), name, F.lit(",0,0,0,,"), F.replace(F.col("text"), F.lit("\n"), F.lit("\\N")))
        return gathered(cues, line, "\n", head=head, tail="\n")

    return write


write_ass, write_ssa = _ass("0", ASS_HEAD), _ass("Marked=0", SSA_HEAD)


def write_json(cues: DataFrame, speakers: bool = True) -> DataFrame:
    item = F.to_json(F.struct(F.round("start", 4).alias("start"), F.round("duration", 4).alias("duration"), F.round(_end(), 4).alias("end"), "text", *(["speaker"] if speakers else [])))
    return gathered(cues, item, ",", head='{"supervisions":[', tail="]}")


def write_json3(cues: DataFrame, speakers: bool = False) -> DataFrame:
    cut = lambda c: F.floor(c * 1000)
    event = F.to_json(F.struct(cut(F.col("start")).alias("tStartMs"), (cut(_end()) - cut(F.col("start"))).alias("dDurationMs"), F.array(F.struct(_said(speakers).alias("utf8"))).alias("segs")))
    return gathered(cues, event, ",", head='{"wireMagic":"pb3","events":[', tail="]}")


def _escaped(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def _ttml(profile: str) -> Callable[..., DataFrame]:
    def write(cues: DataFrame, speakers: bool = False) -> DataFrame:
        body = F.replace(_escaped(_said(speakers)), F.lit("\n"), F.lit("<br/>"))
        p = F.concat(F.lit('<p begin="'), K.ttml_stamp(F.col("start")), F.lit('" end="'), K.ttml_stamp(_end()), F.lit('">'), body, F.lit("</p>"))
        return gathered(cues, p, "\n", head=f'<?xml version="1.0" encoding="UTF-8"?>\n<tt xmlns="http://www.w3.org/ns/ttml"{profile} xml:lang="en"><body><div>\n', tail="\n</div></body></tt>\n")

    return write


write_ttml = _ttml("")
write_imsc1 = _ttml(' xmlns:ttp="http://www.w3.org/ns/ttml#parameter" ttp:profile="http://www.w3.org/ns/ttml/profile/imsc1/text"')
write_ebu_tt_d = _ttml(' xmlns:ttp="http://www.w3.org/ns/ttml#parameter" ttp:timeBase="media"')


def write_srv3(cues: DataFrame, speakers: bool = False) -> DataFrame:
    cut = lambda c: F.floor(c * 1000).cast("string")
    p = F.concat(F.lit('<p t="'), cut(F.col("start")), F.lit('" d="'), (F.floor(_end() * 1000) - F.floor(F.col("start") * 1000)).cast("string"), F.lit('"><s>'), _escaped(_said(speakers)), F.lit("</s></p>"))
    return gathered(cues, p, "\n", head='<?xml version="1.0" encoding="utf-8" ?><timedtext format="3">\n<body>\n', tail="\n</body>\n</timedtext>\n")


def write_markdown(cues: DataFrame, speakers: bool = True) -> DataFrame:
    """A line per cue with its stamp; the speaker only where it changes."""
    order = Window.partitionBy("doc_id").orderBy("cue_idx")
    changed = usable(cues).withColumn("shown", F.when((F.coalesce("speaker", F.lit("")) != "") & ~F.coalesce(F.col("speaker") == F.lag("speaker").over(order), F.lit(False)), F.concat(F.lit("**"), F.col("speaker"), F.lit(":** "))).otherwise(""))
    return gathered(changed, F.concat(F.col("shown") if speakers else F.lit(""), T.squash(F.col("text")), F.lit(" "), K.markdown_stamp(F.col("start"))), "\n\n", tail="\n")


def write_avid(cues: DataFrame, speakers: bool = True, fps: int = 25) -> DataFrame:
    """Timecode lines behind an ``@`` header; the speaker only where it changes."""
    order = Window.partitionBy("doc_id").orderBy("cue_idx")
    fresh = (F.coalesce("speaker", F.lit("")) != "") & ~F.coalesce(F.col("speaker") == F.lag("speaker").over(order), F.lit(False))
    changed = usable(cues).withColumn("shown", F.when(fresh, T.speaker_prefix(F.col("speaker"))).otherwise(""))
    line = F.concat_ws("\t", K.timecode(F.col("start"), fps), K.timecode(_end(), fps), F.concat(F.col("shown") if speakers else F.lit(""), T.squash(F.col("text"))))
    # fixed value: a keyword of the format
    return gathered(changed, line, "\n", head="@ This file written with timed captions\n\n<begin subtitles>\n\n", tail="\n\n<end subtitles>\n")


def write_audition(cues: DataFrame, speakers: bool = True) -> DataFrame:
    name = F.format_string("%s - Marker %03d", F.when(F.coalesce("speaker", F.lit("")) != "", F.col("speaker")).otherwise("Speaker"), "nr")
    line = F.concat_ws(",", _quoted(name), K.fixed(F.col("start"), 3), K.fixed(F.col("duration"), 3), F.lit("decimal"), F.lit("Cue"), _quoted(F.col("text")))
    return gathered(cues, line, "\r\n", head="Name,Start,Duration,Time Format,Type,Description\r\n", tail="\r\n")


def write_edimarker(cues: DataFrame, speakers: bool = True) -> DataFrame:
    name = F.format_string("M%03d_%s", "nr", F.when(F.coalesce("speaker", F.lit("")) != "", F.col("speaker")).otherwise("Speaker"))
    return gathered(cues, F.concat_ws(",", _quoted(name), K.timecode(F.col("start"), 24), K.timecode(_end(), 24), _quoted(T.squash(F.col("text")))), "\n", head="Name,In,Out,Description\n", tail="\n")


def write_fcpxml(cues: DataFrame, speakers: bool = False) -> DataFrame:
    # fixed value: a keyword of the format
    element = F.concat(F.lit('<caption offset="'), K.rational(F.col("start")), F.lit('" duration="'), K.rational(F.col("duration")), F.lit('"><text><text-style ref="ts1">'), _escaped(_said(speakers)), F.lit("</text-style></text></caption>"))
    return gathered(cues, element, "\n", head='<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE fcpxml>\n<fcpxml version="1.10"><library><event><project><sequence><spine><gap offset="0s">\n', tail="\n</gap></spine></sequence></project></event></library></fcpxml>\n")


def write_premiere(cues: DataFrame, speakers: bool = False, fps: int = 25) -> DataFrame:
    f = lambda c: K.frames(c, float(fps)).cast("string")
    clip = F.concat(
        F.lit("<clipitem><name>"), _escaped(F.left(T.squash(F.col("text")), F.lit(50))), F.lit("</name><start>"), f(F.col("start")), F.lit("</start><end>"), f(_end()),
        F.lit("</end><filter><effect><parameter><name>Text</name><value>"), _escaped(_said(speakers)), F.lit("</value></parameter></effect></filter></clipitem>"),
    )
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE xmeml>\n<xmeml version="4"><sequence><rate><timebase>{fps}</timebase><ntsc>FALSE</ntsc></rate><media><video><track>\n'
    return gathered(cues, clip, "\n", head=head, tail="\n</track></video></media></sequence></xmeml>\n")


def write_textgrid(cues: DataFrame, speakers: bool = True) -> DataFrame:
    """One interval tier per speaker, long form; tiers by name."""
    who = F.coalesce(F.nullif("speaker", F.lit("")), F.lit("utterances")) if speakers else F.lit("utterances")
    base = usable(cues).withColumn("tier", who)
    n = F.row_number().over(Window.partitionBy("doc_id", "tier").orderBy("start", "cue_idx"))
    numbered = base.withColumn("n", n)
    interval = F.concat(
        F.lit("        intervals ["), F.col("n").cast("string"), F.lit("]:\n            xmin = "), K.fixed(F.col("start"), 3), F.lit("\n            xmax = "), K.fixed(_end(), 3),
        F.lit('\n            text = "'), F.replace(T.squash(F.col("text")), F.lit('"'), F.lit('""')), F.lit('"\n'),
    )
    tiers = numbered.withColumn("i", interval).groupBy("doc_id", "tier").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "i"))), lambda x: x["i"]), "").alias("body"), F.count("*").alias("size"), F.max(_end()).alias("xmax"))
    joined = tiers.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tier", "body", "size"))).alias("t"), F.max("xmax").alias("xmax"))
    one = F.array_join(
        F.transform("t", lambda x, k: F.concat(F.lit("    item ["), (k + 1).cast("string"), F.lit(']:\n        class = "IntervalTier"\n        name = "'), F.replace(x["tier"], F.lit('"'), F.lit('""')), F.lit('"\n        xmin = 0\n        xmax = '), K.fixed(F.col("xmax"), 3), F.lit("\n        intervals: size = "), x["size"].cast("string"), F.lit("\n"), x["body"])), ""
    )
    head = F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = '), K.fixed(F.col("xmax"), 3), F.lit("\ntiers? <exists>\nsize = "), F.size("t").cast("string"), F.lit("\nitem []:\n"))
    return joined.select("doc_id", F.concat(head, one).alias("content"))


def write_word_vtt(cues: DataFrame) -> DataFrame:
    """WebVTT with a stamp in front of every word but the first; the cue spans its words, marks of markup are escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    first, last = F.get("words", F.lit(0)), F.element_at("words", -1)
    timed = cues.where("size(words) > 0").withColumns({"start": first["start"], "duration": last["start"] + last["duration"] - first["start"]})
    tagged = F.concat(safe(first["symbol"]), F.array_join(F.transform(F.slice("words", 2, 1_000_000), lambda w: F.concat(F.lit("<"), K.vtt_stamp(w["start"]), F.lit("><c> "), safe(w["symbol"]), F.lit("</c>"))), ""))
    # fixed value: a keyword of the format
    return gathered(timed, F.concat(K.vtt_stamp(F.col("start")), F.lit(" --> "), K.vtt_stamp(_end()), F.lit("\n"), tagged), "\n\n", head="WEBVTT\nKind: captions\n\n", tail="\n")


def write_word_lrc(cues: DataFrame) -> DataFrame:
    """Enhanced LRC: a stamp per line and per word."""
    tagged = F.array_join(F.transform("words", lambda w: F.concat(F.lit("<"), K.lrc_stamp(w["start"]), F.lit(">"), w["symbol"])), " ")
    return gathered(cues.where("size(words) > 0"), F.concat(F.lit("["), K.lrc_stamp(F.col("start")), F.lit("]"), tagged), "\n", tail="\n")


def write_word_ass(cues: DataFrame) -> DataFrame:
    """Karaoke events; braces are escaped, and a word joiner keeps a backslash from being read with the letter behind it."""
    from cuemill.operators.words import karaoke_text

    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\u2060")), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    words = F.transform("words", lambda w: w.withField("symbol", safe(w["symbol"])))
    return write_ass(cues.where("size(words) > 0").withColumn("text", karaoke_text(words)))
