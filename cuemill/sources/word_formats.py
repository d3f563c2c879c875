"""Readers and writers that keep the words of formats which time them.

``read_words(docs, fmt)`` gives cues with ``words`` (symbol, start, duration, score) for JSON,
JSON3, SRV3, TTML, LRC and ASS; ``write_words(cues, fmt)`` puts them out again.  A cue
without words is read and written whole.  Where a format gives no length, a word lasts to
the next one and the last to the cue's end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions import text as T
from cuemill.functions import timecode as K
from cuemill.operators.cues import word_level
from cuemill.sources import document_formats as D
from cuemill.sources import text_formats as X

WORD = "struct<symbol:string,start:double,duration:double,score:double>"
SCHEMA = f"{D.SCHEMA}, words array<{WORD}>"
Word = tuple[str, float, float, float | None]
Cue = tuple[float, float, str | None, str, list[Word]]

_INLINE = re.compile(r"<(\d+:\d+(?:\.\d+)?)>")
_LRC = re.compile(r"^\[(\d+:\d+(?:\.\d+)?)\](.*)$")
_KARAOKE = re.compile(r"\{[^}]*?\\(?:k[fo]?|K)(\d+)[^}]*\}([^{]*)")
_CHANGE = re.compile(r"^\s*(?:>>|&gt;&gt;)\s*")


def lasting(words: list[tuple[str, float, float | None]], end: float, least: float = 0.0) -> list[Word]:
    """Words with their lengths: to the next one's start, the last to the end, ``least`` at least."""
    return [(s, t, max(least, (words[k + 1][1] if k + 1 < len(words) else end) - t), score) for k, (s, t, score) in enumerate(words)]


def read_json(content: str) -> list[Cue]:
    """A list of cues, or a document with ``supervisions``; anything else is refused."""
    try:
        data = json.loads(content)
    except ValueError:
        return []
    items = data.get("supervisions") if isinstance(data, dict) else data
    if not isinstance(items, list):
        raise ValueError("neither a list of cues nor a document with supervisions")
    out = []
    for c in items:
        start = float(c.get("start") or 0)
        length = float(c["duration"]) if c.get("duration") is not None else float(c.get("end") or start) - start
        words = []
        for w in c.get("words") or ():
            begin = float(w.get("start") or 0)
            span = float(w["duration"]) if w.get("duration") is not None else float(w.get("end") or begin) - begin
            words.append((w.get("word") or w.get("symbol") or w.get("text") or "", begin, span, w.get("score")))
        out.append((start, length, c.get("speaker"), c.get("text") or "", words))
    return out


def read_json3(content: str) -> list[Cue]:
    try:
        events = json.loads(content).get("events") or ()
    except (ValueError, AttributeError):
        return []
    out = []
    for e in events:
        start, length = float(e.get("tStartMs") or 0) / 1000, float(e.get("dDurationMs") or 0) / 1000
        if not e.get("segs") or e.get("aAppend") or length <= 0:
            continue
        speaker, words, said = None, [], []
        for s in e["segs"]:
            symbol = s.get("utf8") or ""
            if not said and (m := _CHANGE.match(symbol)):
                speaker, symbol = ">>", symbol[m.end() :]
            said.append(symbol)
            if symbol.strip():
                score = s.get("acAsrConf")
                words.append((symbol.strip(), start + float(s.get("tOffsetMs") or 0) / 1000, None if score is None else score / 255 if score > 1 else float(score)))
        if "".join(said).strip():
            out.append((start, length, speaker, "".join(said).strip(), lasting(words, start + length) if len(words) > 1 else []))
    return out


def read_srv3(content: str) -> list[Cue]:
    root = D._root(content)
    out = []
    for p in root.iter("p") if root is not None else ():
        start, length = float(p.get("t") or 0) / 1000, float(p.get("d") or 0) / 1000
        parts = [(s.text or "", start + float(s.get("t") or 0) / 1000) for s in p.iter("s")]
        said = "".join(t for t, _ in parts)
        if p.get("a") != "1" and length > 0 and said.strip():
            words = [(t.strip(), at, None) for t, at in parts if t.strip()]
            out.append((start, length, None, said.strip(), lasting(words, start + length) if len(words) > 1 else []))
    return out


def read_ttml(content: str) -> list[Cue]:
    """Timed spans are words; a paragraph of no length takes theirs."""
    root = D._root(content)
    out = []
    for p in root.iter("p") if root is not None else ():
        start = D.ttml_time(p.get("begin", ""))
        end = D.ttml_time(p.get("end")) if p.get("end") else start + D.ttml_time(p.get("dur", "0s"))
        words = []
        for s in p.iter("span"):
            if s.get("begin") and D._text(s).strip():
                begin = D.ttml_time(s.get("begin"))
                stop = D.ttml_time(s.get("end")) if s.get("end") else begin + D.ttml_time(s.get("dur", "0s"))
                words.append((D._text(s).strip(), begin, max(0.0, stop - begin), None))
        if end <= start and words:
            start, end = words[0][1], words[-1][1] + words[-1][2]
        if D._text(p).strip():
            out.append((start, max(0.0, end - start), None, D._text(p).strip(), words))
    return sorted(out, key=lambda c: c[0])


def read_lrc(content: str, last: float = 5.0) -> list[Cue]:
    """Stamps in angle brackets time words, which have no length of their own."""
    lines = [(D.clock(m[1]) or 0.0, m[2]) for m in map(_LRC.match, content.split("\n")) if m]
    out = []
    for k, (start, body) in enumerate(lines):
        parts = _INLINE.split(body)
        words = [(w.strip(), D.clock(t) or 0.0, 0.0, None) for t, w in zip(parts[1::2], parts[2::2], strict=False) if w.strip()]
        out.append((start, lines[k + 1][0] - start if k + 1 < len(lines) else last, None, " ".join(_INLINE.sub("", body).split()), words))
    return out


def lrc_tags(content: str) -> dict[str, str]:
    """Tags of the first fifty lines, such as ``ti`` and ``ar``."""
    found = (re.match(r"^\[([a-zA-Z]\w*):(.*)\]\s*$", line.strip()) for line in content.split("\n")[:50])
    return {m[1].lower(): m[2].strip() for m in found if m}


def read_ass(content: str) -> list[Cue]:
    """Karaoke tags time syllables in hundredths from the line's start."""
    out = []
    for line in content.split("\n"):
        field = line[len("Dialogue:") :].strip().split(",", 9) if line.startswith("Dialogue:") else ()
        start, end = (D.clock(field[1]), D.clock(field[2])) if len(field) == 10 else (None, None)
        if start is None or end is None:
            continue
        words, at = [], start
        for length, symbol in _KARAOKE.findall(field[9]):
            if symbol.strip():
                words.append((symbol.strip(), round(at, 4), int(length) / 100, None))
            at += int(length) / 100
        plain = re.sub(r"\{[^}]*\}", "", field[9]).replace("\\N", "\n").replace("\\n", "\n").strip()
        out.append((start, end - start, field[4].strip() or None, plain, words))
    return out


READERS: dict[str, Callable[[str], list[Cue]]] = {"json": read_json, "json3": read_json3, "srv3": read_srv3, "ttml": read_ttml, "lrc": read_lrc, "ass": read_ass}


def read_words(docs: DataFrame, fmt: str) -> DataFrame:
    """Cues of documents (``doc_id``, ``content``) with ``words``, null where a cue has none."""
    parse = READERS[fmt]
    item = pa.struct([("symbol", pa.string()), ("start", pa.float64()), ("duration", pa.float64()), ("score", pa.float64())])
    arrow = pa.schema([("doc_id", pa.int64()), ("cue_idx", pa.int32()), ("start", pa.float64()), ("duration", pa.float64()), ("speaker", pa.string()), ("text", pa.string()), ("words", pa.list_(item))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, (start, length, speaker, said, words) in enumerate(parse(content.replace("\r\n", "\n").lstrip("﻿"))):
                    held = [dict(zip(("symbol", "start", "duration", "score"), w, strict=True)) for w in words]
                    rows.append({"doc_id": doc, "cue_idx": k, "start": start, "duration": length, "speaker": speaker, "text": said, "words": held or None})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return docs.where("content is not null").select("doc_id", "content").mapInArrow(work, SCHEMA)


# ---- writers


def _ms(seconds: Column) -> Column:
    return F.floor(F.round(seconds * 1000, 3)).cast("long")


def _json(cues: DataFrame) -> DataFrame:
    """A document of version 2: sparse fields, four digits, and computed duration, number and speakers."""
    r = lambda c: F.round(c, 4)
    words = F.when(F.size("words") > 0, F.transform("words", lambda w: F.struct(w["symbol"].alias("word"), r(w["start"]).alias("start"), r(w["start"] + w["duration"]).alias("end"))))
    names = F.nullif("speaker", F.lit(""))
    part = F.to_json(F.struct(r(F.col("start")).alias("start"), r(F.col("start") + F.col("duration")).alias("end"), r(F.col("duration")).alias("duration"), F.col("text").alias("text"), names.alias("speaker"), words.alias("words")))
    kept = X.usable(cues).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_idx", part.alias("p")))), lambda x: x["p"]), ",").alias("body"),
        F.round(F.max(F.col("start") + F.col("duration")), 4).alias("duration"), F.count("*").alias("n"), F.array_sort(F.collect_set(names)).alias("speakers"),
    )
    head = F.to_json(F.struct(F.lit(2).alias("version"), "duration", F.col("n").alias("num_segments"), "speakers"))
    return kept.select("doc_id", F.concat(F.regexp_replace(head, "\\}$", ""), F.lit(',"supervisions":['), "body", F.lit("]}")).alias("content"))


def _json3(cues: DataFrame) -> DataFrame:
    """A window event up to the last end, then an event per cue and one that appends a line break behind it."""
    segs = F.when(F.size("words") > 0, F.transform("words", lambda w, i: F.struct(F.concat(F.when(i > 0, " ").otherwise(""), w["symbol"]).alias("utf8"), F.when(i > 0, _ms(w["start"] - F.col("start"))).alias("tOffsetMs"))))
    whole = F.array(F.struct(F.col("text").alias("utf8"), F.lit(None).cast("long").alias("tOffsetMs")))
    length = _ms(F.col("start") + F.col("duration")) - _ms(F.col("start"))
    event = F.to_json(F.struct(_ms(F.col("start")).alias("tStartMs"), length.alias("dDurationMs"), F.coalesce(segs, whole).alias("segs")))
    after = F.to_json(F.struct(_ms(F.col("start") + F.col("duration")).alias("tStartMs"), F.lit(1).alias("aAppend"), F.array(F.struct(F.lit("\n").alias("utf8"))).alias("segs")))
    ends = X.usable(cues).groupBy("doc_id").agg(_ms(F.max(F.col("start") + F.col("duration"))).alias("last"))
    body = X.gathered(cues, F.concat(event, F.lit(","), after), ",")
    return body.join(ends, "doc_id").select("doc_id", F.concat(F.lit('{"wireMagic":"pb3","events":[{"tStartMs":0,"dDurationMs":'), F.col("last").cast("string"), F.lit(',"id":1},'), "content", F.lit("]}")).alias("content"))


def _srv3(cues: DataFrame) -> DataFrame:
    parts = F.transform("words", lambda w, i: F.concat(F.lit("<s"), F.when(i > 0, F.concat(F.lit(' t="'), _ms(w["start"] - F.col("start")).cast("string"), F.lit('"'))).otherwise(""), F.lit(">"), F.when(i > 0, " ").otherwise(""), X._escaped(w["symbol"]), F.lit("</s>")))
    body = F.when(F.size("words") > 0, F.array_join(parts, "")).otherwise(F.concat(F.lit("<s>"), X._escaped(F.col("text")), F.lit("</s>")))
    length = _ms(F.col("start") + F.col("duration")) - _ms(F.col("start"))
    p = F.concat(F.lit('<p t="'), _ms(F.col("start")).cast("string"), F.lit('" d="'), length.cast("string"), F.lit('">'), body, F.lit("</p>"))
    return X.gathered(cues, p, "\n", head='<?xml version="1.0" encoding="utf-8" ?><timedtext format="3">\n<body>\n', tail="\n</body>\n</timedtext>\n")


def _ttml(cues: DataFrame) -> DataFrame:
    """Speakers in bold, translations on their own line, words in timed spans."""
    span = lambda w: F.concat(F.lit('<span begin="'), K.ttml_stamp(w["start"]), F.lit('" end="'), K.ttml_stamp(w["start"] + w["duration"]), F.lit('">'), X._escaped(w["symbol"]), F.lit("</span>"))
    body = F.when(F.size("words") > 0, F.array_join(F.transform("words", span), " ")).otherwise(F.replace(X._escaped(F.col("text")), F.lit("\n"), F.lit("<br/>")))
    name = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit('<span tts:fontWeight="bold">'), X._escaped(F.trim(T.speaker_prefix(F.col("speaker")))), F.lit("</span> "))).otherwise("")
    other = F.col("translation") if "translation" in cues.columns else F.lit(None).cast("string")
    below = F.when(F.coalesce(other, F.lit("")) != "", F.concat(F.lit("<br/>"), X._escaped(other))).otherwise("")
    p = F.concat(F.lit('<p begin="'), K.ttml_stamp(F.col("start")), F.lit('" end="'), K.ttml_stamp(F.col("start") + F.col("duration")), F.lit('">'), name, body, below, F.lit("</p>"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<tt xmlns="http://www.w3.org/ns/ttml" xmlns:tts="http://www.w3.org/ns/ttml#styling" xml:lang="en"><body><div>\n'
    return X.gathered(cues, p, "\n", head=head, tail="\n</div></body></tt>\n")


WRITERS: dict[str, Callable[[DataFrame], DataFrame]] = {"json": _json, "json3": _json3, "srv3": _srv3, "ttml": _ttml}


def write_words(cues: DataFrame, fmt: str, wanted: bool | None = True) -> DataFrame:
    """Documents (``doc_id``, ``content``) with words where the option and the data give them; ``wanted`` as in ``word_level``."""
    if "words" not in cues.columns:
        cues = cues.withColumn("words", F.lit(None).cast("array<struct<symbol:string,start:double,duration:double>>"))
    if not word_level(wanted, 1, 1, fmt):
        cues = cues.withColumn("words", F.slice("words", 1, 0))
    return WRITERS[fmt](cues)
