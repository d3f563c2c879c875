"""Readers of formats with nested markup, one document at a time in Arrow batches."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, cue_idx int, start double, duration double, speaker string, text string"
Cue = tuple[float, float, str | None, str]

_CLOCK = re.compile(r"^(?:(\d+):)?(\d{1,2}):(\d{1,2}(?:[.,]\d+)?)$")
_FRAMED = re.compile(r"^(\d+):(\d{2}):(\d{2})[:;](\d{2,3})$")
_STAMP = re.compile(r"\[?(\d{1,2}:\d{2}(?::\d{2})?(?:\.\d{1,3})?)\]?")


def clock(text: str) -> float | None:
    m = _CLOCK.match(text.strip())
    return None if not m else int(m[1] or 0) * 3600 + int(m[2]) * 60 + float(m[3].replace(",", "."))


def framed(text: str, fps: float) -> float | None:
    m = _FRAMED.match(text.strip())
    return None if not m else int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3]) + int(m[4]) / (29.97 if ";" in text else fps)


def ttml_time(text: str) -> float:
    """Clock, clock with frames at 30, or an offset in s, ms or f; else 0."""
    text = (text or "").strip()
    found = clock(text)
    if found is None:
        found = framed(text, 30.0)
    if found is not None:
        return found
    m = re.match(r"^([\d.]+)(ms|s|f|h|m)?$", text)
    return float(m[1]) * {"ms": 0.001, "f": 1 / 30, "h": 3600.0, "m": 60.0}.get(m[2] or "s", 1.0) if m else 0.0


def _root(content: str) -> ET.Element | None:
    """Root without namespaces; None for a document that cannot be parsed."""
    try:
        root = ET.fromstring(content.encode("utf-8"))
    except ET.ParseError:
        return None
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rsplit("}", 1)[-1]
    return root


def _text(e: ET.Element) -> str:
    out = [e.text or ""]
    for c in e:
        out += ["\n" if c.tag == "br" else _text(c), c.tail or ""]
    return "".join(out)


def ttml(content: str) -> list[Cue]:
    root = _root(content)
    out = []
    for p in root.iter("p") if root is not None else ():
        start = ttml_time(p.get("begin", ""))
        end = ttml_time(p.get("end")) if p.get("end") else start + ttml_time(p.get("dur", "0s"))
        if _text(p).strip():
            out.append((start, max(0.0, end - start), None, _text(p).strip()))
    return sorted(out, key=lambda c: c[0])


def srv3(content: str) -> list[Cue]:
    root = _root(content)
    out = []
    for p in root.iter("p") if root is not None else ():
        length = float(p.get("d", 0))
        said = "".join(s.text or "" for s in p.iter("s"))
        if p.get("a") != "1" and length > 0 and said.strip():
            out.append((float(p.get("t", 0)) / 1000, length / 1000, None, said))
    return out


def textgrid(content: str) -> list[Cue]:
    """Long or short form; every labelled interval of every tier, the tier's name as speaker."""
    tokens = re.findall(r'"(?:[^"]|"")*"|-?\d+(?:\.\d+)?(?=\s|$)|<exists>', re.sub(r"\b(?:item|intervals|points)\s*\[\d*\]:?", " ", content))
    strings = lambda t: t[1:-1].replace('""', '"')
    out, k = [], 0
    while k < len(tokens):
        if tokens[k] in ('"IntervalTier"', '"TextTier"'):
            points = tokens[k] == '"TextTier"'
            name, size = strings(tokens[k + 1]), int(float(tokens[k + 4]))
            k += 5
            for _ in range(size):
                if points:
                    k += 2
                    continue
                start, end, label = float(tokens[k]), float(tokens[k + 1]), strings(tokens[k + 2])
                k += 3
                if label:
                    out.append((start, end - start, name, label))
        else:
            k += 1
    return sorted(out, key=lambda c: c[0])


def comma_rows(content: str) -> list[Cue]:
    """``start, end, text`` or ``speaker, start, end, text`` in milliseconds, told by the header; further cells belong to the text.

    Quoted cells may hold commas and line breaks; rows that are none are skipped.
    """
    rows = [r for r in csv.reader(io.StringIO(content)) if r]
    head = [c.strip().lower() for c in rows[0]] if rows else []
    named = "speaker" in head
    out = []
    for row in rows[1:] if {"start", "end", "text"} <= {*head} else rows:
        shift = 1 if named and len(row) >= 4 else 0
        try:
            start, end = float(row[shift]) / 1000, float(row[shift + 1]) / 1000
        except (ValueError, IndexError):
            continue
        if end > start and len(row) > shift + 2:
            out.append((start, end - start, (row[0].strip() or None) if shift else None, ",".join(row[shift + 2 :]).strip()))
    return out


def audition(content: str, rate: int = 48_000) -> list[Cue]:
    """Markers with commas or tabs between the cells; times in seconds or samples; the text is the description, else a telling name."""
    first = content.split("\n", 1)[0]
    table = csv.DictReader(io.StringIO(content), delimiter="\t" if first.count("\t") > first.count(",") else ",")
    out = []
    for row in table:
        name, said = row.get("Name") or "", row.get("Description") or ""
        per = rate if "sample" in (row.get("Time Format") or "") or (row.get("Time Format") or "").startswith("48000") else 1
        try:
            start, length = float(row["Start"]) / per, float(row["Duration"]) / per
        except (KeyError, TypeError, ValueError):
            continue
        said = said or ("" if name.startswith("Marker ") else name)
        m = re.match(r"^(.*) - Marker \d+$", name)
        if length > 0 and said:
            out.append((start, length, m[1] if m and m[1] != "Speaker" else None, said.strip()))
    return sorted(out, key=lambda c: c[0])


def avid(content: str, fps: float = 25.0) -> list[Cue]:
    out = []
    for line in content.split("\n"):
        part = line.split("\t", 2)
        if len(part) < 3:
            continue
        start, end = framed(part[0], fps), framed(part[1], fps)
        if start is not None and end is not None and end > start:
            out.append((start, end - start, None, part[2].strip()))
    return sorted(out, key=lambda c: c[0])


def _rational(text: str | None) -> float:
    m = re.match(r"^(-?[\d.]+)(?:/([\d.]+))?s$", text or "")
    return float(m[1]) / float(m[2] or 1) if m else 0.0


def fcpxml(content: str) -> list[Cue]:
    root = _root(re.sub(r"<!DOCTYPE[^>]*>", "", content))
    out = []
    # fixed value: the element of the format
    for c in root.iter("caption") if root is not None else ():
        said = "".join("".join(t.itertext()) for t in c.iter("text"))
        length = _rational(c.get("duration"))
        if length > 0 and said.strip():
            out.append((_rational(c.get("offset")), length, None, said))
    return sorted(out, key=lambda c: c[0])


def premiere(content: str) -> list[Cue]:
    root = _root(re.sub(r"<!DOCTYPE[^>]*>", "", content))
    if root is None:
        return []
    fps = float(root.findtext(".//sequence/rate/timebase") or 25)
    if (root.findtext(".//sequence/rate/ntsc") or "").upper() == "TRUE":
        fps = {24.0: 23.976, 30.0: 29.97, 60.0: 59.94}.get(fps, fps)
    out = []
    for clip in root.iter("clipitem"):
        said = next((p.findtext("value") or "" for p in clip.iter("parameter") if (p.findtext("name") or "") == "Text"), "")
        start, end = float(clip.findtext("start") or 0) / fps, float(clip.findtext("end") or 0) / fps
        if said and end > start:
            out.append((start, end - start, None, said))
    return sorted(out, key=lambda c: c[0])


def reader(parse: Callable[[str], list[Cue]]) -> Callable[..., DataFrame]:
    """A DataFrame reader of ``doc_id, content`` out of a function over one content."""

    def read(docs: DataFrame, normalize: bool = True) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for k, (start, length, speaker, said) in enumerate(parse((content or "").replace("\r\n", "\n"))):
                        rows.append((doc, k, start, length, speaker, " ".join(said.split(" ")) if normalize else said))
                c = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], ["doc_id", "cue_idx", "start", "duration", "speaker", "text"])

        return docs.where("content is not null").select("doc_id", "content").mapInArrow(work, SCHEMA)

    return read


# ---- cues with a stamp on each word, as video sites deliver them

WORD_SCHEMA = SCHEMA + ", words array<struct<symbol:string,start:double,duration:double>>"
_CUE_LINE = re.compile(r"^((?:\d+:)?\d+:\d+\.\d+)\s+-->\s+((?:\d+:)?\d+:\d+\.\d+)")
_WORD_STAMP = re.compile(r"<((?:\d+:)?\d+:\d+\.\d+)>")
ECHO = 0.010


def _plain(text: str) -> str:
    """The three escapes of WebVTT text undone."""
    return text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")


def rolling_words(content: str) -> list[tuple[float, float, str | None, str, list[tuple[str, float, float]]]]:
    """Cues of a rolling word-level document.

    Only the line with word stamps is new in a cue; the line above repeats what was
    shown.  Echo cues of 10 ms hold no stamps and are dropped, and so is an unstamped cue
    that directly follows one, but for its last line, which ends the cue before.  A word
    lasts to the next word's stamp, the last to the cue's end, 10 ms at least.
    """
    cues: list[list] = []
    for line in content.replace("\r\n", "\n").split("\n"):
        m = _CUE_LINE.match(line.strip())
        if m:
            cues.append([clock(m[1]), clock(m[2]), []])
        elif cues and line.strip():
            cues[-1][2].append(line)
    out: list = []
    after_echo = None
    for start, end, lines in cues:
        stamped = [x for x in lines if _WORD_STAMP.search(x)]
        if not stamped:
            if abs(end - start - ECHO) < 0.001:
                after_echo = end
            elif after_echo is not None and abs(start - after_echo) < 0.001 and out and len(lines) > 1:
                tail = _plain(re.sub(r"<[^>]*>", "", lines[-1]).strip())
                first, length, who, said, words = out[-1]
                out[-1] = (first, length, who, f"{said} {tail}", [*words, (tail, first + length, ECHO)])
            continue
        speaker, words, now = None, [], start
        for k, piece in enumerate(_WORD_STAMP.split(" ".join(stamped))):
            if k % 2:
                now = clock(piece)
                continue
            symbol = re.sub(r"<[^>]*>", "", piece).strip()  # class tags
            m = re.match(r"^(?:>>|&gt;&gt;)\s*(.*)$", symbol)
            if m:
                speaker, symbol = ">>", m[1]
            if symbol:
                words.append([_plain(symbol), now])
        timed = [(s, t, max(0.01, (words[k + 1][1] if k + 1 < len(words) else end) - t)) for k, (s, t) in enumerate(words)]
        if timed:
            out.append((start, end - start, speaker, " ".join(s for s, _, _ in timed), timed))
    return out


def read_word_vtt(docs: DataFrame) -> DataFrame:
    """Word-level documents with their ``words``; a null content gives no cue."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.list_(pa.struct([("symbol", pa.string()), ("start", pa.float64()), ("duration", pa.float64())])))
        for batch in batches:
            rows = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (start, length, speaker, said, words) in enumerate(rolling_words(content or "")):
                    rows.append((doc, k, start, length, speaker, said, [{"symbol": s, "start": a, "duration": d} for s, a, d in words]))
            c = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], ["doc_id", "cue_idx", "start", "duration", "speaker", "text", "words"])

    return docs.where("content is not null").select("doc_id", "content").mapInArrow(work, WORD_SCHEMA)
