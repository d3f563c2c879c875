"""Markdown transcripts: front matter, segments of dialogue, events and sections, cues with inferred times, and the way back.

A line is read by the first rule that fits it.  Times a line lacks are taken from its
neighbours or from how long its text takes to say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import timecode as K
from cuemill.functions.text import squash

LEAST_DURATION = 0.1
MERGE_GAP = 2.0
WORDS_PER_SECOND, CHARACTERS_PER_SECOND, WIDE_SHARE, LEAST_ESTIMATE = 3.3, 4.0, 0.3, 0.3
# Fields of the front matter in order.
FRONT_FIELDS = ("title", "channel", "url", "date", "duration", "language", "target_lang", "description", "tags")

_FRONT = re.compile(r"\A---\s*\n(.*?)\n---\s*(?:\n|\Z)", re.DOTALL)
_THINKING = re.compile(r"<thinking>.*?</thinking>", re.DOTALL)
_FIELD = re.compile(r"^(\w[\w-]*)\s*:\s*(.*)$")
_T = r"\d{1,2}:\d{2}(?::\d{2})?(?:\.\d{1,3})?"
_LONG_T = r"\d{1,2}:\d{2}:\d{2}(?:\.\d{1,3})?"
_WIDE = re.compile("[一-鿿぀-ヿ가-힯㐀-䶿豈-﫿]")
_LETTER = "a-zA-Z぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"
_LINK = r"\[\[\d{1,2}:\d{2}\]\([^)]*&t=(?P<seconds>\d+)\)\]"
_INLINE = tuple(
    re.compile(p)
    for p in (
        rf"\[(?P<start>{_T})\]\s*(?P<text>.+?)\s*\[(?P<end>{_T})\]$",
        rf"(?P<text>.+?)\s*\[(?P<start>{_T})\s*→\s*(?P<end>{_T})\]$",
        rf"\[(?P<start>{_T})\]\s*(?P<text>.+)$",
        rf"(?P<text>.+?)\s*\[(?P<end>{_T})\]$",
        rf"(?P<text>.+?)\s*{_LINK}$",
    )
)
_SKIPPED = re.compile(rf"\[{_T}\s+[^\]]+\]\(|_(?!_).*_$|\* \[|## Table of Contents|!\[.*?\]\(.*?\)")
_TRANSLATED = re.compile(r">\s*\[(?P<lang>[\w-]+)\]\s*(?P<text>.+)$")
_SECTION = tuple(re.compile(p) for p in (rf"##\s*\[(?P<start>{_LONG_T})\]\s*(?P<text>.+)$", rf"##\s*{_LINK}\s*(?P<text>.+)$", rf"##\s+(?P<text>.+?)\s+\[(?P<start>{_T})\]$"))
_BARE_SECTION = re.compile(rf"#{{2,4}}\s+(?P<start>{_LONG_T})\s+(?P<text>.+)$")
_STAMP = re.compile(rf"\[(?P<end>{_T})\]$")
_EVENTS = re.compile(rf"(?P<events>\[[^\]]*[{_LETTER}][^\]]*\](?:\s+\[[^\]]*[{_LETTER}][^\]]*\])+)\s+\[(?P<start>{_T})\]$")
_EVENT = re.compile(rf"\[(?P<event>[^\]]+)\]\s*\[(?P<start>{_T})\]$")
_BOLD = re.compile(r"\*\*(?P<speaker>.+?[:：])\*\*\s*(?P<text>.+)$")
_PLAIN = re.compile(r"(?P<speaker>[A-Z][a-zA-Z'\-]+(?:\s+[A-Za-z'\-]+){0,3}):\s+(?P<text>.+)$")


@dataclass
class Segment:
    """One line, or several that go on; kinds are dialogue, event and section_header."""

    kind: str
    text: str
    line: int
    start: float | None = None
    end: float | None = None
    speaker: str | None = None
    section: str | None = None
    translation: str | None = None


def seconds(stamp: str) -> float:
    """``[HH:]MM:SS[.m]``; one or two digits behind the point are tenths or hundredths."""
    total = 0.0
    for part in stamp.split(":"):
        total = total * 60 + float(part)
    return total


def front_matter(content: str) -> dict[str, str | float]:
    """Flat fields between the dashes: quotes taken off, blocks behind ``|`` or ``>`` joined; ``duration`` is a number."""
    m = _FRONT.match(content)
    out: dict[str, str | float] = {}
    key, block = None, None
    for line in m[1].split("\n") if m else ():
        f = _FIELD.match(line)
        if f:
            key, value = f[1], f[2].strip()
            block = value[:1] if value[:1] in "|>" and value else None
            out[key] = "" if block else value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
        elif key and block and line.strip():
            out[key] = f"{out[key]}{chr(10) if block == '|' else ' '}{line.strip()}" if out[key] else line.strip()
    if "duration" in out:
        try:
            out["duration"] = float(out["duration"])
        except ValueError:
            pass
    return out


def inline_stamps(text: str) -> tuple[str, float | None, float | None]:
    """(text, start, end): both, a range, a start, an end or a link, whichever fits first."""
    text = text.strip()
    for pattern in _INLINE:
        if m := pattern.match(text):
            got = m.groupdict()
            stamp = lambda k, got=got: seconds(got[k]) if got.get(k) else None
            return got["text"].strip(), stamp("start"), float(got["seconds"]) if got.get("seconds") else stamp("end")
    return text, None, None


def segments(content: str, target_lang: str | None = None, sections: bool = True) -> list[Segment]:
    """All segments of a transcript in order."""
    target_lang = target_lang or front_matter(content).get("target_lang")
    body = _THINKING.sub("", _FRONT.sub("", content))
    out: list[Segment] = []
    section, section_start, podcast = None, None, False

    def dialogue(text: str, number: int, speaker: str | None = None, default: float | None = None) -> None:
        said, start, end = inline_stamps(text)
        out.append(Segment("dialogue", said, number, default if start is None else start, end, speaker, section))

    for number, line in enumerate((x.strip() for x in body.splitlines()), 1):
        last = out[-1] if out and out[-1].kind == "dialogue" else None
        if not line or _SKIPPED.match(line):
            continue
        if target_lang and (m := _TRANSLATED.match(line)) and m["lang"] == target_lang:
            if last:
                last.translation = m["text"].strip()
        elif m := next((m for p in _SECTION if (m := p.match(line))), None) or _BARE_SECTION.match(line):
            start = float(m["seconds"]) if "seconds" in m.re.groupindex else seconds(m["start"])
            section = m["text"].strip()
            if m.re is _BARE_SECTION:  # transcripts of podcasts name speakers without marks
                podcast, section_start = True, start
            if sections:
                out.append(Segment("section_header", section, number, start, None, None, section))
        elif m := _STAMP.match(line):
            if last and last.end is None:
                last.end = seconds(m["end"])
            elif last and last.start is None:
                last.start = seconds(m["end"])
        elif m := _EVENTS.match(line):
            out += [Segment("event", e, number, seconds(m["start"]), None, None, section) for e in re.findall(r"\[[^\]]+\]", m["events"])]
        elif m := _EVENT.match(line):
            out.append(Segment("event", f"[{m['event'].strip()}]", number, seconds(m["start"]), None, None, section))
        elif m := _BOLD.match(line):
            dialogue(m["text"], number, m["speaker"].strip())
        elif podcast and (m := _PLAIN.match(line)):
            dialogue(m["text"], number, m["speaker"].strip(), section_start)
        elif inline_stamps(line)[1:] != (None, None):
            dialogue(line, number)
        elif last and last.end is None:
            last.text += f" {line}"
        elif not line.startswith(("#", "- ")):
            dialogue(line, number)
    return out


def estimate(text: str) -> float:
    """Seconds a text takes to say."""
    letters = text.replace(" ", "")
    wide = len(_WIDE.findall(text)) > WIDE_SHARE * len(letters)
    return max(len(letters) / CHARACTERS_PER_SECOND if wide else len(text.split()) / WORDS_PER_SECOND, LEAST_ESTIMATE)


def timed(found: list[Segment], least: float = LEAST_DURATION) -> list[tuple[float, float, Segment]]:
    """(start, duration, segment) of events and of dialogue with a speaker or a stamp."""
    usable = [s for s in found if s.kind == "event" or s.kind == "dialogue" and (s.speaker or s.start is not None or s.end is not None)]
    out, reached = [], 0.0
    for k, s in enumerate(usable):
        ahead = usable[k + 1] if k + 1 < len(usable) else None
        start = reached if s.start is None else s.start
        if s.end is not None:
            end = s.end
        elif s.start is not None and ahead and ahead.start is not None:
            end = ahead.start
        elif s.start is not None and ahead and ahead.end is not None:
            end = ahead.end - estimate(ahead.text)
        else:
            end = start + estimate(s.text)
        length = max(end - start, least)
        out.append((start, length, s))
        reached = start + length
    return out


def cues(content: str) -> list[tuple[float, float, str | None, str]]:
    return [(start, length, s.speaker, s.text.strip()) for start, length, s in timed(segments(content, sections=False))]


SEGMENT_SCHEMA = "doc_id long, segment_idx int, segment_type string, line_number int, section string, speaker string, text string, timestamp double, end_timestamp double, translation string"
CUE_SCHEMA = "doc_id long, cue_idx int, id string, start double, duration double, speaker string, text string, translation string, target_lang string"


def _rows(docs: DataFrame, schema: str, read) -> DataFrame:
    arrow = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[f.split()[1]]) for f in schema.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, k, *r) for doc, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, r in enumerate(read(content))]
            cols = list(zip(*rows, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return docs.where("content is not null").select("doc_id", "content").mapInArrow(work, schema)


def read_segments(docs: DataFrame, target_lang: str | None = None) -> DataFrame:
    """Segments of documents (``doc_id``, ``content``)."""
    return _rows(docs, SEGMENT_SCHEMA, lambda c: [(s.kind, s.line, s.section, s.speaker, s.text, s.start, s.end, s.translation) for s in segments(c, target_lang)])


def read_cues(docs: DataFrame, merge: bool = False, max_gap: float = MERGE_GAP) -> DataFrame:
    """Cues with ids, translations and times; with ``merge`` neighbours of one speaker and gaps up to ``max_gap`` become one."""

    def read(content: str) -> list[tuple]:
        target = front_matter(content).get("target_lang")
        rows = [[f"segment_{k:05d}", start, length, s.speaker, s.text.strip(), s.translation, target if s.translation else None] for k, (start, length, s) in enumerate(timed(segments(content, sections=False)))]
        if not merge:
            return list(map(tuple, rows))
        joined: list[list] = []
        for r in rows:
            if joined and joined[-1][3] == r[3] and r[1] - (joined[-1][1] + joined[-1][2]) <= max_gap:
                joined[-1][4] += f" {r[4]}"
                joined[-1][2] = r[1] + r[2] - joined[-1][1]
            else:
                joined.append([f"merged_{len(joined):05d}", *r[1:]])
        return list(map(tuple, joined))

    return _rows(docs, CUE_SCHEMA, read)


def read_front_matter(docs: DataFrame) -> DataFrame:
    """One row per field: ``doc_id, nr, field, value``."""
    return _rows(docs, "doc_id long, nr int, field string, value string", lambda c: [(k, f"{v:g}" if isinstance(v, float) else v) for k, v in front_matter(c).items()])


def write_front_matter(facts: Column) -> Column:
    """Front matter out of a map: known fields in their order, values with colons or hashes quoted; empty for an empty map."""
    safe = lambda v: F.when(v.rlike("[:#\"']|^\\s|\\s$"), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(v)
    lines = [F.when(F.coalesce(F.try_element_at(facts, F.lit(k)), F.lit("")) != "", F.concat(F.lit(f"{k}: "), safe(F.try_element_at(facts, F.lit(k))))) for k in FRONT_FIELDS]
    body = F.array_compact(F.array(*lines))
    return F.when(F.size(body) > 0, F.concat(F.lit("---\n"), F.array_join(body, "\n"), F.lit("\n---\n\n"))).otherwise("")


def write_transcript(cues: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Transcripts (``doc_id, content``): the speaker where it changes, an end stamp where a translation follows, front matter from ``facts`` (``doc_id``, ``facts``)."""
    order = Window.partitionBy("doc_id").orderBy("cue_idx")
    changed = F.coalesce((F.col("speaker") != "") & ~F.col("speaker").eqNullSafe(F.lag("speaker").over(order)), F.lit(False))
    other = F.col("translation") if "translation" in cues.columns else F.lit(None).cast("string")
    lang = F.coalesce(F.col("target_lang") if "target_lang" in cues.columns else F.lit(None).cast("string"), F.lit("und"))
    said = squash(F.col("text"))
    label = F.when(changed, F.concat(F.lit("**"), F.regexp_replace("speaker", "[:：]$", ""), F.lit(":** "))).otherwise("")
    stamp = F.concat(K.markdown_stamp(F.col("start")), F.lit(" "))
    end = F.when(F.coalesce(other, F.lit("")) != "", F.concat(F.lit(" "), K.markdown_stamp(F.col("start") + F.col("duration")))).otherwise("")
    line = F.concat(label, stamp, said, end, F.when(F.coalesce(other, F.lit("")) != "", F.concat(F.lit("\n> ["), lang, F.lit("] "), squash(other))).otherwise(""))
    numbered = cues.where("start >= 0 and duration > 0 and text is not null").withColumn("__line", line)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_idx", "__line"))), lambda x: x["__line"]), "\n\n")
    bodies = numbered.groupBy("doc_id").agg(F.concat(joined, F.lit("\n")).alias("content"))
    if facts is None:
        return bodies
    return bodies.join(facts, "doc_id", "left").select("doc_id", F.concat(write_front_matter(F.coalesce("facts", F.create_map().cast("map<string,string>"))), F.col("content")).alias("content"))
