"""Sentences over cue borders: events apart, speakers carried, open ends joined to what follows.

A track's cues become segments (speech of one speaker, or one event), a splitter cuts the
segments, open ends and colons are carried on, and every sentence gets the times, words
and custom fields of the cues its characters lie in.  The splitter may be any function
from texts to lists of sentences (a model, made once per worker); the default goes by marks.

A track is read as a stream in order of position and given out at every event, so a task
holds what lies between two events, not a track.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks that close a sentence.
END_MARKS = ".!?\"']）。！？”】」』〗〙〛｡؟…"
# Custom fields that hold a whole raw line, and the one of which the leading tags survive a split.
WHOLE_LINE_FIELDS = ("ass_raw_event_body", "ass_raw_event_type")
RAW_FIELD = "ass_raw_text"
SPEAKER_CHANGE = "vtt_speaker_change"
SEGMENT_CHARS = 2000

_EVENT = re.compile(r"\[[^\]]+\]")
_EVENTS = r"\[[^\]]+\](?:\s+\[[^\]]+\])*"
_TRAILING = re.compile(rf"(.+?)\s+({_EVENTS})$")
_LEADING = re.compile(rf"({_EVENTS})\s+(.+)$")
_EVENT_THEN_CHANGE = re.compile(r"(\[[^\]]+\])\s+((?:&gt;&gt;|>>)\s+)(.+)$")
_EVENT_THEN_LABEL = re.compile(r"(\[[^\]]+\])\s+([^:]+:)(.*)$")
_SENTENCE_END = re.compile(r"(?<=[.!?。！？…])[\"'”’»」』)]*(?:\s+|(?<=[。！？])(?=\S))")
_PREFIX = re.compile(r"(?:\{[^}]*\})+")
_WIDE = re.compile("[一-鿿぀-ヿ가-힯㐀-䶿]")

Splitter = Callable[[list[str]], list[list[str]]]


@dataclass
class Cue:
    position: int
    start: float
    duration: float
    text: str
    speaker: str | None = None
    custom: dict | None = None
    words: list | None = None

    @property
    def end(self) -> float:
        return self.start + self.duration


@dataclass
class Segment:
    """Speech up to the next speaker or event, or one event."""

    event: bool
    speaker: str | None
    texts: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return " ".join(self.texts)


def split_by_marks(texts: list[str]) -> list[list[str]]:
    out = []
    for text in texts:
        ends = [m.end() for m in _SENTENCE_END.finditer(text)]
        parts = [text[a:b].strip() for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]
        out.append([p for p in parts if p])
    return out


def is_event(text: str) -> bool:
    text = text.strip()
    return text.startswith("[") and text.endswith("]")


def split_events(text: str) -> list[str]:
    """``[A] [B]`` in two; anything between the brackets keeps the text whole."""
    found = _EVENT.findall(text)
    return found if len(found) > 1 and " ".join(found) == text.strip() else [text]


def split_inline_events(text: str) -> list[str]:
    """Events at the end, else at the beginning, taken off the speech; those inside stay."""
    text = text.strip()
    if m := _TRAILING.match(text):
        return [m[1].strip(), *_EVENT.findall(m[2])]
    if m := _LEADING.match(text):
        return [*_EVENT.findall(m[1]), m[2].strip()]
    return [text]


def split_event_and_speaker(text: str) -> list[str]:
    """An event before ``>>`` or before a label stands alone."""
    text = text.strip()
    if m := _EVENT_THEN_CHANGE.match(text):
        return [m[1], f"{m[2].strip()} {m[3]}"]
    if m := _EVENT_THEN_LABEL.match(text):
        return [m[1], f"{m[2]} {m[3].strip()}".strip()]
    return [text]


def head_change(cue: Cue) -> Cue:
    """A leading dash marks another speaker: it is taken off the text and noted."""
    if not cue.text.startswith("- "):
        return cue
    return Cue(cue.position, cue.start, cue.duration, cue.text[2:], cue.speaker, {**(cue.custom or {}), SPEAKER_CHANGE: "true"}, cue.words)


def segmented(cues: list[Cue]) -> list[Segment]:
    """A labelled cue opens a segment, an event is one, and unlabelled speech ends at ``SEGMENT_CHARS``."""
    out: list[Segment] = []
    current = None
    for cue in cues:
        if is_event(cue.text):
            out += [Segment(True, cue.speaker, [e]) for e in split_events(cue.text)]
            current = None
            continue
        if cue.speaker or current is None:
            current = Segment(False, cue.speaker or None)
            out.append(current)
        current.texts.append(cue.text)
        if not cue.speaker and sum(map(len, current.texts)) >= SEGMENT_CHARS:
            current = None
    return out


def join_colons(sentences: list[str], text: str) -> tuple[list[str], str]:
    """Sentences with colon ends joined to the next one; what a last colon leaves open comes second."""
    done: list[str] = []
    open_ = ""
    for sentence in sentences:
        *before, last = split_event_and_speaker(open_ + sentence)
        done += before
        if not last.endswith((":", "：")):
            done.append(last)
            open_ = ""
            continue
        at = text.find(last)
        if at >= 0:
            blank = text[at + len(last) : at + len(last) + 1] == " "
        else:
            blank = not _WIDE.search(last.rstrip(":：")[-1:])
        open_ = last + (" " if blank else "")
    return done, open_


def carried(segments: list[Segment], sentences: list[list[str]]) -> list[tuple[str, str | None]]:
    """(sentence, speaker): open ends flow into the next segment unless an event or another speaker stops them."""
    out: list[tuple[str, str | None]] = []
    speakers = [s.speaker for s in segments]
    rest, owner = "", None
    for k, (segment, own) in enumerate(zip(segments, sentences, strict=True)):
        if segment.event:
            if rest:
                out.append((rest.strip(), owner))
            rest, owner = "", None
            out.append((segment.text, speakers[k]))
            continue
        if not own:
            continue
        speaker = (owner or speakers[k]) if rest else speakers[k]
        done, open_ = join_colons([rest + own[0], *own[1:]], segment.text)
        rest, owner = open_, None
        if not done:
            done, rest = [rest.strip()], ""
        if done[-1].endswith(tuple(END_MARKS)):
            out += [(t, None if n else speaker) for n, t in enumerate(done)]
            continue
        *closed, last = done
        out += [(t, None if n else speaker) for n, t in enumerate(closed)]
        rest = f"{last} {rest}"
        following = k + 1 < len(segments)
        if following and speakers[k + 1] is not None:
            out.append((rest.strip(), None if closed else speaker))
            rest = ""
        elif not closed:
            owner = speaker
            if following:
                speakers[k + 1] = speaker
    return [*out, (rest.strip(), owner)] if rest.strip() else out


def merge_customs(customs: list[dict | None]) -> dict | None:
    """All fields, the first source first; where sources disagree, a mark and their number are added."""
    given = [c for c in customs if c]
    if not given:
        return None
    merged: dict = {}
    for c in reversed(given):
        merged |= c
    if any(merged[k] != v for c in given for k, v in c.items()):
        merged |= {"_split_from_multiple": "true", "_source_count": str(len(given))}
    return merged


def clean_custom(custom: dict | None) -> dict | None:
    """Fields that describe an unsplit line go; of a raw text only the leading tags stay."""
    if not custom:
        return custom
    kept = {k: v for k, v in custom.items() if k not in WHOLE_LINE_FIELDS and k != RAW_FIELD}
    tags = _PREFIX.match(custom.get(RAW_FIELD) or "")
    return kept | ({RAW_FIELD: tags[0]} if tags else {})


def timed(cues: list[Cue], sentences: list[tuple[str, str | None]]) -> list[dict]:
    """Each sentence with the cues its characters lie in: times by share of characters, their words, their custom fields."""
    whole = " ".join(c.text for c in cues)
    starts, at = [], 0
    for c in cues:
        starts.append(at)
        at += len(c.text) + 1
    out, cursor = [], 0
    for text, speaker in sentences:
        low = whole.find(text, cursor)
        if low < 0:
            raise ValueError(f"sentence not in its cues: {text!r}")
        cursor = high = low + len(text)
        held = [k for k in range(max(0, bisect_right(starts, low) - 1), len(cues)) if starts[k] < high and starts[k] + len(cues[k].text) > low] or [max(0, bisect_right(starts, low) - 1)]
        first, last = cues[held[0]], cues[held[-1]]
        part = lambda c, k, x: min(max(x - starts[k], 0), len(c.text)) / len(c.text) if c.text else None
        begin, stop = part(first, held[0], low), part(last, held[-1], high)
        start = first.start + (begin or 0.0) * first.duration
        end = last.start + (1.0 if stop is None else stop) * last.duration
        if end < start:  # cues that overlap in time
            end = max(last.end, start + 0.1)
        words = [w for k in held for w in words_within(cues[k], low - starts[k], high - starts[k])]
        custom = clean_custom(merge_customs([cues[k].custom for k in held]))
        out.append({"text": text, "speaker": speaker, "start": start, "duration": end - start, "first": first.position, "last": last.position, "custom": custom, "words": words or None})
    return out


def words_within(cue: Cue, low: int, high: int) -> list:
    """Words of a cue whose place in its text lies within a range, each searched behind the one before."""
    found, at = [], 0
    for w in cue.words or ():
        place = cue.text.find(w["symbol"], at) if w["symbol"] else -1
        if place >= 0:
            at = place + len(w["symbol"])
            if at > low and place < high:
                found.append(w)
    return found


def split_cues(cues: list[Cue], splitter: Splitter = split_by_marks) -> list[dict]:
    cues = [head_change(c) for c in cues]
    segments = segmented(cues)
    speech = [s.text for s in segments if not s.event]
    cut = iter(splitter(speech) if speech else [])
    sentences = [[s.text] if s.event else [p for x in next(cut) for p in split_inline_events(x)] for s in segments]
    return timed(cues, carried(segments, sentences))


WORD = "struct<symbol:string,start:double,duration:double>"
SCHEMA = f"track long, sentence long, text string, speaker string, start double, duration double, first_position long, last_position long, custom map<string,string>, words array<{WORD}>"


def split_sentences(cues: DataFrame, splitter: Callable[[], Splitter] | None = None, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """Sentences of every track.

    ``cues``: track, position, ``start``, ``duration``, ``text``, and where there are any
    ``speaker``, ``custom`` (map of strings) and ``words``.  ``splitter`` makes the function that
    splits, once per task.  Rows without track, position or times are left out, null texts
    count as empty.  Result: track, ``sentence`` (from 0 within a stretch between events, with
    the first position it is unique), ``text``, ``speaker`` (on the first sentence of a turn),
    ``start``, ``duration``, ``first_position``, ``last_position``, ``custom``, ``words``.
    """
    schema = pa.schema([("track", pa.int64()), ("sentence", pa.int64()), ("text", pa.string()), ("speaker", pa.string()), ("start", pa.float64()), ("duration", pa.float64()),
        ("first_position", pa.int64()), ("last_position", pa.int64()), ("custom", pa.map_(pa.string(), pa.string())),
        ("words", pa.list_(pa.struct([("symbol", pa.string()), ("start", pa.float64()), ("duration", pa.float64())])))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter() if splitter else split_by_marks
        track_, held = None, []

        def give() -> pa.RecordBatch:
            rows = [{"track": track_, "sentence": n, "first_position": r.pop("first"), "last_position": r.pop("last"), **r, "custom": list(r["custom"].items()) if r["custom"] else None} for n, r in enumerate(split_cues(held, split))]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for t, p, start, duration, text, speaker, custom, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cue = Cue(p, start, duration, text or "", speaker, dict(custom) if custom else None, words)
                # nothing flows over an event, so what ends in one is done
                if held and (t != track_ or is_event(held[-1].text) and not is_event(cue.text)):
                    yield give()
                track_ = t
                held.append(cue)
        if held:
            yield give()

    have = lambda name, kind: F.col(name).cast(kind) if name in cues.columns else F.lit(None).cast(kind)
    columns = cues.select(
        F.col(track).cast("long").alias("track"), F.col(position).cast("long").alias("position"), F.col("start").cast("double").alias("start"), F.col("duration").cast("double").alias("duration"),
        F.col("text").alias("text"), have("speaker", "string").alias("speaker"), have("custom", "map<string,string>").alias("custom"), have("words", f"array<{WORD}>").alias("words"),
    ).where("track is not null and position is not null and start is not null and duration is not null")
    ordered = columns.repartition("track").sortWithinPartitions("track", "position")
    return ordered.mapInArrow(work, SCHEMA).withColumnRenamed("track", track)
