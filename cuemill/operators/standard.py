"""Long cues cut for reading: at words with their times where there are any, else by shares of characters.

Cuts prefer pauses, keep words of a segmenter whole and leave no orphans; texts are slices
of the cue's own text, translations go along in as many slices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.config import StandardizationConfig
from cuemill.functions import breaks

PAUSE = 0.3
FILLED, ORPHAN, CROWDED = 0.75, 0.25, 1.25
Word = tuple[str, float, float]  # symbol, start, duration
Segmenter = Callable[[str], list[str]]


def _end(word: Word) -> float:
    return word[1] + word[2]


def _chars(words: list[Word]) -> int:
    return sum(len(w[0]) for w in words) + max(0, len(words) - 1)


def pause_split(words: list[Word], most: int) -> int | None:
    """Where three words or more have their longest pause, looked for behind three quarters of the characters; None if it is no pause."""
    filled = [n - 1 for n in accumulate(len(w[0]) + 1 for w in words)]
    first = next((k + 1 for k, n in enumerate(filled) if n >= int(FILLED * most)), len(words))
    if len(words) < 3 or first >= len(words):
        return None
    at = max(range(first, len(words)), key=lambda k: words[k][1] - _end(words[k - 1]))
    return at if words[at][1] - _end(words[at - 1]) > PAUSE else None


def word_groups(words: list[Word], most: int, seconds: float) -> list[list[Word]]:
    """Words in groups within both budgets; a full one ends at its pause."""
    done: list[list[Word]] = []
    now: list[Word] = []
    for w in words:
        long_text = bool(now) and _chars([*now, w]) > most
        if long_text or now and _end(w) - now[0][1] > seconds:
            at = pause_split(now, most) if long_text else None
            done.append(now[:at] if at else now)
            now = now[at:] if at else []
        now.append(w)
    return [*done, now] if now else done


def merge_orphan(groups: list[list[Word]], most: int, seconds: float) -> list[list[Word]]:
    """A last group of less than a quarter of the budget joins the one before, if that stays short enough."""
    if len(groups) > 1 and _chars(groups[-1]) < int(ORPHAN * most) and _end(groups[-1][-1]) - groups[-2][0][1] <= seconds:
        return [*groups[:-2], groups[-2] + groups[-1]]
    return groups


def places(text: str, words: list[Word]) -> list[int]:
    """Offset of each word in a text, searched behind the one before; a missing one stands where the search is."""
    out, at = [], 0
    for symbol, *_ in words:
        found = text.find(symbol, at)
        out.append(found if found >= 0 else at)
        at = found + len(symbol) if found >= 0 else at
    return out


def snap(text: str, groups: list[list[Word]], most: int, segment: Segmenter | None) -> list[list[Word]]:
    """Cuts inside a word of the segmenter move to its beginning, unless that empties a group or crowds the next one."""
    if segment is None or len(groups) < 2:
        return groups
    ends = list(accumulate(map(len, segment(text))))
    groups = [list(g) for g in groups]
    for k in range(len(groups) - 1):
        before = sum(map(len, groups[: k + 1]))
        at = places(text, [w for g in groups for w in g])
        start = max((e for e in ends if e <= at[before]), default=0)
        moved = sum(at[i] >= start for i in range(before - len(groups[k]), before))
        if 0 < moved < len(groups[k]) and start < at[before] and _chars(groups[k][-moved:] + groups[k + 1]) <= CROWDED * most:
            groups[k + 1] = groups[k][-moved:] + groups[k + 1]
            groups[k] = groups[k][:-moved]
    return groups


def text_slices(text: str, groups: list[list[Word]]) -> list[str]:
    """The text cut before each group's first word; joined the slices give it back."""
    at = places(text, [w for g in groups for w in g])
    firsts = [0, *accumulate(map(len, groups))][:-1]
    cuts = [0, *(at[k] for k in firsts[1:]), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def split_at_words(start: float, duration: float, text: str, translation: str | None, words: list[Word], c: StandardizationConfig, segment: Segmenter | None = None) -> list[tuple]:
    """(start, duration, text, translation, words) of a cue's pieces: each from its words with the margins, behind the one before, within the cue."""
    most = c.max_lines * c.max_chars_per_line
    groups = merge_orphan(snap(text, word_groups(words, most, c.max_duration), most, segment), most, c.max_duration)
    texts = text_slices(text, groups)
    others = breaks.translation_slices(text, translation, texts)
    out: list[tuple] = []
    for group, said, other in zip(groups, texts, others, strict=True):
        begin, stop = max(0.0, group[0][1] - (c.start_margin or 0.0)), _end(group[-1]) + (c.end_margin or 0.0)
        if out:
            begin = max(begin, out[-1][0] + out[-1][1] + c.min_gap)
        wanted, room = max(c.min_duration, stop - begin), max(0.0, start + duration - begin)
        out.append((begin, min(wanted, room) if room > 0 else wanted, said, other, group))
    return out


def split_by_shares(start: float, duration: float, text: str, translation: str | None, c: StandardizationConfig) -> list[tuple]:
    """The same without words: as many pieces as either budget needs, times by share of characters less the gaps; the last ends with the cue."""
    text = breaks.squashed(text)
    most = c.max_lines * c.max_chars_per_line
    need = max(1, math.ceil(len(text) / most), math.ceil(duration / c.max_duration))
    pieces = breaks.text_chunks(text, max(1, min(most, math.ceil(len(text) / need)))) if need > 1 else [text]
    if len(pieces) < need <= len(text):
        step = math.ceil(len(text) / need)
        pieces = [text[k : k + step] for k in range(0, len(text), step)]
    total = sum(map(len, pieces))
    if len(pieces) < 2 or not total:
        return [(start, duration, text, translation, None)]
    others = breaks.translation_slices(text, translation, pieces)
    room = max(0.0, duration - c.min_gap * (len(pieces) - 1))
    out, at, end = [], round(start, 4), round(start + duration, 4)
    for k, (piece, other) in enumerate(zip(pieces, others, strict=True)):
        length = round(room * len(piece) / total, 4) if k < len(pieces) - 1 else max(0.0, round(end - at, 4))
        out.append((at, length, piece, other, None))
        at = round(at + length + c.min_gap, 4)
    return out


def split_cue(start: float, duration: float, text: str | None, translation: str | None, words: list[Word] | None, c: StandardizationConfig, segment: Segmenter | None = None) -> list[tuple]:
    """A cue within both budgets stays; others are cut at their words, or by shares where there are fewer than two."""
    text = text or ""
    if len(breaks.squashed(text)) <= c.max_lines * c.max_chars_per_line and duration <= c.max_duration:
        return [(start, duration, text, translation, words)]
    if words and len(words) >= 2:
        return split_at_words(start, duration, text, translation, words, c, segment)
    return split_by_shares(start, duration, text, translation, c)


def split_long(cues: DataFrame, config: StandardizationConfig | None = None, segmenter: Callable[[], Segmenter] | None = None) -> DataFrame:
    """Pieces of every cue: the other columns, ``part``, ``start``, ``duration``, ``text`` (broken into lines), ``translation``, ``words``.

    Needs ``start``, ``duration`` and ``text``; ``translation`` and ``words`` where there are any.
    Rows without times are left out; a null text counts as empty.
    """
    c = config or StandardizationConfig()
    word = "array<struct<symbol:string,start:double,duration:double>>"
    taken = ("start", "duration", "text", "translation", "words", "part")
    rest = [x for x in cues.columns if x not in taken]
    have = lambda name, kind: F.col(name).cast(kind) if name in cues.columns else F.lit(None).cast(kind)
    plain = cues.where("start is not null and duration is not null").select(*rest, F.col("start").cast("double").alias("start"), F.col("duration").cast("double").alias("duration"), "text", have("translation", "string").alias("translation"), have("words", word).alias("words"))
    added = (("part", "int"), ("start", "double"), ("duration", "double"), ("text", "string"), ("translation", "string"), ("words", word))
    schema = plain.select(*rest, *(F.lit(None).cast(kind).alias(name) for name, kind in added)).schema
    item = pa.struct([("symbol", pa.string()), ("start", pa.float64()), ("duration", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = segmenter() if segmenter else None
        for batch in batches:
            n, index, out = len(rest), [], []
            for k, (start, duration, text, translation, words) in enumerate(zip(*(x.to_pylist() for x in batch.columns[n:]), strict=True)):
                own = [(w["symbol"] or "", w["start"], w["duration"]) for w in words] if words else None
                for part, (s, d, said, other, group) in enumerate(split_cue(start, duration, text, translation, own, c, segment)):
                    index.append(k)
                    held = [dict(zip(("symbol", "start", "duration"), w, strict=True)) for w in group] if group else None
                    out.append((part, s, d, breaks.smart_lines(said, c.max_chars_per_line, c.max_lines), other, held))
            kept = pa.RecordBatch.from_arrays(batch.columns[:n], rest).take(pa.array(index, pa.int64())).columns if n else []
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.list_(item))
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], [*rest, "part", "start", "duration", "text", "translation", "words"])

    return plain.mapInArrow(work, schema)
