"""Sentence ends in cues of many languages and scripts.

A track is one document, whose sentences run over cue borders.  Whether a period ends a
sentence is decided document-centred: a token with a period before a small letter or a
digit elsewhere in the document is an abbreviation there, a token seen without a period
is a word, and a capitalised follower seen in small letters is no name.  Where the
document is silent, counts over all documents decide: what is an abbreviation, whether
it also stands at sentence ends (as in "etc."), which words are ordinary ones.  Scripts
bring terminators of their own; documents without any end mark are split at their blanks.

Documents longer than ``BLOCK`` cues are read in blocks of that many cues with
``CONTEXT`` cues of context on both sides, so no document is ever one unbounded task;
what the whole document shows of a word is joined to each of its blocks.  Neither these
facts nor the corpus's ever pass through the driver: each block gets the words it asks
for by a join.  All verdicts on the corpus are ratios of counts.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048
CONTEXT = 64
SMALL_SHARE = 0.02  # of a word's occurrences: followed by a small letter in spite of a period
START_SHARE = 0.1  # of a word's periods: followed by an ordinary word in capitals
LOWER_SHARE = 0.05  # of a word's occurrences: in small letters

# End marks by script, closing and opening marks.
FULL_STOPS = "。！？｡।॥؟۔።"
CLOSERS = "”\"»“’)]）】』」›'"
OPENERS = "“«„‹「『‚\"¿¡(（[【"
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›"}

_TOKEN = re.compile(r"[^\W_]+(?:[ऀ-ःऺ-ॏ̀-ͯ][^\W_]*)*(?:[.’'-][^\W_]+[ऀ-ःऺ-ॏ]*)*(\.?)")
_END = re.compile(r"(?:\.{2,}|…+|[.!?。！？｡।॥؟۔።]|(?<=\s)\|(?=\s|$))[!?！？]*")
_NO_WORD = frozenset("“”„«»\"(（「『¿¡—")
_SKIPPED = re.compile(r"[\s\-–♪>]*")
_BLANKS = re.compile(r"\s*")
_FOLLOWER = re.compile(r"[^\W_]*\.?")
_ASKED = re.compile(r"([^\s“”„«»\"(（「『¿¡—.-]+)\.|\.\W*(?=([^\W_]+))")
_FIRST = re.compile(r"[^\W_]+")


@dataclass
class Corpus:
    """What corpus and whole document show of the words one block asks for."""

    abbreviations: set[str] = field(default_factory=set)
    enders: set[str] = field(default_factory=set)
    ordinary: set[str] = field(default_factory=set)
    abbreviated: set[str] = field(default_factory=set)
    plain: set[str] = field(default_factory=set)
    lower: set[str] = field(default_factory=set)
    marked: bool = False


# Bits of the facts joined to a block, in the order of Corpus.
_ABBREVIATION, _ENDER, _ORDINARY, _SMALL, _PLAIN, _LOWER, _MARKED = (1 << k for k in range(7))


def _cased(ch: str) -> bool:
    return ch.lower() != ch.upper()


def _kind(text: str, i: int) -> tuple[str, str]:
    """Kind of what follows position ``i``: e(nd) l(ower) u(pper) d(igit) o(pening) c(aseless) p(unctuation), and the word."""
    quoted = False
    i = _SKIPPED.match(text, i).end()
    while i < len(text) and text[i] in OPENERS:
        i, quoted = _BLANKS.match(text, i + 1).end(), True
    if i >= len(text):
        return "e", ""
    ch = text[i]
    word = _FOLLOWER.match(text, i).group()
    if ch.isdigit():
        return ("o" if quoted else "d"), word
    if not ch.isalpha():
        return "p", ""
    if not _cased(ch):
        return ("o" if quoted else "c"), word
    return ("o" if quoted and ch.isupper() else "u" if ch.isupper() else "l"), word


def evidence(text: str) -> Iterator[tuple[str, str, str]]:
    """(what, word, follower) facts of one text: plain, lower, small, number, big."""
    found = list(_TOKEN.finditer(text))
    for m, nxt in zip(found, [*found[1:], None], strict=False):
        token = m.group()
        dotted = token.endswith(".")
        word = token.rstrip(".")
        if not dotted:
            yield "plain", word.lower(), ""
            if word[0].islower():
                yield "lower", word.lower(), ""
            continue
        if nxt is None or nxt.start() - m.end() > 2 or not text[m.end() : nxt.start()].isspace():
            continue
        first = nxt.group()[0]
        if first.islower() or first.isalpha() and not _cased(first):
            yield "small", word.lower(), ""
        elif first.isdigit():
            yield "number", word.lower(), ""
        elif first.isupper():
            yield "big", word.lower(), "" if nxt.group().endswith(".") else re.match(r"[^\W_]*", nxt.group()).group().lower()


def corpus_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Facts of all texts with their counts, added up in the tasks before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            what, word, follower = zip(*counts, strict=True) if counts else ((), (), ())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(what, pa.string()), pa.array(word, pa.string()), pa.array(follower, pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["what", "word", "follower", "n"],
            )
            counts.clear()
            return batch

        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(evidence((t or "").replace("\n", " ")))
            if len(counts) > 200_000:
                yield flush()
        yield flush()

    facts = texts.select(text).mapInArrow(work, "what string, word string, follower string, n long")
    return facts.groupBy("what", "word", "follower").agg(F.sum("n").alias("n"))


def corpus(texts: DataFrame, text: str = "text") -> DataFrame:
    """``word, flags`` of abbreviations, those that end sentences too, and ordinary words.

    A word is ordinary if a stated share of it is in small letters; an abbreviation if its
    period stands before small letters, or before numbers or capitalised words that almost
    never begin sentences, unless it mostly stands without period and before no numbers.
    """
    counts = corpus_counts(texts, text)
    by_word = counts.groupBy("word").agg(
        *(F.sum(F.when(F.col("what") == w, F.col("n")).otherwise(0)).alias(w) for w in ("plain", "lower", "small", "number", "big"))
    )
    usual = by_word.where(F.col("lower") > LOWER_SHARE * F.col("plain")).select(F.col("word").alias("follower"))
    starts = counts.where("what = 'big' and follower <> ''").join(usual, "follower").groupBy("word").agg(F.sum("n").alias("starts"))
    judged = by_word.join(starts, "word", "left").withColumn("starts", F.coalesce("starts", F.lit(0))).withColumn("after", F.col("number") + F.col("big"))
    silent = (F.col("after") >= 1) & (F.col("starts") <= START_SHARE * F.col("after")) & ((F.col("plain") <= F.col("after")) | (2 * F.col("number") >= F.col("after")))
    short = ~F.col("word").rlike("^[0-9]+$") & ((F.col("small") > SMALL_SHARE * (F.col("after") + F.col("plain"))) | silent)
    flags = (
        F.when(short, F.lit(_ABBREVIATION)).otherwise(0)
        + F.when(short & (F.col("starts") >= 2), F.lit(_ENDER)).otherwise(0)
        + F.when(F.col("lower") > LOWER_SHARE * F.col("plain"), F.lit(_ORDINARY)).otherwise(0)
    )
    return judged.select("word", flags.alias("flags")).where("flags > 0")


class Document:
    """Ends of sentences in one block of cues."""

    def __init__(self, cues: list[str], stats: Corpus):
        self.stats = stats
        self.text = "\n".join(cues)
        self.offsets = []
        at = 0
        for c in cues:
            self.offsets.append(at)
            at += len(c) + 1
        facts = Counter(evidence(self.text.replace("\n", " ")))
        self.abbreviated = {w for what, w, _ in facts if what == "small"} | stats.abbreviated
        self.plain = {w for what, w, _ in facts if what == "plain"} | stats.plain
        self.lower = {w for what, w, _ in facts if what == "lower"} | stats.lower

    def abbreviation(self, word: str) -> bool:
        word = re.split(r"[.-]", word)[-1] or word
        if word in self.abbreviated:
            return True
        if word in self.plain:
            return word in self.stats.abbreviations and len(word) == 1
        return word in self.stats.abbreviations or len(word) == 1 and word.isalpha() and _cased(word)

    def ordinary(self, word: str) -> bool:
        if word.endswith(".") and self.abbreviation(word[:-1].lower()):
            return False
        word = word.rstrip(".")
        return word.lower() in self.lower or word.lower() in self.stats.ordinary

    def quotes(self) -> list[tuple[int, int, bool]]:
        """(open, close, introduced by a colon) of quotations that close before the next one opens and within ``CONTEXT`` cues."""
        found, text = [], self.text
        places = {c: [m.start() for m in re.finditer(re.escape(c), text)] for c in {*PAIRS, *"".join(PAIRS.values())}}

        def after(char: str, i: int) -> int:
            at = bisect_right(places[char], i)
            return places[char][at] if at < len(places[char]) else len(text)

        i = -1
        while (i := min(after(c, i) for c in PAIRS)) < len(text):
            if text[i] == "“" and i and not text[i - 1].isspace() and text[i - 1] in ".!?…%)":
                continue
            close = min(after(c, i) for c in PAIRS[text[i]])
            if close < after(text[i], i) and text.count("\n", i, close) <= CONTEXT:
                found.append((i, close, text[:i].rstrip().endswith((":", "："))))
                i = close
        return found

    def ends(self) -> list[int]:
        """Positions in the text behind each sentence."""
        text = self.text
        if not self.stats.marked and not self.marked():
            return self.unmarked()
        quotes = self.quotes()
        low = {close for _, close, _ in quotes}
        out, last, q = [], 0, 0
        for m in _END.finditer(text):
            if m.start() < last or not self.terminal(m):
                continue
            end = m.end()
            closed = False
            while end < len(text):
                if text[end] in CLOSERS and not (text[end] == "“" and end not in low):
                    closed |= text[end] in "”»“」』›\""
                    end += 1
                elif text[end] in "  " and end + 1 < len(text) and text[end + 1] in "»›":
                    end += 1
                else:
                    break
            while q < len(quotes) and quotes[q][1] < m.start():
                q += 1
            inside = quotes[q] if q < len(quotes) and quotes[q][0] < m.start() < quotes[q][1] else None
            if inside and end <= inside[1]:
                continue  # the quotation goes on
            if self.boundary(m, end, closed, inside, last):
                out.append(end)
                last = end
        tail = len(text.rstrip())
        if tail > (out[-1] if out else 0):
            out.append(tail)
        return out

    def marked(self) -> bool:
        return any(self.terminal(m) for m in _END.finditer(self.text))

    def terminal(self, m: re.Match) -> bool:
        text, mark = self.text, m.group()
        if mark[0] == ".":
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if len(mark) == 1 and after and not after.isspace() and after not in CLOSERS + OPENERS and not (
                after.isupper() and before.islower() and text[max(0, m.start() - 2) : m.start()].isalpha()
            ):
                return False
        return True

    def boundary(self, m: re.Match, end: int, closed: bool, inside: tuple[int, int, bool] | None, last: int) -> bool:
        text, mark = self.text, m.group()
        kind, follower = _kind(text, end)
        if kind == "e":
            return True
        at = _BLANKS.match(text, end).end()
        nxt = text[at : at + 3]
        if nxt[:1] in ",;:，、":
            return False
        if closed and nxt[:1] in "—–":
            return False
        if mark.startswith(("..", "…")):
            return kind in "uo" and _cased(follower[:1] or "x")
        if mark[0] in FULL_STOPS or mark[0] in "!?" or mark[0] == "|":
            if closed and inside and not inside[2]:
                opens = not text[last : inside[0]].strip()
                if text[end : end + 1] == "と" or opens and mark[0] in "!?！？" and kind == "c":
                    return False
            return kind != "l"
        # a period
        word = self.word_before(m.start())
        lowered = word.lower()
        if kind == "l":
            return False
        if kind == "c":
            return not self.abbreviation(lowered) and not re.search("[ऀ-ॿ]$", word)
        if closed or not word or not (word[-1].isalnum() or unicodedata.category(word[-1])[0] == "M"):
            return True
        if len(word) == 1 and word.isupper():
            return kind == "u" and self.ordinary(follower)
        if word.isdigit():
            return kind in "od" or self.ordinary(follower) or not self.known_name(follower.rstrip("."))
        if not self.abbreviation(lowered):
            return True
        if kind in "do":
            return lowered in self.stats.enders
        return self.ordinary(follower) or lowered in self.stats.enders

    def word_before(self, end: int) -> str:
        start = end
        while start and not self.text[start - 1].isspace() and self.text[start - 1] not in _NO_WORD:
            start -= 1
        return self.text[start:end]

    def known_name(self, word: str) -> bool:
        """A word only seen in capitals, within sentences too."""
        return bool(word) and not self.ordinary(word) and word.lower() not in self.stats.abbreviations

    def unmarked(self) -> list[int]:
        """Without any end mark each stretch between blanks of a script without spaces, else each line, is a statement."""
        text = self.text
        spaced = bool(re.search("[A-Za-zÀ-ɏЀ-ԯऀ-ॿ]", text)) and not re.search("[぀-ヿ一-鿿]", text)
        parts = re.finditer(r"[^\n]+" if spaced else r"[^\s]+", text)
        return [m.start() + len(m.group().rstrip()) for m in parts if m.group().strip()]

    def by_cue(self) -> list[tuple[int, int]]:
        """(index of cue, characters of its text up to the end)."""
        out, i = [], 0
        for end in self.ends():
            while i + 1 < len(self.offsets) and self.offsets[i + 1] < end:
                i += 1
            out.append((i, end - self.offsets[i]))
        return out


def _asked(spread: DataFrame) -> DataFrame:
    """``track, block, word``: words beside periods or at the beginning of a cue, once a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*seen, strict=True)) or [()] * 3
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["track", "block", "word"])

        for batch in batches:
            for track, block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text:
                    words = {w for pair in _ASKED.findall(text) for w in pair if w}
                    if first := _FIRST.search(text):
                        words.add(first.group())
                    seen.update((track, block, w.lower()) for w in words)
            if len(seen) > 200_000:
                yield flush()
        yield flush()

    return spread.select("track", "block", "text").mapInArrow(work, "track long, block long, word string").distinct()


def _document_facts(lines: DataFrame) -> DataFrame:
    """``track, word, flags`` of documents longer than a block; the word of ``_MARKED`` is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = {"small": _SMALL, "plain": _PLAIN, "lower": _LOWER}
        for batch in batches:
            seen: dict[tuple, int] = {}
            for track, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = (text or "").replace("\n", " ")
                for what, word, _ in evidence(text):
                    if what in bit:
                        seen[track, word] = seen.get((track, word), 0) | bit[what]
                if Document([text], Corpus()).marked():
                    seen[track, ""] = _MARKED
            tracks, words = zip(*seen, strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(tracks, pa.int64()), pa.array(words, pa.string()), pa.array(list(seen.values()), pa.int32())], ["track", "word", "flags"])

    long = lines.groupBy("track").agg(F.max("cue").alias("last")).where(F.col("last") >= BLOCK).select("track")
    facts = lines.join(long, "track", "left_semi").select("track", "text").mapInArrow(work, "track long, word string, flags int")
    return facts.groupBy("track", "word").agg(F.bit_or("flags").alias("flags"))


def sentence_ends(cues: DataFrame, stats: DataFrame, track: str = "track_id", position: str = "cue_idx", row: str = "row_id", text: str = "text") -> DataFrame:
    """Every sentence end with the row it lies in.

    ``cues`` has a track, a position, a unique long row id and a text; ``stats`` is the
    result of ``corpus``.  Rows that agree in track and position are one delivery
    repeated: the text counts once, the ends come out for each of them.  Null and empty
    texts hold no end; rows without track or position are ignored; further columns are
    ignored.  Result: row, ``end_pos`` (code points of the text up to the end).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(rows: list[tuple]) -> pa.RecordBatch:
            block = rows[0][1]
            places: dict[int, tuple[str, list[int]]] = {}
            known = Corpus()
            sets = list(zip((_ABBREVIATION, _ENDER, _ORDINARY, _SMALL, _PLAIN, _LOWER), (known.abbreviations, known.enders, known.ordinary, known.abbreviated, known.plain, known.lower), strict=True))
            for _, _, cue, flags, row_id, t in rows:
                if flags:
                    known.marked |= bool(flags & _MARKED)
                    for bit, words in sets:
                        if flags & bit:
                            words.add(t)
                else:
                    places.setdefault(cue, (t or "", []))[1].append(row_id)
            order = sorted(places)
            document = Document([places[c][0] for c in order], known)
            ids, ends = [], []
            for i, end in document.by_cue():
                if order[i] // BLOCK == block:
                    for row_id in places[order[i]][1]:
                        ids.append(row_id)
                        ends.append(end)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends, pa.int32())], ["row", "end_pos"])

        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][:2] != r[:2]:
                    yield finish(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield finish(rows)

    at = F.col("cue") % BLOCK
    home = F.floor(F.col("cue") / BLOCK)
    blocks = F.array_compact(
        F.array(home, F.when((at < CONTEXT) & (home > 0), home - 1), F.when(at >= BLOCK - CONTEXT, home + 1))
    )
    lines = cues.select(F.col(track).cast("long").alias("track"), F.col(position).cast("long").alias("cue"), F.col(row).cast("long").alias("row"), F.col(text).alias("text")).where(
        "track is not null and cue is not null"
    )
    spread = lines.select("track", F.explode(blocks).alias("block"), "cue", "row", "text")
    asked = _asked(spread)
    whole = _document_facts(lines)
    homes = lines.select("track", home.alias("block")).distinct().join(whole.where("word = ''"), "track").select("track", "block", F.lit("").alias("word"), "flags")
    told = (
        asked.join(stats, "word").select("track", "block", "word", "flags")
        .unionAll(asked.join(whole, ["track", "word"]).select("track", "block", "word", "flags"))
        .unionAll(homes)
        .select("track", "block", F.lit(None).cast("long").alias("cue"), "flags", F.lit(None).cast("long").alias("row"), F.col("word").alias("text"))
    )
    rows = spread.select("track", "block", "cue", F.lit(0).alias("flags"), "row", "text").unionAll(told)
    ordered = rows.repartition("track", "block").sortWithinPartitions("track", "block", "cue", "row")
    return ordered.mapInArrow(work, "row long, end_pos int").withColumnRenamed("row", row)
