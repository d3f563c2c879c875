"""Runs of identical or nearly identical consecutive events.

Each text is reduced to its words.  Only boundaries are kept: events whose words differ
from their predecessor's.  A lead over the boundaries' positions gives each run's count
and the end of the event before the next boundary gives its duration.

Work is split by ``(track, position // BLOCK)``: the last event of a block is handed to
the next one too, so a track of any length is never one task, and only the outermost
boundaries of each block are joined along the track.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.session import cut

BLOCK = 4096
SLIP_SHARE = 0.1

# Hesitation sounds by language (en, de, fr, es, pt, ru, zh, ja, hi).
HESITATIONS = frozenset(
    "uh um er erm hmm hm mm mhm ah äh ähm ehm öh euh heu hum eh em ahn hã э эм ээ мм хм 嗯 呃 えーと ええと うーん अं हम्म".split()
)
_TAG = re.compile(r"<[^<>]{1,40}>|\{\\[^{}]*\}")
_LABEL = re.compile(r"^(?:\s|[-–—♪♫*>]|\[?SPEAKER_\d+\]?\s*:)+", re.IGNORECASE)
_RISE = re.compile("([a-zß-öø-ÿ])([À-ÖØ-Þ])")
_GARBLE_SYMBOL = re.compile("[\u0080-\u009f¢¤¥¦©¬®¯±²³´µ¶¸¹º¼½¾ƒˆ˜†‡‰™─-▟�√∞≤≥∑∏∫Ω◊]")
# symbols that no writing of the same words contains stay part of a word, as garbling is another event
_TOKEN = re.compile(r"[^\W_¤]+(?:[̀-ͯऀ-ःऺ-ॏ゙゚¤]+[^\W_]*)*|¤+[^\W_]*(?:¤+[^\W_]*)*")
_STUTTER = re.compile(r"\b(\w+)-\s+(?=\1)", re.IGNORECASE)
_ACCENT = re.compile("[̀-ͯ]")
_ALPHABETIC = re.compile("[a-zа-я]")
_OCR = str.maketrans("01", "ol")


def words_of(text: str | None) -> list[str]:
    """Words without case, accents, punctuation, tags, labels, hesitation and stutter; null gives none."""
    if not text:
        return []
    if _RISE.search(text) and not text.isupper():
        text = _RISE.sub("\\1¤\\2", text)  # a capital inside a word marks garbling
    text = _LABEL.sub("", _TAG.sub(" ", text))
    text = _LABEL.sub("", text).replace("\n", " ")
    marked = _GARBLE_SYMBOL.sub("¤", text) if not text.isascii() else text
    folded = unicodedata.normalize("NFKC", marked).casefold()
    folded = _STUTTER.sub("", folded)
    spoken = []
    for token in _TOKEN.findall(folded):
        if token not in HESITATIONS:
            token = _ACCENT.sub("", unicodedata.normalize("NFKD", token)) if not token.isascii() else token
            if not token.isdigit() and not token.isalpha() and _ALPHABETIC.search(token):
                token = token.translate(_OCR)
        if spoken and spoken[-1] == token and not token.isdigit() and _ALPHABETIC.search(token):
            continue
        spoken.append(token)
    return [t for t in spoken if t not in HESITATIONS] or spoken


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits with neighbouring transpositions, counted up to ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return last[-1]


def slips(a: str, b: str) -> list[tuple[str, str, int]] | None:
    """Differing words with their distance if two slips at most can explain them, else None."""
    x, y = a.split(" "), b.split(" ")
    if len(x) != len(y):
        return None
    found = []
    for p, q in zip(x, y, strict=True):
        if p == q:
            continue
        d = distance(p, q)
        if d == 2 and ("ss" in p or "ss" in q):
            d = min(d, distance(p.replace("ss", "ß"), q.replace("ss", "ß")))  # one letter before folding
        if d > 2 or not p.isalpha() or not q.isalpha() or not (_ALPHABETIC.search(p) and _ALPHABETIC.search(q)) or min(len(p), len(q)) < 3:
            return None
        found.append((p, q, d))
    if not found or sum(d for _, _, d in found) > 2:
        return None
    return found


def thirds(a: str, b: str) -> set[str]:
    """Other words one edit away from both, of the letters of both: what both may be slips of."""
    letters = {*a, *b}
    splits = [(a[:k], a[k:]) for k in range(len(a) + 1)]
    near = {x + y[1:] for x, y in splits if y}
    near |= {x + y[1] + y[0] + y[2:] for x, y in splits if len(y) > 1}
    near |= {x + c + y for x, y in splits for c in letters}
    near |= {x + c + y[1:] for x, y in splits if y for c in letters}
    return {w for w in near - {a, b} if distance(w, b, 1) <= 1}


def _reduced(events: DataFrame, track: str, position: str, text: str) -> DataFrame:
    schema = f"track long, position long, first double, last double, words string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(words_of(t)) for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(words, pa.string())], ["track", "position", "first", "last", "words"])

    return events.select(
        F.col(track).cast("long").alias("track"),
        F.col(position).cast("long").alias("position"),
        F.col("start").cast("double").alias("first"),
        (F.col("start") + F.col("duration")).cast("double").alias("last"),
        F.col(text).alias("text"),
    ).where("track is not null and position is not null").mapInArrow(work, schema)


def _pairs(reduced: DataFrame) -> DataFrame:
    """Each event once beside its predecessor's words; ``near`` where slips may explain the difference."""
    ghost = F.when(F.col("position") % BLOCK == BLOCK - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = reduced.withColumn("ghost", F.explode(ghost)).withColumn("block", F.floor(F.col("position") / BLOCK) + F.col("ghost"))
    order = Window.partitionBy("track", "block").orderBy("position", "ghost")
    beside = spread.select(
        "*", F.lag("position").over(order).alias("at"), F.lag("words").over(order).alias("before"), F.lag("last").over(order).alias("last_before")
    )
    once = beside.where("(at is null or at <> position) and ghost = 0")
    follows = F.col("at") == F.col("position") - 1
    squeezed = F.replace(F.col("words"), F.lit(" "), F.lit("")), F.replace(F.col("before"), F.lit(" "), F.lit(""))
    same = follows & (F.col("words") != "") & (squeezed[0] == squeezed[1])
    near = (
        follows
        & (F.abs(F.length("words") - F.length("before")) <= 2)
        & (F.col("words").rlike("[a-zа-я]"))
        & (F.levenshtein("words", "before", 4) >= 0)
    )
    return once.select(
        "track", "position", "block", "first", "last", "last_before", "words",
        F.coalesce(same, F.lit(False)).alias("same"),
        F.when(~F.coalesce(same, F.lit(False)) & near, F.col("before")).alias("before"),
    )


def _slipped(pairs: DataFrame) -> DataFrame:
    """Events that differ from their predecessor by slips of the typist only.

    A word is a slip of another one edit away if it is at most ``SLIP_SHARE`` times as
    common; two words are slips of a third, one edit away from both, if both are.  Only
    such ratios count, so a corpus of any size judges alike.
    """

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for track, position, before, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(track, position, a, b, d) for a, b, d in slips(before, words) or ()]
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["track", "position", "a", "b", "d"])

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(a, b, w) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in sorted(thirds(a, b))]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["a", "b", "word"])

    found = pairs.where("before is not null").select("track", "position", "before", "words").mapInArrow(apart, "track long, position long, a string, b string, d int")
    counts = pairs.select(F.explode(F.split("words", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = found.join(counts.withColumnsRenamed({"word": "a", "n": "na"}), "a").join(counts.withColumnsRenamed({"word": "b", "n": "nb"}), "b")
    low, high = F.least("na", "nb"), F.greatest("na", "nb")
    counted = cut(counted.withColumn("high", high).withColumn("clear", (F.col("d") == 1) & (low <= SLIP_SHARE * high)))
    sources = counted.where("not clear").select("a", "b").distinct().mapInArrow(third, "a string, b string, word string")
    common = sources.join(counts, "word").groupBy("a", "b").agg(F.max("n").alias("n"))
    judged = counted.join(common, ["a", "b"], "left").select(
        "track", "position",
        (F.col("clear") | F.coalesce(F.col("high") <= SLIP_SHARE * F.col("n"), F.lit(False))).alias("ok"),
        F.when(F.col("na") < F.col("nb"), "a").otherwise("b").alias("side"),
    )
    return (
        judged.groupBy("track", "position")
        .agg(F.min("ok").alias("ok"), F.count("*").alias("n"), F.count_distinct("side").alias("sides"))
        .where("ok and (n = 1 or sides = 2)")
        .select("track", "position")
    )


def event_runs(events: DataFrame, track: str = "track_id", position: str = "cue_idx", text: str = "text") -> DataFrame:
    """One row per run of consecutive events with the same words.

    ``events`` has a track, a position without holes, ``start``, ``duration`` and a
    text.  Repeated rows of a position count once; rows with a null track or position
    are ignored; null and wordless texts equal nothing; an empty table gives an empty
    result; further columns are ignored.  Result: track, ``first_position``,
    ``last_position``, ``events``, ``start``, ``end``, ``duration`` (null where a time is).
    """
    pairs = cut(_pairs(_reduced(events, track, position, text)))
    slipped = _slipped(pairs).withColumn("slip", F.lit(True))
    flagged = pairs.drop("words", "before").join(slipped, ["track", "position"], "left")
    block = Window.partitionBy("track", "block").orderBy("position")
    marked = flagged.select(
        "track", "block", "position", "first", "last", "last_before",
        (~(F.col("same") | F.coalesce("slip", F.lit(False)))).alias("opens"),
        (F.lead("position").over(block).isNull()).alias("tail"),
    )
    kept = marked.where("opens or tail")
    turn = Window.partitionBy("track", "block").orderBy("position")
    bounds = kept.where("opens").select(
        "track", "block", "position", "first", "last_before",
        F.lead("position").over(turn).alias("next"),
        F.lead("last_before").over(turn).alias("next_end"),
        (F.lag("position").over(turn).isNull()).alias("head"),
    )
    inner = bounds.where("next is not null").select("track", "position", F.col("next").alias("stop"), F.col("first").alias("start"), F.col("next_end").alias("end"))
    # along the track: the last boundary of each block, the first of the next that has one, and the track's last event
    line = (
        bounds.where("head").select("track", "position", F.lit(0).alias("what"), F.lit(None).cast("double").alias("start"), F.col("last_before").alias("end"))
        .unionAll(bounds.where("next is null").select("track", "position", F.lit(1), "first", F.lit(None).cast("double")))
        .unionAll(kept.where("tail").select("track", F.col("position") + 1, F.lit(-1), F.lit(None).cast("double"), "last"))
    )
    after = Window.partitionBy("track").orderBy("position", "what").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("track")
    ends = F.when(F.col("what") == 0, F.struct("position", "end"))
    final = F.when(F.col("what") == -1, F.struct("position", "end"))
    outer = (
        line.select("*", F.first(ends, ignorenulls=True).over(after).alias("to"), F.max(final).over(whole).alias("tail"))
        .where("what = 1")
        .select("track", "position", F.coalesce("to", "tail").alias("to"), "start")
        .select("track", "position", F.col("to.position").alias("stop"), "start", F.col("to.end").alias("end"))
    )
    return inner.unionAll(outer).select(
        F.col("track").alias(track),
        F.col("position").alias("first_position"),
        (F.col("stop") - 1).alias("last_position"),
        (F.col("stop") - F.col("position")).alias("events"),
        "start",
        "end",
        (F.col("end") - F.col("start")).alias("duration"),
    )
