"""Speaker turns of transcripts.

Each line is parsed by itself: stamps, speaker labels, sound notes and hesitation are
taken off, and its label is resolved against the register of people.  Labels that fit
several people go to the one of them that the track names most often beyond doubt.  A
sweep along each track, by position or by time, carries the speaker forward and cuts
turns at speaker changes, section headers and, where asked for, at pauses beyond what is
usual in the track; text that a line repeats from the end of the line before it (rolling
subtitles) is dropped by suffix-prefix overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.runs import HESITATIONS, distance
from cuemill.session import cut

REGISTER_LIMIT = 200_000
BLOCK = 4096
BLOCK_SECONDS = 3600
LEAST_PAUSE = 2.0
USUAL_PAUSES = 0.9  # share of a track's own pauses that are no break

_STAMP = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_STAMPED = re.compile(rf"[\[(]\s*{_STAMP}(?:\s*(?:-->|→|-|–)\s*{_STAMP})?\s*[\])]|(?<![\d:]){_STAMP}(?![\d:])(?:\s+[-–—](?=\s))?")
_NOTE = re.compile(r"\[[^\]\n]+\]|\([^)\d\n]+\)|（[^）\n]+）|【[^】\n]+】|[♪♫][^♪♫\n]+[♪♫]|(?<!\*)\*(?!\*)[^*\n]+\*(?!\*)")
_TAG = re.compile(r"<[^<>]+>|\{\\[^{}]*\}")
_BOLD = re.compile(r"^\s*\*\*([^*\n]+?)\s*:?\*\*\s*:?\s*")
_BRACKET = re.compile(r"^\s*\[([^\]\n]+)\]\s*:?\s*")
_PLAIN = re.compile(r"^\s*([^:\n]+?)\s*:\s+")
_MARK = re.compile(r"^(?:\s|>>+|[-–—](?=\s))+")
_PARTY = re.compile(r"\(([^)]*)\)")
# Titles and forms of address before names.
_TITLES = frozenset("the hon honourable dr prof mr mrs ms miss m mme mlle hr herr fr frau sr sra d don doña exmo lord lady sir rev minister chair member president".split())
_HESITANT = re.compile(r"(?<![^\W_])(" + "|".join(sorted(map(re.escape, HESITATIONS), key=len, reverse=True)) + r")(?:\s*,\s*(?:" + "|".join(sorted(map(re.escape, HESITATIONS), key=len, reverse=True)) + r"))*(?:…|\.{3}|,|、)(?![^\W_])\s*", re.IGNORECASE)


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text).casefold()
    return "".join(c for c in text if not unicodedata.combining(c))


class Register:
    """People by surname and given name; labels may be shortened, turned round, respelt or hold one slip."""

    def __init__(self, people: list[tuple]):
        self.people = {i: (fold(given or ""), fold(surname or ""), fold(party or "")) for i, given, surname, party in people}
        self.by_surname: dict[str, list[int]] = defaultdict(list)
        for i, (_, surname, _) in self.people.items():
            self.by_surname[surname].append(i)
        self.by_full = {f"{g} {s}": i for i, (g, s, _) in self.people.items()}
        self.near: dict[str, list[str]] = defaultdict(list)
        for surname in self.by_surname:
            for k in range(len(surname)):
                self.near[surname[:k] + surname[k + 1 :]].append(surname)
            self.near[surname].append(surname)
        self.resolve = lru_cache(100_000)(self._resolve)

    def surnames(self, token: str) -> list[str]:
        """Surnames equal to a token, else those one slip away."""
        if token in self.by_surname:
            return [token]
        if len(token) < 5:
            return []
        keys = {token, *(token[:k] + token[k + 1 :] for k in range(len(token)))}
        found = {s for k in keys for s in self.near.get(k, ())}
        return sorted(s for s in found if distance(s, token, 1) <= 1)

    def _resolve(self, label: str, sure: bool = False) -> tuple[int, ...]:
        """Ids of the people a label fits best; none if it is no label of a person.

        Where it is ``sure`` to be a label, other words may stand beside a full name.
        """
        party = _PARTY.search(label)
        core = _PARTY.sub(" ", label)
        folded = fold(core).replace("’", "'")
        tokens = [t for t in re.split(r"[^\w'-]+", folded.replace("_", " ")) if t.strip("-'")]
        tokens = [t.strip("-'") for t in tokens]
        while len(tokens) > 1 and tokens[0] in _TITLES and len(tokens[0]) > 1:
            tokens.pop(0)
        if not tokens:
            return ()
        best: dict[int, float] = {}
        for i, t in enumerate(tokens):
            exact = t in self.by_surname
            for surname in self.surnames(t):
                rest = tokens[:i] + tokens[i + 1 :]
                for person in self.by_surname[surname]:
                    given = self.people[person][0]
                    score, bad = (4.0 if exact else 2.0), False
                    for r in rest:
                        if r == given:
                            score += 3
                        elif len(r) <= 2 and given.startswith(r[0]):
                            score += 1.5
                        elif len(r) >= 4 and distance(r, given, 1) <= 1:
                            score += 2
                        elif r in _TITLES:
                            pass
                        else:
                            bad = True
                            break
                    if bad and not (sure and exact and given in rest):
                        continue
                    if party and fold(party.group(1)).strip() == self.people[person][2]:
                        score += 1
                    best[person] = max(best.get(person, 0), score)
        if not best:
            return ()
        top = max(best.values())
        return tuple(sorted(p for p, s in best.items() if s == top))


def parse_line(text: str | None, column: str | None, register: Register) -> tuple[bool, bool, tuple[int, ...], str]:
    """(spoken, labelled, people, clean text) of one line."""
    body = _TAG.sub("", text or "")
    body = _STAMPED.sub(" ", body)
    body = _MARK.sub("", body)
    people: tuple[int, ...] = ()
    labelled = False
    for pattern in (_BOLD, _BRACKET, _PLAIN):
        m = pattern.match(body)
        if not m:
            continue
        found = register.resolve(m.group(1).strip(), pattern is _BOLD)
        if found or pattern is _BOLD:
            people, labelled = found, True
            body = _MARK.sub("", body[m.end() :])
            break
    if column and column.strip(" :—–-*"):
        people, labelled = register.resolve(column.strip(), True) or people, True
    body = _NOTE.sub(" ", body)
    clean = _HESITANT.sub(" ", body)
    clean = re.sub(r"\s+([,.;:!?…])", r"\1", " ".join(clean.split())).lstrip(",.…;: -–—")
    spoken = any(w not in HESITATIONS and w != "mm-hmm" for w in re.findall(r"[^\W_]+(?:-[^\W_]+)*[̀-ͯऀ-ॿ]*", clean.lower()))
    return spoken, labelled, people, clean


def parse_lines(lines: DataFrame, speakers: DataFrame) -> DataFrame:
    """Stateless reading of every line: ``spoken``, ``labelled``, ``people`` and ``clean``."""
    people = [tuple(r) for r in speakers.select("speaker_id", "given_name", "surname", "party").distinct().orderBy("speaker_id").limit(REGISTER_LIMIT + 1).collect()]
    if len(people) > REGISTER_LIMIT:
        raise ValueError(f"the register holds more than {REGISTER_LIMIT} people")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        register = Register(people)
        for batch in batches:
            read = [parse_line(t, s, register) for t, s in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)]
            spoken, labelled, who, clean = zip(*read, strict=True) if read else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(spoken, pa.bool_()), pa.array(labelled, pa.bool_()), pa.array([list(w) for w in who], pa.list_(pa.int64())), pa.array(clean, pa.string())],
                ["track", "line", "header", "start", "stop", "spoken", "labelled", "people", "clean"],
            )

    schema = "track long, line long, header boolean, start double, stop double, spoken boolean, labelled boolean, people array<long>, clean string"
    return lines.select("track", "line", "header", "start", "stop", "text", "speaker").mapInArrow(work, schema)


def turns(lines: DataFrame, speakers: DataFrame, by_time: bool = False, split_at_pauses: bool = False) -> DataFrame:
    """Ordered turns of every track.

    ``lines``: ``track``, ``line`` (position), ``header`` (section header), ``start`` and
    ``stop`` in seconds, ``text``, ``speaker``.  Rows that agree in track and line count
    once; null texts are unspoken; rows without track or line are ignored; lines before
    the first known speaker form no turn; a label that fits no one of the register ends
    the turn and opens none.  ``by_time`` sweeps in order of ``start`` (a line without one
    stays behind the line before it), else in order of position; ``split_at_pauses`` ends
    turns at pauses over 2 s and over the track's own 90th percentile of pauses.  Result:
    ``track_id``, ``turn``, ``first_line``, ``last_line``, ``speaker_id``, ``start``,
    ``stop``, ``lines``, ``pauses`` (such pauses inside), ``text``.
    """
    read = parse_lines(lines.where("track is not null and line is not null").dropDuplicates(["track", "line"]), speakers)
    read = cut(read)
    sure = (
        read.where("size(people) = 1").groupBy("track", F.col("people")[0].alias("person")).agg(F.count("*").alias("n"))
    )
    doubt = (
        read.where("size(people) > 1")
        .select("track", "line", F.explode("people").alias("person"))
        .join(sure, ["track", "person"], "left")
        .groupBy("track", "line")
        .agg(F.max(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.col("person")).alias("p"))).alias("x"))
        .select("track", "line", (-F.col("x.p")).alias("judged"))
    )
    named = read.join(doubt, ["track", "line"], "left").withColumn(
        "own", F.when(F.col("labelled"), F.coalesce("judged", F.when(F.size("people") == 1, F.col("people")[0]), F.lit(-1)))
    )
    placed = named.withColumn("block", F.floor(F.col("line") / BLOCK)).withColumn("at", F.lit(0.0))
    if by_time:
        placed = _timed(placed)
    opened = cut(_swept(placed))
    limits = opened.groupBy("track").agg(F.greatest(F.lit(LEAST_PAUSE), F.percentile_approx("pause", USUAL_PAUSES)).alias("limit"))
    marked = opened.join(limits, "track").withColumn("long", F.coalesce(F.col("pause") > F.col("limit"), F.lit(False)))
    fresh = F.when(F.col("opens"), F.col("clean")).otherwise(_fresh(F.col("before"), F.col("clean")))
    marked = marked.withColumn("said", fresh)
    if split_at_pauses:
        marked = marked.withColumn("opens", F.col("opens") | F.col("long"))
    said = F.array_sort(F.collect_list(F.struct("at", "line", "said")))
    return (
        _numbered(marked).where("person > 0")
        .groupBy("track", "turn")
        .agg(
            F.min("line").alias("first_line"),
            F.max("line").alias("last_line"),
            F.first("person").alias("speaker_id"),
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            F.count("*").alias("lines"),
            F.count_if(~F.col("opens") & F.col("long")).alias("pauses"),
            F.array_join(F.filter(F.transform(said, lambda x: x["said"]), lambda x: x != ""), " ").alias("text"),
        )
        .withColumnRenamed("track", "track_id")
    )


def _timed(placed: DataFrame) -> DataFrame:
    """Places by time: lines without a start take the last one before them, carried from block to block by one row each."""
    upto = Window.partitionBy("track", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = Window.partitionBy("track").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lasts = placed.groupBy("track", "block").agg(F.max_by("start", F.when(F.col("start").isNotNull(), F.col("line"))).alias("last"))
    carried = lasts.select("track", "block", F.last("last", ignorenulls=True).over(past).alias("came"))
    filled = placed.join(carried, ["track", "block"]).withColumn("at", F.coalesce(F.last("start", ignorenulls=True).over(upto), "came", F.lit(-1e18)))
    return filled.withColumn("block", F.when(F.col("at") < 0, F.lit(-1)).otherwise(F.floor(F.col("at") / BLOCK_SECONDS))).drop("came")


def _swept(placed: DataFrame) -> DataFrame:
    """Spoken lines with their speaker, the line before them and whether they open a turn.

    The sweep runs in blocks; what a block needs of the lines before it (headers so far,
    last speaker, last spoken line) comes from one summary row per block, so that no track
    is swept in one task.
    """
    order = Window.partitionBy("track", "block").orderBy("at", "line")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("sections", F.sum(F.col("header").cast("int")).over(so_far))
    talk = F.col("spoken") & ~F.col("header")
    place = F.struct("at", "line")
    last = lambda c: F.max_by(F.when(talk, F.struct(c)), F.when(talk, place))
    blocks = local.groupBy("track", "block").agg(
        F.sum(F.col("header").cast("int")).alias("headers"),
        F.max_by("own", F.when(talk & F.col("own").isNotNull(), place)).alias("own_out"),
        last("sections").alias("section_out"), last("clean").alias("clean_out"), last("stop").alias("stop_out"),
    )
    past = Window.partitionBy("track").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = blocks.withColumn("headers_in", F.coalesce(F.sum("headers").over(past), F.lit(0)))
    incoming = offset.withColumn("section_out", F.when(F.col("section_out").isNotNull(), F.col("section_out.sections") + F.col("headers_in"))).select(
        "track", "block", "headers_in",
        F.last("own_out", ignorenulls=True).over(past).alias("person_in"), F.last("section_out", ignorenulls=True).over(past).alias("section_in"),
        F.last("clean_out", ignorenulls=True).over(past).alias("clean_in"), F.last("stop_out", ignorenulls=True).over(past).alias("stop_in"),
    )
    said = local.where(talk).join(incoming, ["track", "block"]).withColumn("sections", F.col("sections") + F.col("headers_in"))
    said = said.withColumn("person", F.coalesce(F.last("own", ignorenulls=True).over(so_far), "person_in"))
    begins = F.row_number().over(order) == 1
    before = lambda c, came: F.when(begins, came).otherwise(F.lag(c).over(order))
    same = (before("person", F.col("person_in")) == F.col("person")) & (before("sections", F.col("section_in")) == F.col("sections"))
    return said.select(
        "track", "block", "at", "line", "start", "stop", "clean", "person",
        (~F.coalesce(same, F.lit(False))).alias("opens"),
        before("clean", F.col("clean_in.clean")).alias("before"),
        (F.col("start") - before("stop", F.col("stop_in.stop"))).alias("pause"),
    )


def _numbered(opened: DataFrame) -> DataFrame:
    """The number of each line's turn in its track, counted in blocks."""
    so_far = Window.partitionBy("track", "block").orderBy("at", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = Window.partitionBy("track").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbers = opened.groupBy("track", "block").agg(F.count_if("opens").alias("n")).withColumn("turns_in", F.coalesce(F.sum("n").over(past), F.lit(0)))
    return opened.join(numbers.select("track", "block", "turns_in"), ["track", "block"]).withColumn("turn", F.col("turns_in") + F.sum(F.col("opens").cast("int")).over(so_far))


def _fresh(before, now):
    """What a line adds to the one before it: the longest suffix of whole words it repeats is dropped."""
    words, last = F.split(now, " "), F.split(before, " ")
    sizes = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(words), F.size(last))))
    shared = F.filter(sizes, lambda k: (k >= 3) & (F.slice(words, F.lit(1), k) == F.slice(last, F.size(last) - k + 1, k)))
    overlap = F.coalesce(F.array_max(shared), F.lit(0))
    return F.when(before.isNull() | (before == ""), now).otherwise(F.array_join(F.slice(words, overlap + 1, F.greatest(F.size(words) - overlap, F.lit(0))), " "))
