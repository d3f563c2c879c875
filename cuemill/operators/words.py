"""Word-level operators: offsets, karaoke, alignment-aware splits, matching, tiers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions import text as T
from cuemill.functions.vectorised import vectorised
from cuemill.functions.kinds import line_type  # noqa: F401
from cuemill.operators import streams
from cuemill.operators.segments import words_of


def word_offsets(text: Column, words: Column) -> Column:
    """Place of each word in the text, searched from the end of the one before; 0 where it is missing."""
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, w: Column) -> Column:
        place = F.locate_from(w, text, acc["at"]) if hasattr(F, "locate_from") else F.call_function("locate", w, text, acc["at"])
        return F.struct(F.when(place > 0, place + F.length(w)).otherwise(acc["at"]).alias("at"), F.concat(acc["found"], F.array(place)).alias("found"))

    return F.aggregate(words, state, step, lambda acc: acc["found"])


def karaoke_text(words: Column, effect: str = "kf") -> Column:
    """Override tags with each word's length in centiseconds, at least 1, up to the next word's start."""

    def tagged(ws: Column) -> Column:
        length = lambda w, i: F.when(i < F.size(ws) - 1, F.get(ws, i + 1)["start"] - w["start"]).otherwise(w["duration"])
        return F.transform(ws, lambda w, i: F.concat(F.lit(f"{{\\{effect}"), F.greatest(F.lit(1), F.rint(length(w, i) * 100).cast("int")).cast("string"), F.lit("}"), w["symbol"]))

    return F.array_join(T.let(words, tagged), " ")


def parse_karaoke(raw: Column) -> Column:
    """Syllables of a text with karaoke tags: symbol, start and duration in seconds from the line's start."""
    p = F.lit("\\{[^}]*?\\\\(?:k[fo]?|K)(\\d+)[^}]*\\}([^{]*)")
    both = F.struct(F.regexp_extract_all(raw, p, F.lit(1)).alias("marks"), F.regexp_extract_all(raw, p, F.lit(2)).alias("said"))

    def timed(x: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(x["marks"], F.lit(1), i), F.lit(0), lambda a, y: a + y.cast("int"))
        return F.transform(x["said"], lambda s, i: F.struct(s.alias("symbol"), F.round(before(i) / 100.0, 4).alias("start"), F.round(F.get(x["marks"], i).cast("int") / 100.0, 4).alias("duration")))

    return T.let(both, timed)


def split_with_words(cues: DataFrame, max_chars: int = 42, max_duration: float = 7.0) -> DataFrame:
    """Cues cut at word borders so that no piece passes either budget; times come from the words.

    ``words``: array of (symbol, start, duration).  Cues without words stay whole.
    """
    group = "struct<text:string,start:double,end:double>"
    empty = F.array().cast(f"array<{group}>")

    def step(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        end = w["start"] + w["duration"]
        fits = (F.size(acc) > 0) & (F.length(last["text"]) + 1 + F.length(w["symbol"]) <= max_chars) & (end - last["start"] <= max_duration)
        grown = F.struct(F.concat_ws(" ", last["text"], w["symbol"]).alias("text"), last["start"].alias("start"), end.alias("end"))
        fresh = F.struct(w["symbol"].alias("text"), w["start"].alias("start"), end.alias("end"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh))).cast(f"array<{group}>")

    whole = F.array(F.struct("text", F.col("start"), (F.col("start") + F.col("duration")).alias("end"))).cast(f"array<{group}>")
    pieces = F.when(F.size("words") > 0, F.aggregate("words", empty, step)).otherwise(whole)
    rest = [c for c in cues.columns if c not in ("text", "start", "duration", "words")]
    return cues.withColumn("pieces", pieces).select(*rest, F.posexplode("pieces").alias("part", "x")).select(
        *rest, "part", "x.text", "x.start", (F.col("x.end") - F.col("x.start")).alias("duration")
    )


GRAM = 12  # characters a shorter text begins with, looked for near the head of a longer one
CONTAINED = 0.8


def match_texts(original: DataFrame, aligned: DataFrame, track: str = "track_id") -> DataFrame:
    """Best aligned line of each original line: equal text (1.0) or one holding the other, scored by length; over 0.8.

    ``original``/``aligned``: track, ``id``, ``text``; a line is not matched with itself (equal
    ``id``); ties go to the least id.  As the shorter text has over 0.8 of the longer one's
    length, it begins within the first fifth of it: candidates are joined on its first
    characters there, so none is lost and no track is compared line by line.  Equal texts
    of a track are compared once.
    """
    own = lambda df: df.select(F.col(track).alias("t"), F.col("id").alias("id"), T.squash(F.col("text")).alias("s")).where("s <> ''")
    a = own(original)
    b = own(aligned).select("t", "s").distinct()
    n = F.length("s")
    key = F.when(n >= GRAM, F.left("s", F.lit(GRAM))).otherwise(F.col("s"))
    reach = F.floor(n * (1 - CONTAINED)).cast("int")
    grams = F.when(n >= GRAM, F.transform(F.sequence(F.lit(0), F.least(reach, n - GRAM)), lambda i: F.substring(F.col("s"), i + 1, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))
    # short texts hold shorter ones whole
    lengths = F.filter(F.sequence(F.lit(1), F.lit(GRAM - 1)), lambda k: (k > CONTAINED * n) & (k <= n))
    short = F.when(n < GRAM / CONTAINED, F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(0), n - k), lambda i: F.substring(F.col("s"), i + 1, k))))).otherwise(F.array().cast("array<string>"))
    keyed = lambda df: df.withColumn("k", key)
    opened = lambda df: df.withColumn("k", F.explode(F.array_distinct(F.concat(grams, short))))
    texts = a.select("t", "s").distinct()
    pair = lambda x, y, first, second: x.select("t", "k", F.col("s").alias(first)).join(y.select("t", "k", F.col("s").alias(second)), ["t", "k"]).select("t", "a", "b")
    both = pair(opened(texts), keyed(b), "a", "b").unionAll(pair(keyed(texts), opened(b), "a", "b")).distinct()
    la, lb = F.length("a"), F.length("b")
    held = F.contains("a", "b") | F.contains("b", "a")
    scored = both.where(held).withColumn("score", F.least(la, lb) / F.greatest(la, lb)).where(F.col("score") > CONTAINED)
    ids = own(aligned).withColumnsRenamed({"s": "b", "id": "b_id"})
    # the two best lines of each text are enough, as only one can be the line itself
    best = scored.join(ids, ["t", "b"]).groupBy("t", "a").agg(F.max(F.struct("score", (-F.col("b_id")).alias("neg"))).alias("x"))
    second = scored.join(ids, ["t", "b"]).join(best, ["t", "a"]).where(-F.col("x.neg") != F.col("b_id")).groupBy("t", "a").agg(F.max(F.struct("score", (-F.col("b_id")).alias("neg"))).alias("y"))
    chosen = a.withColumnRenamed("s", "a").join(best.join(second, ["t", "a"], "left"), ["t", "a"])
    z = F.when(-F.col("x.neg") != F.col("id"), F.col("x")).otherwise(F.col("y"))
    return chosen.withColumn("z", z).where("z is not null").select(F.col("t").alias(track), "id", (-F.col("z.neg")).alias("match"), F.col("z.score").alias("score"))


def event_tiers(cues: DataFrame, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """First tier, greedily, whose last cue ends by the cue's start; a track streams past, one end per tier is kept."""

    def make():
        ends: list[int] = []

        def step(row: tuple | None) -> Iterator[tuple]:
            if row is not None:
                t, start, place, end = row
                tier = next((k for k, e in enumerate(ends) if e <= start), len(ends))
                ends[tier : tier + 1] = [end]
                yield t, place, tier

        return step

    ms = lambda c: F.rint(c * 1000).cast("long")
    rows = cues.where("start is not null and duration is not null").select(F.col(track).cast("long").alias("t"), ms(F.col("start")).alias("s"), F.col(position).cast("long").alias("p"), ms(F.col("start") + F.col("duration")).alias("e")).where("t is not null")
    return streams.fold(rows, "t", ["s", "p", "e"], "t long, p long, tier int", make).select(F.col("t").alias(track), F.col("p").alias(position), "tier")


def split_sentences(cues: DataFrame, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """Sentences by their end marks over cue borders, times by share of characters.

    A sentence left open at a cue's end goes on in the next cue; each piece keeps the cue
    it lies in, and pieces of one sentence are joined with the first start and last end.
    """
    from pyspark.sql import Window

    body = T.squash(F.coalesce("text", F.lit("")))
    marked = F.regexp_replace(body, "([.!?。！？…]+[\"”’»」』)]*)(\\s+|(?<=[。！？])(?=.))", "$1\u0001")
    pieces = F.filter(F.split(marked, "\u0001"), lambda x: x != "")
    base = cues.where("start is not null and duration is not null").select(track, F.col(position).alias("pos"), "start", "duration", "speaker", pieces.alias("pieces"))
    total = F.greatest(F.aggregate("pieces", F.lit(0), lambda a, x: a + F.length(x)), F.lit(1))
    cut = base.withColumn("total", total).select(track, "pos", "start", "duration", "speaker", "total", "pieces", F.posexplode("pieces").alias("part", "piece"))
    before = F.aggregate(F.slice("pieces", F.lit(1), F.col("part")), F.lit(0), lambda a, x: a + F.length(x))
    timed = cut.select(
        track, "pos", "part", "speaker", "piece",
        (F.col("start") + F.col("duration") * before / F.col("total")).alias("s"),
        (F.col("start") + F.col("duration") * (before + F.length("piece")) / F.col("total")).alias("e"),
    )
    order = Window.partitionBy(track).orderBy("pos", "part")
    closed = F.lag(T.ends_sentence(F.col("piece"))).over(order)
    changed = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(order))
    numbered = timed.withColumn("opens", F.when(F.coalesce(closed, F.lit(True)) | changed, 1).otherwise(0)).withColumn("sentence", F.sum("opens").over(order))
    said = F.array_sort(F.collect_list(F.struct("pos", "part", "piece")))
    return numbered.groupBy(track, "sentence").agg(
        F.min("s").alias("start"), F.greatest(F.max("e") - F.min("s"), F.lit(0.0)).alias("duration"), F.max("speaker").alias("speaker"), F.min("pos").alias("first_cue"), F.max("pos").alias("last_cue"),
        F.array_join(F.transform(said, lambda x: x["piece"]), " ").alias("text"),
    )


def split_translation(translation: Column, shares: Column) -> Column:
    """A translation in as many slices as ``shares``, cut at the blank or CJK mark nearest each share; nothing is lost.

    Slices hold their blanks, so joined they give the translation back.
    """

    return vectorised(slices, "array<string>")(translation, shares)


def slices(text: str | None, parts: list[float] | None) -> list[str] | None:
    if text is None or not parts:
        return None
    total, out, at, reached = sum(parts) or 1.0, [], 0, 0.0
    for p in parts[:-1]:
        reached += p
        target = round(len(text) * reached / total)
        best = None
        for k in range(at, len(text) + 1):
            before = text[k - 1 : k]
            if k == at or before.isspace() or before in "，。！？、；：,.;:!?":
                joined = k < len(text) and (text[k] in "‍️" or "̀" <= text[k] <= "ͯ")
                if not joined and (best is None or abs(k - target) < abs(best - target)):
                    best = k
        best = at if best is None else best
        out.append(text[at:best])
        at = best
    return [*out, text[at:]]
