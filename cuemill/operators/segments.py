"""Re-segmentation: words, long lines, long cues, same-speaker runs and bilingual layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import text as T


def words_of(text: Column) -> Column:
    return F.filter(F.split(T.squash(text), " "), lambda w: w != "")


def with_even_words(cues: DataFrame) -> DataFrame:
    """``words``: the text's words in equal parts of the cue, for cues that come without word times."""

    def even(w: Column) -> Column:
        part = F.col("duration") / F.size(w)
        return F.when(F.size(w) > 0, F.transform(w, lambda x, i: F.struct(x.alias("symbol"), (F.col("start") + i * part).alias("start"), part.alias("duration"))))

    return cues.withColumn("words", T.let(words_of(F.col("text")), even))


def expand_words(cues: DataFrame) -> DataFrame:
    """One row per word; cues without words stay whole with a null ``word_idx``."""
    rest = [c for c in cues.columns if c not in ("words", "text", "start", "duration")]
    out = cues.select(*rest, F.col("text").alias("__t"), F.col("start").alias("__s"), F.col("duration").alias("__d"), F.posexplode_outer("words").alias("word_idx", "w"))
    return out.select(*rest, "word_idx", F.coalesce("w.symbol", "__t").alias("text"), F.coalesce("w.start", "__s").alias("start"), F.coalesce("w.duration", "__d").alias("duration"))


def split_long_lines(cues: DataFrame, width: int = 42, max_lines: int = 2) -> DataFrame:
    """Texts over ``width * max_lines`` become several cues of equal length, the speaker on the first; all are wrapped.

    Null times stay null; an empty text stays one cue.
    """
    body = F.trim(F.coalesce("text", F.lit("")))
    parts = F.when(F.length(body) <= width * max_lines, F.array(body)).otherwise(T.chunks(body, width * max_lines))
    n = F.greatest(F.size("parts"), F.lit(1))
    rest = [c for c in cues.columns if c not in ("text", "start", "duration", "speaker")]
    cut = cues.withColumn("parts", parts).withColumn("each", F.col("duration") / n)
    return cut.select(*rest, "speaker", "start", "each", n.alias("of"), F.posexplode("parts").alias("part", "piece")).select(
        *rest,
        "part",
        F.when(F.col("part") == 0, F.col("speaker")).alias("speaker"),
        (F.col("start") + F.col("part") * F.col("each")).alias("start"),
        F.col("each").alias("duration"),
        T.wrap(F.col("piece"), width, max_lines).alias("text"),
    )


def split_long_cues(cues: DataFrame, max_chars: int = 84, max_duration: float = 7.0, gap: float = 0.0) -> DataFrame:
    """Cues over a budget of characters or seconds in as many even pieces as needed; times by share of characters.

    The last piece ends where the cue ends.
    """
    body = T.squash(F.coalesce("text", F.lit("")))
    need = F.greatest(F.ceil(F.length(body) / max_chars), F.ceil(F.col("duration") / max_duration), F.lit(1)).cast("int")
    # width so that greedy chunks come out at most ``need`` or a little more
    width = F.greatest(F.ceil(F.length(body) / need), F.lit(1))
    words = words_of(body)
    empty = F.array().cast("array<string>")
    pieces = F.aggregate(
        words, empty,
        lambda acc, w: F.when((F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + 1 + F.length(w) <= width), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), w)))).otherwise(F.concat(acc, F.array(w))),
    )
    rest = [c for c in cues.columns if c not in ("text", "start", "duration")]
    base = cues.withColumns({"need": need, "pieces": F.when((need > 1) & (F.size(words) > 1), pieces).otherwise(F.array(F.col("text")))})
    total = F.greatest(F.aggregate("pieces", F.lit(0), lambda a, x: a + F.length(x)), F.lit(1))
    before = lambda k: F.aggregate(F.slice("pieces", F.lit(1), k), F.lit(0), lambda a, x: a + F.length(x))
    out = base.withColumn("total", total).select(*rest, "start", "duration", "total", "pieces", F.posexplode("pieces").alias("part", "piece"))
    share = before(F.col("part")) / F.col("total")
    upto = before(F.col("part") + 1) / F.col("total")
    last = F.col("part") == F.size("pieces") - 1
    return out.select(
        *rest, "part", F.round(F.col("start") + share * F.col("duration"), 4).alias("start"),
        F.round((upto - share) * F.col("duration") - F.when(last, 0.0).otherwise(gap), 4).alias("duration"), F.col("piece").alias("text"),
    )


def merge_same_speaker(cues: DataFrame, max_gap: float = 2.0, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """Consecutive cues of one speaker with gaps up to ``max_gap`` become one; null speakers equal each other."""
    order = Window.partitionBy(track).orderBy("start", position)
    gap = F.col("start") - F.lag(F.col("start") + F.col("duration")).over(order)
    opens = F.when(F.col("speaker").eqNullSafe(F.lag("speaker").over(order)) & (gap <= max_gap), 0).otherwise(1)
    run = cues.where("start is not null and duration is not null").withColumn("opens", opens).withColumn("run", F.sum("opens").over(order))
    said = F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), F.col(position).alias("p"), "text")))
    return run.groupBy(track, "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("duration")).alias("end"), F.max("speaker").alias("speaker"), F.count("*").alias("merged"),
        F.array_join(F.transform(said, lambda x: F.coalesce(x["text"], F.lit(""))), " ").alias("text"),
    )


def merge_lines(cues: DataFrame) -> DataFrame:
    """First line as text, the rest as translation."""
    lines = F.split("text", "\n", 2)
    return cues.withColumn("translation", F.get(lines, F.lit(1))).withColumn("text", F.get(lines, F.lit(0)))


def merge_pairs(cues: DataFrame, tolerance: float = 0.01, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """Neighbours of equal start and duration as one bilingual cue; in longer runs every two in order."""
    order = Window.partitionBy(track).orderBy(position)
    same = (F.abs(F.col("start") - F.lag("start").over(order)) <= tolerance) & (F.abs(F.col("duration") - F.lag("duration").over(order)) <= tolerance)
    run = cues.withColumn("opens", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("opens").over(order))
    nth = F.row_number().over(Window.partitionBy(track, "run").orderBy(position)) - 1
    pair = run.withColumn("pair", F.floor(nth / 2)).withColumn("side", nth % 2)
    return pair.groupBy(track, "run", "pair").agg(
        F.min(position).alias(position), F.min("start").alias("start"), F.min("duration").alias("duration"),
        F.max(F.when(F.col("side") == 0, F.col("text"))).alias("text"), F.max(F.when(F.col("side") == 1, F.col("text"))).alias("translation"),
    ).drop("run", "pair")


def extract_sides(cues: DataFrame) -> DataFrame:
    """A row per side of bilingual cues, for alignment of either language."""
    sides = F.array(F.struct(F.lit("primary").alias("side"), F.col("text").alias("said")), F.struct(F.lit("secondary").alias("side"), F.col("translation").alias("said")))
    return cues.withColumn("x", F.explode(sides)).where("x.said is not null and x.said <> ''").select(*[c for c in cues.columns if c not in ("text", "translation")], "x.side", F.col("x.said").alias("text"))


def is_event(text: Column) -> Column:
    """A text that is all in brackets, such as ``[Music]``."""
    return F.trim(text).rlike("(?s)^\\[.*\\]$")


# Fixed value: a name of one to four capitalised words before a colon.
NAME_LABEL = "^([A-Z][a-zA-Z\\x{00C0}-\\x{024F}'-]+(?:\\s+[A-Z][a-zA-Z\\x{00C0}-\\x{024F}'-]+){0,3})[:：]\\s+"


def frequent_names(lines: DataFrame, least: int = 3, track: str = "track_id") -> DataFrame:
    """Names before a colon seen at least ``least`` times in a track."""
    name = F.nullif(F.regexp_extract("text", NAME_LABEL, 1), F.lit(""))
    return lines.select(track, name.alias("name")).where("name is not null").groupBy(track, "name").agg(F.count("*").alias("lines")).where(F.col("lines") >= least)


def speaker_candidates(lines: DataFrame, track: str = "track_id", position: str = "cue_idx", least: int = 3) -> DataFrame:
    """Names that label speakers, with the ``lines`` they stand before.

    A name seen ``least`` times is one, and so is its neighbour among the labels if it
    recurs.  Without any such name all names of a track count if they alternate, recur and
    leave lines without a label between them, or if every line has a label, none twice in
    a row and four at least.  Blank lines do not count.
    """
    spoken = lines.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    order = Window.partitionBy(track).orderBy(position)
    labelled = spoken.select(track, position, F.row_number().over(order).alias("nr"), F.nullif(F.regexp_extract("text", NAME_LABEL, 1), F.lit("")).alias("name"))
    totals = labelled.groupBy(track).agg(F.count("*").alias("all"))
    names = labelled.where("name is not null")
    counts = names.groupBy(track, "name").agg(F.count("*").alias("lines"))
    counted = names.join(counts, [track, "name"])
    beside = counted.select(
        track, "name", "nr", "lines", F.lag("name").over(order).alias("before"), F.lag("lines").over(order).alias("lines_before"), F.lead("name").over(order).alias("behind"),
        F.lead("lines").over(order).alias("lines_behind"), F.lag("nr").over(order).alias("nr_before"),
    )
    sure = F.col("lines") >= least
    near = (F.col("lines") >= 2) & ((F.col("lines_before") >= least) | (F.col("lines_behind") >= least))
    facts = beside.groupBy(track).agg(
        F.bool_or(sure).alias("any_sure"), F.count_distinct("name").alias("names"), F.count("*").alias("labels"),
        F.bool_or(F.coalesce(F.col("before") != F.col("name"), F.lit(False))).alias("alternates"), F.bool_and(F.coalesce(F.col("before") != F.col("name"), F.lit(True))).alias("never_twice"),
        F.bool_or(F.col("lines") >= 2).alias("recurs"), F.bool_or(F.coalesce(F.col("nr") - F.col("nr_before") > 1, F.lit(False))).alias("gaps"),
    ).join(totals, track)
    talk = (F.col("names") >= 2) & (F.col("alternates") & F.col("recurs") & F.col("gaps") | (F.col("labels") == F.col("all")) & F.col("never_twice") & (F.col("labels") >= 4))
    told = beside.join(facts.select(track, "any_sure", talk.alias("talk")), track)
    return told.where(F.when(F.col("any_sure"), sure | near).otherwise(F.col("talk"))).groupBy(track, "name").agg(F.max("lines").alias("lines"))


def by_candidates(cues: DataFrame, candidates: DataFrame, *keys: str, exact: bool = False) -> DataFrame:
    """Cues whose speaker, without its colon unless ``exact``, is a candidate (``speaker``), of the same ``keys`` where given."""
    bare = F.col("speaker") if exact else F.regexp_replace(F.rtrim("speaker"), "[:：]+$", "")
    known = candidates.select(*keys, F.col("speaker").alias("__name")).distinct()
    return cues.withColumn("__name", bare).join(known, [*keys, "__name"], "left_semi").drop("__name")


def apply_alignment(cues: DataFrame, aligned: DataFrame, keys: list[str]) -> DataFrame:
    """New times written back by key; cues without a partner keep theirs."""
    new = aligned.select(*keys, F.col("start").alias("__s"), F.col("duration").alias("__d"))
    return cues.join(new, keys, "left").withColumns({"start": F.coalesce("__s", "start"), "duration": F.coalesce("__d", "duration")}).drop("__s", "__d")
