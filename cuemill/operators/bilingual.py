"""Layouts of bilingual tracks: told apart, taken to two sides for alignment, merged into cues with translations.

Times count as equal within ``SAME``; a side of a layout must cover ``COVERAGE`` of a track's cues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import languages as L
from cuemill.functions import text as T
from cuemill.operators.words import line_type

SAME = 0.01
COVERAGE = 0.2
SPREAD = 0.4
MODES = ("none", "line_by_line", "same_timing_pairs", "style_grouped")


def _given(cues: DataFrame, name: str) -> Column:
    return F.col(name) if name in cues.columns else F.lit(None).cast("string")


def _paired(cues: DataFrame, track: str, position: str) -> DataFrame:
    """``run`` of cues of equal times and ``nth`` in it; of a run the first and second, third and fourth are pairs."""
    order = Window.partitionBy(track).orderBy(position)
    same = (F.abs(F.col("start") - F.lag("start").over(order)) < SAME) & (F.abs(F.col("duration") - F.lag("duration").over(order)) < SAME)
    runs = cues.withColumn("__opens", F.coalesce((~same).cast("int"), F.lit(1))).withColumn("__run", F.sum("__opens").over(order))
    return runs.withColumn("__nth", F.row_number().over(Window.partitionBy(track, "__run").orderBy(position)) - 1)


def _pairs(cues: DataFrame, track: str, position: str) -> DataFrame:
    """Cues with ``__pair`` (number in the run) and ``__whole`` (whether the pair has two)."""
    paired = _paired(cues, track, position).withColumn("__pair", F.floor(F.col("__nth") / 2))
    return paired.withColumn("__whole", F.count("*").over(Window.partitionBy(track, "__run", "__pair")) == 2)


def style_ratios(cues: DataFrame, track: str = "track_id") -> DataFrame:
    """Mean share of CJK characters and cues of each style."""
    return cues.where("style <> '' and text <> ''").groupBy(track, "style").agg(F.avg(T.cjk_ratio(F.col("text"))).alias("ratio"), F.count("*").alias("styled"))


def extreme_styles(cues: DataFrame, track: str = "track_id") -> DataFrame:
    """Per track the styles of highest and lowest mean share, ties to the first by name."""
    ranked = F.struct("ratio", "style")
    return style_ratios(cues, track).groupBy(track).agg(
        F.max_by(F.struct("style", "ratio", "styled"), F.struct(F.col("ratio"), F.col("styled"))).alias("high"), F.min_by(F.struct("style", "ratio", "styled"), ranked).alias("low"), F.count("*").alias("styles")
    )


def bilingual_mode(cues: DataFrame, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """``mode`` of each track with the counts it rests on.

    ``cues``: track, position, ``start``, ``duration``, ``text`` and, where styles are known,
    ``style``.  Line breaks between two scripts come first, then neighbours of equal times and
    different scripts, then two styles of different scripts.
    """
    cues = cues.withColumn("style", _given(cues, "style"))
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", 2)
    a, b = T.cjk_ratio(F.get(lines, F.lit(0))), T.cjk_ratio(F.coalesce(F.get(lines, F.lit(1)), F.lit("")))
    facts = cues.select(track, F.contains(text, F.lit("\n")).alias("broken"), ((a >= 0.6) & (b <= 0.2) | (b >= 0.6) & (a <= 0.2)).alias("split"))
    counted = facts.groupBy(track).agg(F.count("*").alias("n"), F.count_if("broken").alias("broken"), F.count_if(F.col("broken") & F.col("split")).alias("split"))
    pairs = (
        _pairs(cues.withColumn("__ratio", T.cjk_ratio(text)), track, position).where("__whole")
        .groupBy(track, "__run", "__pair").agg((F.max("__ratio") - F.min("__ratio")).alias("apart"))
        .groupBy(track).agg(F.count("*").alias("pairs"), F.count_if(F.col("apart") > SPREAD).alias("different"))
    )
    joined = counted.join(pairs, track, "left").join(extreme_styles(cues, track), track, "left").fillna(0, ["pairs", "different", "styles"])
    n = F.col("n")
    mode = (
        F.when((F.col("broken") >= 2) & (F.col("split") > 0.5 * F.col("broken")) & (F.col("split") >= COVERAGE * n), "line_by_line")
        .when((F.col("pairs") >= 2) & (F.col("different") > 0.5 * F.col("pairs")) & (2 * F.col("pairs") >= COVERAGE * n), "same_timing_pairs")
        .when((F.col("styles") >= 2) & (F.col("high.ratio") - F.col("low.ratio") > SPREAD) & (F.least("high.styled", "low.styled") >= COVERAGE * n), "style_grouped")
        .otherwise("none")
    )
    return joined.select(track, mode.alias("mode"), "n", "broken", "split", "pairs", "different")


def alignable(text: Column, start: Column, duration: Column, raw: Column, kind: Column) -> Column:
    """Text that is said: not empty, over 10 ms, no drawing and of no kind but dialogue."""
    return F.coalesce((text != "") & (duration > 0.01) & ~F.coalesce(kind == "drawing", F.lit(False)) & line_type(text, start, raw).isNull(), F.lit(False))


def simple_mono(cues: DataFrame, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """``simple``: whether a track needs no stripping or sorting out: plain one-line texts, no styles, no equal times, no early credits."""
    order = Window.partitionBy(track).orderBy(position)
    same = (F.abs(F.col("start") - F.lag("start").over(order)) < SAME) & (F.abs(F.col("duration") - F.lag("duration").over(order)) < SAME)
    plain = F.trim(F.coalesce("text", F.lit("")))
    bare = F.coalesce(_given(cues, "style"), F.lit("")) == ""
    bare &= F.coalesce(_given(cues, "raw"), F.lit("")) == ""
    bare &= _given(cues, "kind").isNull()
    ok = (plain != "") & ~F.contains("text", F.lit("\n")) & F.coalesce(F.col("duration") > 0.01, F.lit(False)) & bare & ~F.coalesce(same, F.lit(False))
    ok &= line_type(plain, F.col("start"), F.lit("")).isNull()
    return cues.withColumn("__ok", ok).groupBy(track).agg(F.bool_and("__ok").alias("simple"))


def vote_language(sides: DataFrame, *keys: str) -> DataFrame:
    """Language of all texts of a group together: the one most texts are in by their length; script where no language tells."""
    told = sides.withColumn("__lang", F.coalesce(L.detect_language(F.col("text")), L.detect_script(F.col("text"))))
    weighed = told.where("__lang is not null").groupBy(*keys, "__lang").agg(F.sum(F.length("text")).alias("__n"))
    return weighed.groupBy(*keys).agg(F.max_by("__lang", F.struct("__n", "__lang")).alias("language"))


def alignment_sides(cues: DataFrame, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """The texts to be aligned: ``side`` (primary or secondary), position, times, plain ``text`` and the side's ``language``.

    ``cues``: track, position, ``start``, ``duration``, ``text`` and, where known, ``style``,
    ``raw`` (text with override tags) and ``kind`` (line type).  The layout decides how cues
    fall into sides.  A second side in the first one's script is no second side, nor is a
    very small one (below 5 %, or below a third and ten rows where it has rows of its own):
    its rows go back to the first side in order, or, where both lie in the same cues, are dropped.
    """
    modes = bilingual_mode(cues, track, position).select(track, "mode")
    full = cues.withColumns({"style": _given(cues, "style"), "raw": _given(cues, "raw"), "kind": _given(cues, "kind"), "text": F.coalesce("text", F.lit(""))})
    base = _pairs(full, track, position).join(modes, track)
    lines = F.split("text", "\n")
    styles = extreme_styles(full, track).select(track, F.col("high.style").alias("hs"), F.col("high.ratio").alias("hr"), F.col("low.style").alias("ls"), F.col("low.ratio").alias("lr"))
    base = base.join(styles, track, "left")
    by_line = F.col("mode") == "line_by_line"
    by_pair = (F.col("mode") == "same_timing_pairs") & F.col("__whole")
    by_style = F.col("mode") == "style_grouped"
    ratio = T.cjk_ratio(T.strip_override_tags(F.col("text")))
    nearer = F.abs(ratio - F.col("hr")) <= F.abs(ratio - F.col("lr"))
    second = F.when(by_pair, F.col("__nth") % 2 == 1).when(by_style, F.when(F.col("style") == F.col("ls"), True).when(F.col("style") == F.col("hs"), False).otherwise(~nearer)).otherwise(False)
    first = F.when(by_line, F.get(lines, F.lit(0))).otherwise(F.col("text"))
    parts = F.array(F.struct(second.cast("int").alias("k"), T.strip_override_tags(first).alias("said")), F.struct(F.lit(1).alias("k"), T.strip_override_tags(F.when(by_line, F.get(lines, F.lit(1)))).alias("said")))
    spread = base.select(track, position, "start", "duration", "raw", "kind", "mode", "__run", "__pair", "__whole", "hs", "ls", "style", F.explode(parts).alias("x")).where("x.said is not null")
    told = spread.select("*", F.col("x.k").alias("k"), F.col("x.said").alias("said")).withColumn("__ok", alignable(F.col("said"), F.col("start"), F.col("duration"), F.col("raw"), F.col("kind")))
    # of two halves that belong together an unfit one takes the other along; an empty second half does not
    unit = F.when(by_line, F.col(position)).when(by_pair, F.min(position).over(Window.partitionBy(track, "__run", "__pair"))).otherwise(F.col(position))
    bad = ~F.col("__ok") & ((F.col("said") != "") | (F.col("k") == 0))
    kept = told.withColumn("__unit", unit).withColumn("__bad", F.max(bad.cast("int")).over(Window.partitionBy(track, "__unit"))).where("__ok and __bad = 0")
    sides = kept.select(track, position, "start", "duration", "mode", "k", F.col("said").alias("text"), ((F.col("mode") != "style_grouped") | F.col("style").isin(F.col("hs")) | F.col("style").isin(F.col("ls"))).alias("votes"))
    votes = vote_language(sides.where("votes"), track, "k")
    sizes = sides.groupBy(track).agg(F.count_if(F.col("k") == 0).alias("n0"), F.count_if(F.col("k") == 1).alias("n1"), F.max("mode").alias("m"))
    both = sizes.join(votes.where("k = 0").select(track, F.col("language").alias("l0")), track, "left").join(votes.where("k = 1").select(track, F.col("language").alias("l1")), track, "left")
    share = F.col("n1") / (F.col("n0") + F.col("n1"))
    inline = F.col("m") == "line_by_line"
    alike = F.col("l1").isNotNull() & L.same_alignment_script(F.col("l0"), F.col("l1"))
    small = (F.col("m") != "style_grouped") & F.when(inline, share < 0.05).otherwise((share < 0.05) | (F.col("n1") < 10) & (share < 0.33))
    verdicts = both.withColumn("back", F.coalesce((F.col("n1") > 0) & (alike | small), F.lit(False))).withColumn("drop", F.col("back") & inline & ~alike)
    final = sides.join(verdicts.select(track, "back", "drop", "l0", "l1"), track).where("k = 0 or not drop")
    k = F.when(F.col("back"), F.lit(0)).otherwise(F.col("k"))
    again = vote_language(final.where("back"), track).withColumnRenamed("language", "lb")
    return final.join(again, track, "left").select(
        track, F.when(k == 1, "secondary").otherwise("primary").alias("side"), position, "start", "duration", "text",
        F.when(F.col("back"), F.col("lb")).when(k == 1, F.col("l1")).otherwise(F.col("l0")).alias("language"),
    )


def write_back(cues: DataFrame, aligned: DataFrame, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """Aligned times, and words where there are any, back at their positions; others keep theirs.

    ``aligned``: track, position, ``start``, ``duration`` and, where there are any, ``words``.
    Where both sides of a cue come back, the secondary one (``side``) counts.
    """
    words = "words" in aligned.columns and "words" in cues.columns
    side = (F.col("side") == "secondary").cast("int") if "side" in aligned.columns else F.lit(0)
    last = F.max_by(F.struct("start", "duration", *(["words"] if words else [])), side)
    new = aligned.groupBy(track, position).agg(last.alias("__new"))
    changed = {"start": F.coalesce("__new.start", "start"), "duration": F.coalesce("__new.duration", "duration")}
    if words:
        changed["words"] = F.coalesce("__new.words", "words")
    return cues.join(new, [track, position], "left").withColumns(changed).drop("__new")


def merge_bilingual(cues: DataFrame, mode: str = "line_by_line", primary: str | None = None, secondary: str | None = None, track: str = "track_id", position: str = "cue_idx") -> DataFrame:
    """Cues with ``translation``, ``language`` and ``target_lang``; ``auto`` goes by each track's layout."""
    if mode not in (*MODES, "auto"):
        raise ValueError(f"unknown mode {mode!r}: one of {', '.join((*MODES, 'auto'))}")
    found = bilingual_mode(cues, track, position).select(track, F.col("mode").alias("__mode")) if mode == "auto" else None
    base = cues.join(found, track) if found is not None else cues.withColumn("__mode", F.lit(mode))
    paired = _pairs(base, track, position)
    pairwise = F.col("__mode").isin("same_timing_pairs", "style_grouped") & F.col("__whole")
    ahead = F.lead("text").over(Window.partitionBy(track, "__run", "__pair").orderBy(position))
    lines = F.split("text", "\n")
    broken = (F.col("__mode") == "line_by_line") & (F.size(lines) >= 2)
    own = _given(cues, "language")
    changed = paired.withColumn("__ahead", ahead).where(~(pairwise & (F.col("__nth") % 2 == 1)))
    return changed.withColumns(
        {
            "translation": F.when(broken, F.trim(F.get(lines, F.lit(1)))).when(pairwise, F.col("__ahead")),
            "text": F.when(broken, F.trim(F.get(lines, F.lit(0)))).otherwise(F.col("text")),
            "language": F.coalesce(F.lit(primary), own),
            "target_lang": F.when(broken | pairwise, F.lit(secondary).cast("string")),
        }
    ).drop("__mode", "__opens", "__run", "__nth", "__pair", "__whole", "__ahead")
