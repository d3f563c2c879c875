"""Text, speaker and script functions as Columns; all stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities decoded in this order, with the ellipsis.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("…", " "))
# Marks at which a sentence may end.
END_MARKS = ".。!！?？"
# Letters of scripts, as inner part of a character class.
CJK = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FFEF}\\x{20000}-\\x{2A6DF}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_text(text: Column, keep_newlines: bool = False) -> Column:
    """Entities decoded, straight apostrophes in contractions, blanks joined, ends trimmed; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, "([a-zA-Z])’([tsdmTSDM]|ll|LL|re|RE|ve|VE)\\b", "$1'$2")
    out = F.regexp_replace(out, "([0-9])’([sS])\\b", "$1'$2")
    if keep_newlines:
        out = F.regexp_replace(F.regexp_replace(out, "(?U)[\\s&&[^\\n]]+", " "), " *\\n *", "\n")
    else:
        out = F.regexp_replace(out, "(?U)\\s+", " ")
    return F.regexp_replace(out, "(?U)^\\s+|\\s+$", "")


def squash(text: Column) -> Column:
    """Newlines and blanks joined to one blank."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def strip_override_tags(text: Column) -> Column:
    return squash(F.regexp_replace(text, "\\{\\\\[^}]*\\}", ""))


def override_prefix(text: Column) -> Column:
    """Leading run of ``{...}``."""
    return F.regexp_extract(text, "^((?:\\{[^}]*\\})+)", 1)


def _fold_lines(text: Column, width: int) -> Column:
    empty = F.array().cast("array<string>")
    return F.aggregate(
        F.filter(F.split(squash(text), " "), lambda w: w != ""),
        empty,
        lambda acc, w: F.when((F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + 1 + F.length(w) <= width), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), w)))).otherwise(
            F.concat(acc, F.array(w))
        ),
    )


def chunks(text: Column, width: int) -> Column:
    """Greedy word chunks of at most ``width`` characters, longer words alone."""
    return _fold_lines(text, width)


def wrap(text: Column, width: int, max_lines: int | None = None) -> Column:
    """Greedy word wrap; lines beyond ``max_lines`` are dropped."""
    lines = _fold_lines(text, width)
    return F.array_join(F.slice(lines, 1, max_lines) if max_lines else lines, "\n")


def with_translation(text: Column, translation: Column, sep: str = "\n", translation_first: bool = False) -> Column:
    other = F.when(translation != "", translation)
    return F.concat_ws(sep, other, text) if translation_first else F.concat_ws(sep, text, other)


def ends_sentence(text: Column) -> Column:
    return F.rtrim(text).rlike(f"[{END_MARKS}…][\"”’»」』)]*$")


# Marks any of which closes a sentence, quotes and brackets included.
CLOSING_MARKS = ".!?\"']）。！？”】」』〗〙〛｡؟…"


def ends_with_mark(text: Column) -> Column:
    """Whether the last character is one that closes a sentence."""
    return F.right(text, F.lit(1)).isin(*CLOSING_MARKS)


def speaker_among(text: Column, candidates: Column) -> Column:
    """``(speaker, text)`` by ``speaker_of``, or by a name before a colon that is among the candidates (an array)."""
    p = "^([^:：]+)([:：])\\s*((?s).*)$"
    name = F.regexp_extract(text, p, 1)
    known = text.rlike(p) & F.coalesce(F.array_contains(candidates, F.trim(name)), F.lit(False))
    found = speaker_of(text)
    own = F.struct(F.concat(name, F.regexp_extract(text, p, 2)).alias("speaker"), F.regexp_extract(text, p, 3).alias("text"))
    return F.when(found["speaker"].isNotNull(), found).when(known, own).otherwise(found)


def ends_colon(text: Column) -> Column:
    return F.rtrim(text).rlike("[:：]$")


def needs_space_after(text: Column) -> Column:
    """No blank is put behind a colon that follows a CJK character."""
    return ~F.rtrim(text).rlike(f"[{CJK}\\x{{3040}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}][:：]$|：$")


def without_preamble(content: Column) -> Column:
    """Front matter and thinking blocks taken off."""
    out = F.regexp_replace(content, "(?s)<thinking>.*?</thinking>\\s*", "")
    return F.regexp_replace(out, "(?s)\\A---\\s*\\n.*?\\n---\\s*\\n", "")


def speaker_of(text: Column) -> Column:
    """``(speaker, text)`` of a labelled line; the colon stays with the speaker, null if there is no label."""
    any_ = "\\s*((?s).*)$"
    change = "^((?:>>|&gt;&gt;|>|&gt;)[^:：]*?[:：])" + any_
    machine = "^(\\[SPEAKER_[^\\]]*\\][:：])" + any_
    capitals = "^([A-Z]{1,15}(?:\\s+[A-Z]{1,15})?[:：])" + any_
    bare = "^(>>|&gt;&gt;)" + any_
    return (
        F.when(text.rlike(change), F.struct(F.regexp_extract(text, change, 1).alias("speaker"), F.regexp_extract(text, change, 2).alias("text")))
        .when(text.rlike(machine), F.struct(F.regexp_extract(text, machine, 1).alias("speaker"), F.regexp_extract(text, machine, 2).alias("text")))
        .when(text.rlike(capitals), F.struct(F.regexp_extract(text, capitals, 1).alias("speaker"), F.regexp_extract(text, capitals, 2).alias("text")))
        .when(text.rlike(bare), F.struct(F.lit(">>").alias("speaker"), F.regexp_extract(text, bare, 2).alias("text")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("speaker"), text.alias("text")))
    )


def stamped_text(line: Column) -> Column:
    """``(start, end, text)`` of ``[start-end] text``."""
    p = "^\\[([\\d.]+)-([\\d.]+)\\]\\s*((?s).*)$"
    return F.struct(
        F.regexp_extract(line, p, 1).try_cast("double").alias("start"),
        F.regexp_extract(line, p, 2).try_cast("double").alias("end"),
        F.when(line.rlike(p), F.trim(F.regexp_extract(line, p, 3))).otherwise(line).alias("text"),
    )


def speaker_prefix(speaker: Column) -> Column:
    """What stands before a text in segment formats; empty without a speaker."""
    s = F.rtrim(speaker)
    return F.when(F.coalesce(s, F.lit("")) == "", "").when(s == ">>", ">> ").when(s.rlike("[:：]$"), F.concat(s, F.lit(" "))).otherwise(F.concat(s, F.lit(": ")))


def voice_tag(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, "<v(?:\\.[^\\s>]*)?\\s+([^>]+)>", 1)), F.lit(""))


def cue_settings(line: Column) -> Column:
    """Settings behind a cue's stamps as a map."""
    p = F.lit("(\\w+):([^\\s:]+)")
    return F.map_from_arrays(F.regexp_extract_all(line, p, F.lit(1)), F.regexp_extract_all(line, p, F.lit(2)))


def estimate_duration(text: Column) -> Column:
    """Seconds a text takes to say: 4 characters a second if mostly CJK, else 3.3 words a second; at least 0.3."""
    spoken = F.when(cjk_ratio(text) > 0.3, F.length(F.regexp_replace(text, "(?U)\\s", "")) / 4.0).otherwise(F.size(F.filter(F.split(squash(text), " "), lambda w: w != "")) / 3.3)
    return F.greatest(F.lit(0.3), spoken)


def cjk_ratio(text: Column) -> Column:
    """Share of CJK characters in letters and digits."""
    cjk = F.regexp_count(text, F.lit(f"[{CJK}]"))
    letters = F.regexp_count(text, F.lit(f"[\\p{{L}}\\p{{N}}{CJK}]"))
    return F.when(letters > 0, cjk / letters).otherwise(0.0)


def effective_tokens(text: Column) -> Column:
    """Han characters plus runs of Latin letters and digits."""
    return F.regexp_count(text, F.lit("[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]")) + F.regexp_count(text, F.lit("[A-Za-z0-9'’]+"))


def language_of_filename(name: Column) -> Column:
    """``(lang, target)`` by naming customs of subtitle files, bilingual before monolingual."""
    dotted = F.concat(F.lit("."), name, F.lit("."))
    # Patterns in order with language and target language.
    rules = (
        ("简体中文&英文|简体&英文|CN&EN|chs&eng", "zh", "en"),
        ("繁体&英文|繁體&英文|cht&eng", "zh_tw", "en"),
        ("双语|bilingual", "zh", "en"),
        ("简体中文|简体|chs", "zh", None),
        ("CN", "zh", None),
        ("繁体|繁體|cht", "zh_tw", None),
        ("英文|eng", "en", None),
        ("EN", "en", None),
    )
    out = F.lit(None).cast("struct<lang:string,target:string>")
    for words, lang, target in reversed(rules):
        out = F.when(dotted.rlike(f"(?i)[.\\s](?:{words})[.\\s]"), F.struct(F.lit(lang).alias("lang"), F.lit(target).cast("string").alias("target"))).otherwise(out)
    return out
