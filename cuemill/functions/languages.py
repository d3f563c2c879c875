"""Scripts and languages of texts as columns, without a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.functions.text import let

# Scripts in order of preference with the ranges of their letters.
SCRIPTS = (
    ("latin", "A-Za-z\\x{00C0}-\\x{024F}"),
    ("east_asian", "\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{AC00}-\\x{D7AF}"),
    ("cyrillic", "\\x{0400}-\\x{04FF}"),
    ("greek", "\\x{0370}-\\x{03FF}"),
    ("arabic", "\\x{0600}-\\x{06FF}"),
    ("hebrew", "\\x{0590}-\\x{05FF}"),
    ("armenian", "\\x{0530}-\\x{058F}"),
    ("georgian", "\\x{10A0}-\\x{10FF}"),
    ("devanagari", "\\x{0900}-\\x{097F}"),
    ("bengali", "\\x{0980}-\\x{09FF}"),
    ("gurmukhi", "\\x{0A00}-\\x{0A7F}"),
    ("gujarati", "\\x{0A80}-\\x{0AFF}"),
    ("oriya", "\\x{0B00}-\\x{0B7F}"),
    ("tamil", "\\x{0B80}-\\x{0BFF}"),
    ("telugu", "\\x{0C00}-\\x{0C7F}"),
    ("kannada", "\\x{0C80}-\\x{0CFF}"),
    ("malayalam", "\\x{0D00}-\\x{0D7F}"),
    ("sinhala", "\\x{0D80}-\\x{0DFF}"),
    ("thai", "\\x{0E00}-\\x{0E7F}"),
    ("lao", "\\x{0E80}-\\x{0EFF}"),
    ("tibetan", "\\x{0F00}-\\x{0FFF}"),
    ("myanmar", "\\x{1000}-\\x{109F}"),
    ("khmer", "\\x{1780}-\\x{17FF}"),
)
# Scripts that languages and scripts are compared by; all others are Latin.
BUCKETS = {
    "east_asian": ("zh", "ja", "ko", "east_asian"),
    "cyrillic": ("ru", "uk", "bg", "be", "mk", "sr", "kk", "mn", "cyrillic"),
    "arabic": ("ar", "fa", "ur", "arabic"),
    "hebrew": ("he", "hebrew"),
    "greek": ("el", "greek"),
    "devanagari": ("hi", "mr", "devanagari"),
    "thai": ("th", "thai"),
    "armenian": ("hy", "armenian"),
    "georgian": ("ka", "georgian"),
    "bengali": ("bn", "bengali"),
    "tamil": ("ta", "tamil"),
    "telugu": ("te", "telugu"),
    "gujarati": ("gu", "gujarati"),
    "gurmukhi": ("pa", "gurmukhi"),
}
SIBLINGS = ("zh", "ja", "ko")
# Frequent words by language of the Latin script; letters of one language only count double.
WORDS = {
    "en": "the and of to is was in that it for with on as at by this he she they not are have you we but his her from",
    "de": "der die das und ist nicht ich ein eine zu den von mit dem auf für im sich des es wir sie auch wurde hat aus bei",
    "fr": "le la les et est un une des du que qui dans pour pas je nous vous il elle sur avec au ce ne se plus",
    "es": "el los las y es en un una que del por con para no se lo su al como pero más muy yo fue ha le",
    "pt": "o os as e é um uma que do da em não para com por se no na ao mais como mas foi eu dos das",
    "it": "il lo gli i e è un una che di del della non per con si sono nel al più come ma anche io ha",
}
MARKS = {"en": "", "de": "äöüß", "fr": "èêçœùà", "es": "ñ¿¡", "pt": "ãõ", "it": "ìò"}
DEFAULT_CANDIDATES = ("en", "zh", "ja", "ko", "es", "fr", "de", "ru", "pt", "it")


def detect_script(text: Column) -> Column:
    """Script with most letters, ties to the one listed first; null without letters."""

    def counted(t: Column) -> Column:
        found = [F.struct(F.regexp_count(t, F.lit(f"[{r}]")).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, r) in enumerate(SCRIPTS)]
        return let(F.array_max(F.array(*found)), lambda best: F.when(best["n"] > 0, best["name"]))

    # most texts hold nothing beyond Latin and need no counting
    plain = F.when(text.rlike(f"[{SCRIPTS[0][1]}]"), F.lit("latin"))
    return F.when(~text.rlike("[\\x{0370}-\\x{17FF}\\x{3040}-\\x{D7AF}]"), plain).otherwise(counted(text))


def bucket(language: Column) -> Column:
    """Script a language label is compared by; unknown ones are Latin."""
    pairs = [F.lit(x) for name, members in BUCKETS.items() for m in members for x in (m, name)]
    return F.coalesce(F.create_map(*pairs)[language], F.lit("latin"))


def same_alignment_script(a: Column, b: Column) -> Column:
    """Whether two labels may be taken for each other: one script, but for different ones of zh, ja and ko."""
    siblings = a.isin(*SIBLINGS) & b.isin(*SIBLINGS) & (a != b)
    return F.coalesce((a != "") & (b != "") & ~siblings & (bucket(a) == bucket(b)), F.lit(False))


def detect_language(text: Column, candidates: Sequence[str] = DEFAULT_CANDIDATES) -> Column:
    """ISO code by script, kana, Hangul and frequent words among the candidates; null where nothing tells."""
    words = [x for x in WORDS if x in candidates]

    def latin(t: Column) -> Column:
        scored = [
            F.struct(
                (F.size(F.filter(F.split(t, "[^\\p{L}]+"), lambda w: w.isin(*WORDS[x].split()))) + (2 * F.regexp_count(t, F.lit(f"[{MARKS[x]}]")) if MARKS[x] else 0)).alias("n"),
                F.lit(-k).alias("k"), F.lit(x).alias("lang"),
            )
            for k, x in enumerate(words)
        ]
        return let(F.array_max(F.array(*scored)), lambda best: F.when(best["n"] > 0, best["lang"])) if scored else F.lit(None).cast("string")

    def known(code: str) -> Column:
        return F.lit(code if code in candidates else None).cast("string")

    script = detect_script(text)
    east = F.when(text.rlike("[\\x{3040}-\\x{30FF}]"), known("ja")).when(text.rlike("[\\x{AC00}-\\x{D7AF}]"), known("ko")).otherwise(known("zh"))
    single = {"cyrillic": "ru", "greek": "el", "arabic": "ar", "hebrew": "he", "devanagari": "hi", "thai": "th"}
    found = F.when(script == "latin", latin(F.lower(text))).when(script == "east_asian", east)
    for name, code in single.items():
        found = found.when(script == name, known(code))
    return found


def distinct_pair(a: Column, b: Column, candidates: Sequence[str] = DEFAULT_CANDIDATES) -> Column:
    """Whether two texts are in different languages: other scripts, or one script and other known languages."""
    sa, sb = detect_script(a), detect_script(b)
    la, lb = detect_language(a, candidates), detect_language(b, candidates)
    return F.coalesce(F.when(sa != sb, F.lit(True)).when(sa == sb, la != lb), F.lit(False))
