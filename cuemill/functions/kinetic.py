"""Kinetic typography: animations of whole lines or single words as override tags."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Motion:
    """Tags at the beginning, and tags reached between two milliseconds."""

    initial: str = ""
    steps: tuple[tuple[int, int, str], ...] = ()


# Name, natural scope, motion of a line, motion of a word.
CATALOGUE: dict[str, tuple[str, Motion | None, Motion | None]] = {
    "fade": ("line", Motion(r"\fad(300,0)"), Motion(r"\alpha&HFF&", ((0, 300, r"\alpha&H00&"),))),
    "zoom": ("line", Motion(r"\fscy80", ((0, 300, r"\fscy100"),)), Motion(r"\bord0\blur2", ((0, 300, r"\bord3\blur0"),))),
    "rise": ("line", Motion(r"\fscy0", ((0, 400, r"\fscy100"),)), None),
    "blur_in": ("line", Motion(r"\blur6", ((0, 300, r"\blur0"),)), Motion(r"\blur6", ((0, 300, r"\blur0"),))),
    "pop": ("line", Motion(r"\fscy60\alpha&HFF&", ((0, 250, r"\fscy100\alpha&H00&"),)), Motion(r"\alpha&HFF&\blur4\bord0", ((0, 1, r"\bord5\alpha&H00&\blur2"), (1, 250, r"\bord2\blur0")))),
    "reveal": ("word", Motion(r"\fad(180,0)"), Motion(r"\alpha&HFF&", ((0, 180, r"\alpha&H00&"),))),
    "bounce": ("word", Motion(r"\fscy130", ((0, 300, r"\fscy100"),)), Motion(r"\bord2\blur0", ((0, 1, r"\bord8\blur4"), (1, 200, r"\bord2\blur0")))),
    "shake": ("word", Motion("", ((0, 80, r"\frz3"), (80, 160, r"\frz-3"), (160, 240, r"\frz0"))), Motion(r"\frz0", ((0, 60, r"\frz3"), (60, 120, r"\frz-3"), (120, 180, r"\frz0")))),
    "pulse": ("word", Motion("", ((0, 400, r"\fscy108"), (400, 800, r"\fscy100"))), Motion(r"\bord2\blur0", ((0, 200, r"\bord4\blur2"), (200, 400, r"\bord2\blur0")))),
    "swing": ("word", Motion(r"\frz-6", ((0, 200, r"\frz6"), (200, 400, r"\frz0"))), Motion(r"\frz-8", ((0, 200, r"\frz8"), (200, 400, r"\frz0")))),
    "spotlight": ("word", None, Motion(r"\alpha&H50&\bord1\blur1", ((0, 80, r"\alpha&H00&\bord4\blur0"),))),
    "glow": ("word", Motion("", ((0, 150, r"\bord5\blur4"), (150, 400, r"\bord2\blur1"))), Motion(r"\bord2\blur0", ((0, 100, r"\bord5\blur4"), (100, 300, r"\bord2\blur1")))),
    "neon": ("word", Motion(r"\bord2\blur1", ((0, 200, r"\bord7\blur6"), (200, 500, r"\bord3\blur2"))), Motion(r"\bord2\blur1", ((0, 200, r"\bord7\blur6"), (200, 500, r"\bord3\blur2")))),
    "wave": ("word", Motion("", ((0, 300, r"\fscy112"), (300, 600, r"\fscy92"), (600, 900, r"\fscy100"))), Motion(r"\frz0", ((0, 200, r"\frz4"), (200, 400, r"\frz-4"), (400, 600, r"\frz0")))),
    "flicker": ("word", Motion("", ((0, 60, r"\alpha&HC0&"), (60, 120, r"\alpha&H00&"), (180, 240, r"\alpha&HC0&"), (240, 300, r"\alpha&H00&"))), Motion(r"\alpha&H00&", ((0, 50, r"\alpha&HC0&"), (50, 100, r"\alpha&H00&"), (150, 200, r"\alpha&HC0&"), (200, 250, r"\alpha&H00&")))),
    "typewriter": ("word", Motion(r"\fad(1,0)"), Motion(r"\alpha&HFF&", ((0, 1, r"\alpha&H00&"),))),
    "stagger": ("word", None, Motion()),
}
CHAR_DELAY, CHAR_WINDOW = 40, 120


def check(style: str | None) -> None:
    if style is not None and style not in CATALOGUE:
        raise ValueError(f"no kinetic style {style!r}: one of {', '.join(CATALOGUE)}")


def resolve(style: str | None, word_level: bool) -> tuple[str, Motion] | None:
    """(scope, motion): the natural scope where it can be had, else the other one; words need word level."""
    check(style)
    if style is None:
        return None
    natural, line, word = CATALOGUE[style]
    usable = {"line": line, "word": word if word_level else None}
    for scope in (natural, "line", "word"):
        if usable[scope] is not None:
            return scope, usable[scope]
    raise ValueError(f"kinetic style {style!r} needs word level")


def rebase(motion: Motion, scale_y: float = 100.0, angle: float = 0.0) -> Motion:
    """Heights scaled and angles shifted to a style's own."""

    def moved(tags: str) -> str:
        if scale_y != 100:
            tags = re.sub(r"(?<=\\fscy)-?\d+(?:\.\d+)?", lambda m: str(round(float(m[0]) * scale_y / 100)), tags)
        if angle:
            tags = re.sub(r"(?<=\\frz)-?\d+(?:\.\d+)?", lambda m: str(round(float(m[0]) + angle)), tags)
        return tags

    return Motion(moved(motion.initial), tuple((a, b, moved(tags)) for a, b, tags in motion.steps))


def override(motion: Motion, at_ms: Column | int = 0) -> Column:
    """The tags of a motion that begins at a millisecond of the event (0 for a line)."""
    at = at_ms if isinstance(at_ms, Column) else F.lit(at_ms)
    steps = [F.concat(F.lit("\\t("), (at + a).cast("string"), F.lit(","), (at + b).cast("string"), F.lit(f",{tags})")) for a, b, tags in motion.steps]
    return F.concat(F.lit(motion.initial), *steps)


def stagger(word: Column, at_ms: Column, delay: int = CHAR_DELAY, window: int = CHAR_WINDOW) -> Column:
    """Every character hidden until its turn, then faded in."""

    def shown(char: Column, i: Column) -> Column:
        begin = at_ms + i * delay
        return F.concat(F.lit("{\\alpha&HFF&\\t("), begin.cast("string"), F.lit(","), (begin + window).cast("string"), F.lit(",\\alpha&H00&)}"), char)

    return F.array_join(F.transform(F.filter(F.split(word, ""), lambda c: c != ""), shown), "")


def catalogue(spark: SparkSession) -> DataFrame:
    """The styles as a small table: natural scope, and which scopes there are."""
    return spark.createDataFrame([(k, n, line is not None, word is not None) for k, (n, line, word) in CATALOGUE.items()], "style string, natural_scope string, line boolean, word boolean")
