"""Colour notations of cue formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_to_bgr(rgb: Column) -> Column:
    """``#RRGGBB`` as ``BBGGRR``; null if it is none."""
    c = F.upper(rgb)
    return F.when(c.rlike("^#[0-9A-F]{6}$"), F.concat(F.substring(c, 6, 2), F.substring(c, 4, 2), F.substring(c, 2, 2)))


def bgr_to_hex(bgr: Column) -> Column:
    c = F.lpad(F.upper(F.regexp_replace(bgr, "^&[Hh]|&$", "")), 6, "0")
    return F.when(c.rlike("^[0-9A-F]{6}$|^[0-9A-F]{8}$"), F.concat(F.lit("#"), F.right(c, F.lit(2)), F.substring(F.right(c, F.lit(4)), 1, 2), F.substring(F.right(c, F.lit(6)), 1, 2)))


def ass_to_rgba(ass: Column) -> Column:
    """``&HAABBGGRR`` as CSS ``rgba``; alpha is inverted."""
    c = F.lpad(F.upper(F.regexp_replace(ass, "^&[Hh]|&$", "")), 8, "0")
    part = lambda k: F.conv(F.substring(c, k, 2), 16, 10).cast("int")
    return F.format_string("rgba(%d,%d,%d,%.2f)", part(7), part(5), part(3), F.round((255 - part(1)) / 255.0, 2))


# Colours given to speakers in order.
SPEAKER_COLORS = ("#658AE4", "#008C8C", "#F7C3D9", "#CC5D84", "#FBC03D", "#F4520D", "#9DC92A", "#A1FEEF", "#1387C0", "#FFC209")


def palette(spec: Column) -> Column:
    """``auto`` or a comma list of colours, with or without their sign; anything else in it fails when it is read."""
    given = F.filter(F.transform(F.split(spec, ","), lambda c: F.trim(c)), lambda c: c != "")
    signed = F.transform(given, lambda c: F.when(F.startswith(c, F.lit("#")), c).otherwise(F.concat(F.lit("#"), c)))
    checked = F.transform(signed, lambda c: F.when(c.rlike("^#[0-9A-Fa-f]{6}$"), c).otherwise(F.raise_error(F.concat(F.lit("no colour: "), c)).cast("string")))
    return F.when(spec == "auto", F.array(*map(F.lit, SPEAKER_COLORS))).otherwise(checked)


def speaker_color(place: Column, spec: Column) -> Column:
    """The colour of the speaker at a place of first appearance, going round the palette; null without one."""
    colors = palette(spec)
    return F.when(F.size(colors) > 0, F.try_element_at(colors, (place % F.size(colors) + 1).cast("int")))
