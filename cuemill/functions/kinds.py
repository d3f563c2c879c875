"""What a line is for: dialogue, or credits, branding, signs and the like."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roles named at the head of credits, words of branding and disclaimers, words of recaps.
STAFF_ROLES = ("翻译", "校对", "时间轴", "后期", "总监", "压制", "监制", "特效", "听译", "编辑", "审核", "片源", "录制", "制作", "调轴", "打轴", "翻|校|监", "翻|校", "校|监")
BRANDING = ("yyets", "zimuzu", "人人影视", "字幕组", "字幕社", "www.", ".com", ".tv", ".net", ".org", "原创翻译", "双语字幕", "仅供交流", "禁止商用", "仅供学习", "请勿用于商业")
RECAPS = ("前情提要", "前情回顾", "上集回顾", "上期回顾", "本剧纯属虚构")
EARLY_SECONDS = 120
SHORT_CHARS = 50


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def signals(raw: Column) -> Column:
    """Override values that tell what a line is for."""
    number = lambda tag: F.regexp_extract(raw, f"\\\\{tag}(\\d+(?:\\.\\d+)?)", 1).try_cast("double")
    return F.struct(
        F.regexp_extract(raw, "\\\\an(\\d)", 1).try_cast("int").alias("an"), number("fs").alias("fs"), number("bord").alias("bord"),
        F.regexp_extract(raw, "\\\\b([01])(?![a-zA-Z\\d])", 1).try_cast("int").alias("bold"),
        F.coalesce(raw.rlike("\\\\pos\\("), F.lit(False)).alias("pos"), F.coalesce(raw.rlike("\\\\t\\([^)]*\\\\fs"), F.lit(False)).alias("animated_size"),
        F.coalesce(raw.rlike("\\\\k[fo]?\\d+"), F.lit(False)).alias("karaoke"),
    )


def line_type(text: Column, start: Column, raw: Column) -> Column:
    """Kind of a line that is no dialogue, null for dialogue.  Override tags tell first; short early lines are also judged by their words."""
    s, plain = signals(raw), F.trim(text)
    is_ = lambda condition: F.coalesce(condition, F.lit(False))
    roles = "|".join(r.replace("|", "\\|") for r in STAFF_ROLES)
    by_words = is_((start <= EARLY_SECONDS) & (F.length(text) <= SHORT_CHARS))
    kinds = (
        ("karaoke", s["karaoke"]),
        ("sign", is_(s["an"].isin(8, 9) & (s["bord"] == 1) & (s["bold"] == 1) & s["fs"].between(16, 22))),
        ("title", is_((s["an"] == 8) & (s["fs"] >= 28) & s["animated_size"])),
        ("banner", is_(s["an"] == 1) & _any_of(plain, RECAPS)),
        ("translator_note", is_(s["an"].isin(3, 9) & (s["fs"] > 0) & (s["fs"] <= 16) & (s["bold"] == 0) & s["pos"])),
        ("staff_credit", by_words & plain.rlike(f"^(?:{roles})\\s+\\S")),
        ("branding", by_words & _any_of(F.lower(plain), BRANDING)),
    )
    found = F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string"))
    for name, condition in kinds:
        found = found.when(condition, name)
    return found
