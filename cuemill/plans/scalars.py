"""One query per scalar function, over whole tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions import color, languages, text, timecode
from cuemill.session import table


def C() -> Column:
    return F.col("text")


def S() -> Column:
    return F.col("start")



def _over(columns: Callable[[], dict[str, Column]], where: str, source: str, keys: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = columns()
        return table(spark, sf_dir, source).where(where).select(*keys, *(c.alias(k) for k, c in made.items()))

    return query


def _sql(columns: dict[str, str], where: str, source: str, keys: tuple[str, ...]) -> str:
    return f"select {', '.join(keys)}, " + ", ".join(f"{v} as {k}" for k, v in columns.items()) + f" from {source} where {where}"


QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, spark_columns: Callable[[], dict[str, Column]], sql: dict[str, str], where: str = "true", source: str = "supervisions", keys: tuple[str, ...] = ("row_id",)) -> None:
    QUERIES[name] = _over(spark_columns, where, source, keys)
    ORACLES[name] = _sql(sql, where, source, keys)


_TIMED = "start is not null and start >= 0"


def _clock(total: str, per: int, form: str) -> str:
    """SQL of a clock over whole units."""
    t = f"cast({total} as bigint)"
    return f"printf('{form}', {t} // {3600 * per}, ({t} % {3600 * per}) // {60 * per}, ({t} % {60 * per}) // {per}, {t} % {per})"


_add("f50_srt_stamp", lambda: {"stamp": timecode.srt_stamp(S())}, {"stamp": _clock("floor(start * 1000)", 1000, "%02d:%02d:%02d,%03d")}, _TIMED)
_add("f51_vtt_stamp", lambda: {"stamp": timecode.vtt_stamp(S())}, {"stamp": _clock("round_even(start * 1000, 0)", 1000, "%02d:%02d:%02d.%03d")}, _TIMED)
_add("f52_sbv_stamp", lambda: {"stamp": timecode.sbv_stamp(S())}, {"stamp": _clock("floor(start * 1000)", 1000, "%d:%02d:%02d.%03d")}, _TIMED)
_add(
    "f53_lrc_stamp",
    lambda: {"fine": timecode.lrc_stamp(S(), 3), "coarse": timecode.lrc_stamp(S(), 2)},
    {
        "fine": "printf('%02d:%02d.%03d', cast(round_even(start*1000,0) as bigint) // 60000, (cast(round_even(start*1000,0) as bigint) % 60000) // 1000, cast(round_even(start*1000,0) as bigint) % 1000)",
        "coarse": "printf('%02d:%02d.%02d', cast(round_even(start*100,0) as bigint) // 6000, (cast(round_even(start*100,0) as bigint) % 6000) // 100, cast(round_even(start*100,0) as bigint) % 100)",
    },
    _TIMED,
)
_add("f54_ttml_stamp", lambda: {"stamp": timecode.ttml_stamp(S())}, {"stamp": _clock("round_even(start * 1000, 0)", 1000, "%02d:%02d:%02d.%03d")}, _TIMED)
_add("f55_markdown_stamp", lambda: {"stamp": timecode.markdown_stamp(S())}, {"stamp": "printf('[%02d:%02d:%02d]', cast(floor(start) as bigint) // 3600, (cast(floor(start) as bigint) % 3600) // 60, cast(floor(start) as bigint) % 60)"}, _TIMED)
_add(
    "f56_parse_timecode",
    lambda: {"back_ms": F.rint(timecode.parse_timecode(timecode.timecode(S(), 25)) * 1000).cast("long"), "back_frames": timecode.frames(timecode.parse_timecode(timecode.timecode(S(), 25)), 25.0)},
    {"back_ms": "cast(round_even(start * 25, 0) as bigint) * 40", "back_frames": "cast(round_even(start * 25, 0) as bigint)"},
    _TIMED,
)
_add(
    "f57_drop_frame",
    lambda: {"tc": timecode.drop_frame_timecode(S())},
    {"tc": "(select printf('%02d:%02d:%02d;%02d', n // 108000, (n % 108000) // 1800, (n % 1800) // 30, n % 30) from (select f + 18 * (f // 17982) + case when f % 17982 >= 2 then 2 * ((f % 17982 - 2) // 1798) else 0 end n from (select cast(round_even(start * 29.97, 0) as bigint) f)))"},
    _TIMED,
)
_add("f58_timecode_frames", lambda: {"tc": timecode.timecode(S(), 24), "frames": timecode.frames(S(), 29.97)}, {"tc": _clock("round_even(start * 24, 0)", 24, "%02d:%02d:%02d:%02d"), "frames": "cast(round_even(start * 29.97, 0) as bigint)"}, _TIMED)
_add("f59_rational_time", lambda: {"time": timecode.rational(S())}, {"time": "cast(round_even(start * 1000, 0) as bigint) || '/1000s'"}, _TIMED)
_add("f60_samples", lambda: {"samples": timecode.samples(S())}, {"samples": "cast(round_even(start * 48000, 0) as bigint)"}, _TIMED)
_add(
    "f61_grid_sum",
    lambda: {"total": F.rint(timecode.on_grid(S(), F.col("duration")) * 48000).cast("long")},
    {"total": "cast(round_even(start * 48000, 0) as bigint) + cast(round_even(duration * 48000, 0) as bigint)"},
    _TIMED + " and duration is not null",
)
_add("f_ass_stamp", lambda: {"stamp": timecode.ass_stamp(S())}, {"stamp": _clock("round_even(start * 100, 0)", 100, "%d:%02d:%02d.%02d")}, _TIMED)

_WS = r"[\s\x{00A0}\x{3000}\x{2000}-\x{200A}\x{202F}\x{0085}\x{1680}\x{2028}\x{2029}\x{205F}]+"
_NORMAL = "coalesce(text, '')"
for _a, _b in text.ENTITIES:
    _NORMAL = f"replace({_NORMAL}, '{_a.replace(chr(39), chr(39) * 2)}', '{_b.replace(chr(39), chr(39) * 2)}')"
_NORMAL = f"regexp_replace({_NORMAL}, '([a-zA-Z])’([tsdmTSDM]|ll|LL|re|RE|ve|VE)\\b', '\\1''\\2', 'g')"
_NORMAL = f"regexp_replace({_NORMAL}, '([0-9])’([sS])\\b', '\\1''\\2', 'g')"
_NORMAL = f"trim(regexp_replace({_NORMAL}, '{_WS}', ' ', 'g'))"
_SQUASH = f"trim(regexp_replace(text, '{_WS}', ' ', 'g'))"
_add("f01_normalize_text", lambda: {"normal": text.normalize_text(C())}, {"normal": _NORMAL})
_add("f02_squash", lambda: {"squashed": text.squash(C())}, {"squashed": _SQUASH})
_add("f03_strip_override_tags", lambda: {"plain": text.strip_override_tags(F.concat(F.lit("{\\an8\\pos(1,2)}"), C()))}, {"plain": f"trim(regexp_replace(regexp_replace('{{\\an8\\pos(1,2)}}' || text, '\\{{\\\\[^}}]*\\}}', '', 'g'), '{_WS}', ' ', 'g'))"})
_add("f08_with_translation", lambda: {"both": text.with_translation(C(), F.col("translation")), "turned": text.with_translation(C(), F.col("translation"), " / ", True)}, {"both": "concat_ws(chr(10), text, nullif(translation, ''))", "turned": "concat_ws(' / ', nullif(translation, ''), text)"}, source="markdown_segments", keys=("seg_id",))
_add("f09_ends_sentence", lambda: {"ends": text.ends_sentence(C()), "colon": text.ends_colon(C())}, {"ends": "regexp_matches(rtrim(text, ' '), '[.。!！?？…][\"”’»」』)]*$')", "colon": "regexp_matches(rtrim(text, ' '), '[:：]$')"})
_CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2A6DF}"
_RATIO = f"(case when length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}{_CJK}]', '', 'g')) > 0 then length(regexp_replace(text, '[^{_CJK}]', '', 'g')) / length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}{_CJK}]', '', 'g')) else 0.0 end)"
_add("f30_cjk_ratio", lambda: {"permille": F.floor(text.cjk_ratio(C()) * 1000 + 1e-9).cast("long")}, {"permille": f"cast(floor({_RATIO} * 1000 + 1e-9) as bigint)"})
_add(
    "f28_estimate_duration",
    lambda: {"ms": F.rint(text.estimate_duration(C()) * 1000).cast("long")},
    {"ms": f"cast(round_even(1000 * greatest(0.3, case when {_RATIO} > 0.3 then length(regexp_replace(text, '{_WS}', '', 'g')) / 4.0 else len(list_filter(string_split({_SQUASH}, ' '), lambda w: w <> '')) / 3.3 end), 0) as bigint)"},
)
_add("f36_effective_tokens", lambda: {"tokens": text.effective_tokens(C()).cast("long")}, {"tokens": "length(regexp_replace(text, '[^\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]', '', 'g')) + len(regexp_extract_all(text, '[A-Za-z0-9''’]+'))"})
# ranges of letters by script, in the order of preference
_RANGES = [
    ("latin", "A-Za-z\\x{C0}-\\x{24F}"), ("east_asian", "\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}"), ("cyrillic", "\\x{400}-\\x{4FF}"), ("greek", "\\x{370}-\\x{3FF}"), ("arabic", "\\x{600}-\\x{6FF}"), ("hebrew", "\\x{590}-\\x{5FF}"),
    ("armenian", "\\x{530}-\\x{58F}"), ("georgian", "\\x{10A0}-\\x{10FF}"), ("devanagari", "\\x{900}-\\x{97F}"), ("bengali", "\\x{980}-\\x{9FF}"), ("gurmukhi", "\\x{A00}-\\x{A7F}"), ("gujarati", "\\x{A80}-\\x{AFF}"), ("tamil", "\\x{B80}-\\x{BFF}"), ("thai", "\\x{E00}-\\x{E7F}"),
]
_COUNTS = ", ".join(f"{{'n': length(regexp_replace(text, '[^{r}]', '', 'g')), 'k': {-k}, 'name': '{name}'}}" for k, (name, r) in enumerate(_RANGES))
_add("a10_detect_script", lambda: {"script": languages.detect_script(C())}, {"script": f"(select case when b.n > 0 then b.name end from (select list_max([{_COUNTS}]) b))"})
_SP = [
    ("^((?:>>|&gt;&gt;|>|&gt;)[^:：]*?[:：])\\s*((?s:.*))$", None),
    ("^(\\[SPEAKER_[^\\]]*\\][:：])\\s*((?s:.*))$", None),
    ("^([A-Z]{1,15}(?:\\s+[A-Z]{1,15})?[:：])\\s*((?s:.*))$", None),
    ("^(>>|&gt;&gt;)\\s*((?s:.*))$", ">>"),
]
_SPEAKER = "case " + " ".join(f"when regexp_matches(text, '{p}') then " + (f"'{fixed}'" if fixed else f"regexp_extract(text, '{p}', 1)") for p, fixed in _SP) + " end"
_SPOKEN = "case " + " ".join(f"when regexp_matches(text, '{p}') then regexp_extract(text, '{p}', 2)" for p, _ in _SP) + " else text end"
_add("f20_parse_speaker", lambda: {"speaker": text.speaker_of(C())["speaker"], "said": text.speaker_of(C())["text"]}, {"speaker": _SPEAKER, "said": _SPOKEN})
_LINE = "'[' || cast(cue_idx as varchar) || '.5-' || cast(cue_idx + 2 as varchar) || '] ' || text"
_add(
    "f21_stamped_text",
    lambda: (lambda line: {"t0": text.stamped_text(line)["start"], "t1": text.stamped_text(line)["end"], "said": text.stamped_text(line)["text"]})(F.concat(F.lit("["), F.col("cue_idx").cast("string"), F.lit(".5-"), (F.col("cue_idx") + 2).cast("string"), F.lit("] "), C())),
    {"t0": "cue_idx + 0.5", "t1": "cast(cue_idx + 2 as double)", "said": "trim(text)"},
    "not contains(text, chr(10))",
)
_add(
    "f22_speaker_prefix",
    lambda: {"prefix": text.speaker_prefix(F.col("speaker"))},
    {"prefix": "case when coalesce(rtrim(speaker, ' '), '') = '' then '' when rtrim(speaker, ' ') = '>>' then '>> ' when regexp_matches(rtrim(speaker, ' '), '[:：]$') then rtrim(speaker, ' ') || ' ' else rtrim(speaker, ' ') || ': ' end"},
)
_add("f10_space_after_colon", lambda: {"blank": text.needs_space_after(C())}, {"blank": f"not regexp_matches(rtrim(text, ' '), '[{_CJK}\\x{{3040}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}][:：]$|：$')"})
_add("f12_head_speaker_change", lambda: {"body": F.when(F.startswith(C(), F.lit("- ")), F.substring(C(), 3, 1_000_000)).otherwise(C()), "changed": F.startswith(C(), F.lit("- "))}, {"body": "case when starts_with(text, '- ') then substring(text, 3) else text end", "changed": "starts_with(text, '- ')"})
_add("d08_filename_language", lambda: {"lang": text.language_of_filename(F.concat(F.element_at(F.split(F.coalesce("source_path", F.lit("x")), "/"), -1), F.when(F.col("track_id") % 2 == 0, ".CN&EN").otherwise(".eng")))["lang"]}, {"lang": "case when track_id % 2 = 0 then 'zh' else 'en' end"}, source="text_tracks", keys=("track_id", "ingested_at"))
_add("f70_hex_to_bgr", lambda: {"bgr": color.hex_to_bgr(F.format_string("#%06x", F.col("p_partkey"))), "back": color.bgr_to_hex(color.hex_to_bgr(F.format_string("#%06x", F.col("p_partkey"))))}, {"bgr": "(select substring(h, 5, 2) || substring(h, 3, 2) || substring(h, 1, 2) from (select printf('%06X', p_partkey) h))", "back": "printf('#%06X', p_partkey)"}, source="part", keys=("p_partkey",))
_add("f79_ass_to_css", lambda: {"css": color.ass_to_rgba(F.format_string("&H00%06X", F.col("p_partkey")))}, {"css": "printf('rgba(%d,%d,%d,1.00)', p_partkey % 256, (p_partkey // 256) % 256, p_partkey // 65536)"}, source="part", keys=("p_partkey",))
_add(
    "f06_wrap_text",
    lambda: {"lines": F.size(text.chunks(C(), 30)).cast("long"), "longest": F.array_max(F.transform(text.chunks(C(), 30), lambda x: F.length(x))).cast("long"), "first": F.get(text.chunks(C(), 30), F.lit(0))},
    {
        "lines": "len(w)",
        "longest": "list_max(list_transform(w, lambda x: length(x)))",
        "first": "w[1]",
    },
)
_FOLD = f"list_reduce(list_transform(list_filter(string_split({_SQUASH}, ' '), lambda w: w <> ''), lambda w: [w]), lambda a, b: case when length(a[-1]) + 1 + length(b[1]) <= 30 then list_concat(a[:-2], [a[-1] || ' ' || b[1]]) else list_concat(a, b) end)"
_PICK = "case when len(list_filter(string_split(" + _SQUASH + ", ' '), lambda w: w <> '')) > 0 then " + _FOLD + " else [] end"
ORACLES["f06_wrap_text"] = f"select row_id, len(w) as \"lines\", list_max(list_transform(w, lambda x: length(x))) as longest, w[1] as first from (select row_id, {_PICK} w from supervisions)"
