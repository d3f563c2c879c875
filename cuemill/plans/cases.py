"""Queries over small given cases, each held against the values its rule asks for, written out in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.config import StandardizationConfig
from cuemill.functions import breaks, color, kinds, kinetic, languages, text
from cuemill.operators import bilingual, cues, segments, sentences, standard
from cuemill.sources import document_formats, registry, styles, text_formats, transcripts, word_formats

QUERIES: dict = {}
ORACLES: dict = {}


def _sql(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float | int):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    kinds_ = {"long": "bigint", "int": "integer", "string": "varchar", "double": "double", "boolean": "boolean"}
    typed = ", ".join(f"cast({c.split()[0]} as {kinds_[c.split()[1]]}) {c.split()[0]}" for c in columns.split(", "))
    return f"select {typed} from (values {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({names})"


def scalar(name: str, schema: str, use: Callable[..., Column], cases: list[tuple], kind: str = "string") -> None:
    """A column function over given arguments; ``cases`` are (arguments..., wanted value)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([(k, *c[:-1]) for k, c in enumerate(cases)], f"nr long, {schema}")
        return df.select("nr", use(*map(F.col, names)).cast(kind).alias("value"))

    QUERIES[name] = query
    ORACLES[name] = values([(k, c[-1]) for k, c in enumerate(cases)], f"nr long, value {kind}")


def rows(name: str, columns: str, wanted: list[tuple]):
    """A query whose rows are given."""

    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = values(wanted, columns)
        return f

    return keep


_joined = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit("-"))), "|")

# ---- where texts may be cut

scalar("f05_split_point", "text string, most int", breaks.split_point_of, [
    ("The mayor came, and the baker left the hall early today.", 24, 16), ("The mayor came and left the hall", 10, 10), ("averyverylongwordwithoutanyblank", 10, 10), ("市长来了， 面包师走了", 8, 6),
], "int")
scalar("g05_text_chunks", "text string, most int", lambda t, n: _joined(breaks.chunks_of(t, n)), [
    ("The mayor came, and the baker left the hall early today. Nobody said a word.", 24, "The mayor came,|and the baker left the|hall early today.|Nobody said a word."), ("short", 24, "short"), ("abcdefghij", 4, "abcd|efgh|ij"), ("", 5, ""),
])
scalar("f04_smart_split", "text string, most int, lines int", breaks.smart_lines_of, [
    ("  kept as it is ", 24, 2, "kept as it is"), ("short one", 24, 2, "short one"), ("The mayor came, and the baker left the hall early today.", 24, 2, "The mayor came,\nand the baker left the hall early today."),
    ("two\nlines joined", 24, 2, "two lines joined"), (None, 24, 2, ""),
])
scalar("f37_boundary_score", "text string, at int", breaks.boundary_score_of, [
    ("don't stop", 3, 0), ("Yes. No", 4, 4), ("yes, no", 4, 3), ("yes no", 3, 2), ("我们走", 1, 1), ("abc", 0, 1), ("100ms", 3, 0), ("（好）吗", 3, 3),
], "int")
scalar("f38_safe_split", "text string, target int, low int", breaks.safe_split_of, [
    ("the permissions model. Next", 6, 1, 22), ("aaaaaaaa", 3, 1, 8), ("one two three", 5, 1, 4), ("short", 9, 1, 5), ("abcdefghijklmnopqrstuvwxyzabcdefgh ij", 3, 1, 34),
], "int")
scalar("f35_grapheme_boundary", "text string, at int", breaks.grapheme_boundary_of, [("éa", 1, 2), ("🇨🇳🇩🇪", 1, 2), ("👩‍🚀x", 1, 3), ("abc", 1, 1), ("abc", 9, 3)], "int")
scalar("f34_char_classes", "text string", lambda t: F.concat_ws(",", *(t.rlike(f"^[{r}]$").cast("string") for r in ("A-Za-z0-9'’", "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}", "\\p{M}"))), [
    ("a", "true,false,false"), ("’", "true,false,false"), ("市", "false,true,false"), ("́", "false,false,true"), ("é", "false,false,false"), ("𠀀", "false,true,false"),
])
scalar("f39_proportional_slices", "text string, a string, b string", lambda t, a, b: _joined(breaks.proportional_of(t, F.array(a, b))), [
    ("我们昨天去了市场，然后回家。", "We went to the market", "then we went home", "我们昨天去了市场，|然后回家。"), ("OK", "one two", "three", "OK|-"), ("The permissions", "a", "b", "The permissions|-"), (None, "a", "b", "-|-"),
])
scalar("f40_mirrored_slices", "s string, t string, a string, b string", lambda s, t, a, b: _joined(breaks.mirrored_of(s, t, F.array(a, b))), [
    ("Yes, we came. Then, at noon, we left.", "是的，我们来了。然后，中午，我们走了。", "Yes, we came. ", "Then, at noon, we left.", "是的，我们来了。|然后，中午，我们走了。"),
    ("Yes, we came. So.", "是的。我们来了，好。", "Yes, ", "we came. So.", None), ("He said “go,” and left.", "他说“走，”就离开了。", "He said “go,” ", "and left.", "他说“走，”|就离开了。"),
    ("A long first part of it, b.", "短，一个非常长的第二部分在这里。", "A long first part of it, ", "b.", None),
])
scalar("a16_length_balance", "a string, b string, c string, d string", lambda a, b, c, d: breaks.balanced_of(F.array(a, b), F.array(c, d)), [("aaaa", "bbbb", "cc", "dd", True), ("aaaa", "bbbb", "c", "dddddddd", False), ("aaaaaaaaaa", "b", "cccccccccc", "", True)], "boolean")


# ---- languages

scalar("f31_detect_language", "text string", languages.detect_language, [
    ("The mayor was in the hall and she left it", "en"), ("Der Bürgermeister ist nicht in die Halle gegangen", "de"), ("Le maire est dans la salle avec nous", "fr"), ("El alcalde no está en la sala con los otros", "es"),
    ("O prefeito não foi para a reunião com eles", "pt"), ("市长在河边", "zh"), ("市長は川のそばです", "ja"), ("시장님", "ko"), ("Мэр у реки", "ru"), ("12 ...", None), ("", None),
])
scalar("x04_language_candidates", "text string", lambda t: languages.detect_language(t, ("de", "fr")), [("Le maire est dans la salle", "fr"), ("The mayor and the clerk", None), ("市长在河边", None)])
scalar("f32_distinct_pair", "a string, b string", languages.distinct_pair, [("OK", "好", True), ("", "好", False), ("The mayor is in the hall", "Le maire est dans la salle", True), ("The mayor is in the hall", "and the clerk was there", False), ("12", "好", False), ("xyz qwrt", "the hall", False)], "boolean")
scalar("f33_same_script", "a string, b string", languages.same_alignment_script, [("en", "fr", True), ("zh", "ja", False), ("zh", "zh", True), ("zh", "east_asian", True), ("ru", "uk", True), ("ru", "en", False), (None, "en", False), ("xx", "de", True)], "boolean")
scalar("f24_line_kinds", "text string, start double, raw string", kinds.line_type, [
    ("la", 300.0, "{\\k20}la", "karaoke"), ("Town hall", 300.0, "{\\an8\\bord1\\b1\\fs20}Town hall", "sign"), ("The Show", 300.0, "{\\an8\\fs40\\t(0,300,\\fs50)}The Show", "title"), ("前情提要", 300.0, "{\\an1}前情提要", "banner"),
    ("note", 300.0, "{\\an9\\fs14\\b0\\pos(1,2)}note", "translator_note"), ("翻译 小王", 10.0, "", "staff_credit"), ("翻|校|监 小王", 10.0, "", "staff_credit"), ("yyets", 10.0, "", "branding"), ("ZIMUZU presents", 10.0, None, "branding"),
    ("www.example.invalid", 200.0, "", None), ("翻译 小王", 121.0, "", None), ("Hello there", 10.0, "", None), ("", 10.0, "{\\k20}", None),
])


# ---- styles and motions

scalar("r06_repair_script", "content string", styles.repair_script, [
    ("Dialogue: 0,0:00:-1.00,0:00:02.00,Default,,0,0,0,,Hi, you", "Dialogue: 0,0:00:00.00,0:00:02.00,Default,,0,0,0,,Hi, you"), ("Comment: 0,0:00:01.00,0:-1:02.00,D,,0,0,0,,x", "Comment: 0,0:00:01.00,0:00:00.00,D,,0,0,0,,x"),
    ("Style: D,Arial,20,&H00H202020,&H000000FF,&H00000000,&H00000000,0", "Style: D,Arial,20,&H00202020,&H000000FF,&H00000000,&H00000000,0"), ("Other: 0,0:00:-1.00", "Other: 0,0:00:-1.00"), ("a\nDialogue: 0,-0:00:01.00,0:00:02.00,D,,0,0,0,,x", "a\nDialogue: 0,-0:00:01.00,0:00:02.00,D,,0,0,0,,x"),
])
scalar("f62_repair_fields", "stamp string, color string", lambda s, c: F.concat_ws(" ", styles.repair_stamp(s), styles.repair_color(c)), [
    ("0:00:-1.00", "&H00H202020", "0:00:00.00 &H00202020"), ("0:00:01.00", "&H00FFFFFF", "0:00:01.00 &H00FFFFFF"), ("-0:00:01.00", "&hHff", "-0:00:01.00 &hHff"), ("0:-5:10.00", "&Hh00ff00", "0:00:00.00 &H00FF00"),
])
scalar("k08_event_text", "text string, raw string", styles.event_text, [
    ("Hello  there", "{\\an8}Hello there", "{\\an8}Hello there"), ("Ann: Hello", "{\\an8}Hello\\N", "{\\an8}Ann: Hello\\N"), ("one\ntwo", None, "one\\Ntwo"), ("one\ntwo", "one\\N{\\i1}two", "one\\N{\\i1}two"), ("new", "old", "new"),
])
scalar("k07_spliced_events", "new string, raw string", styles.splice_event, [
    ("0,0:00:05.00,0:00:06.00,Default,Ann,0,0,0,,Hi", "3,0:00:01.00,0:00:02.00,Top,Ann ,10,0,0,fx,Hi  ", "3,0:00:05.00,0:00:06.00,Top,Ann ,10,0,0,fx,Hi  "), ("0,0:00:05.00,0:00:06.00,Default,Bo,0,0,0,,Ho", "3,0:00:01.00,0:00:02.00,Top,Ann,10,0,0,fx,Hi", "3,0:00:05.00,0:00:06.00,Top,Bo,10,0,0,fx,Ho"),
    ("0,0:00:05.00,0:00:06.00,D,A,0,0,0,,a", "broken", "0,0:00:05.00,0:00:06.00,D,A,0,0,0,,a"),
])
scalar("f79_css_colors", "ass string", styles.css_color, [("&H00FFFFFF", "#FFFFFF"), ("&H000000FF", "#FF0000"), ("&H80FF0000", "rgba(0,0,255,0.5)"), ("&HFF", "#FF0000"), ("&H33112233", "rgba(51,34,17,0.8)")])
scalar("k05_css_block", "font string, bold boolean, primary string, outline string, border int, width double", lambda f, b, p, o, s, w: styles.css_block(F.struct(f.alias("fontname"), b.alias("bold"), F.lit(False).alias("italic"), p.alias("primarycolor"), o.alias("outlinecolor"), s.alias("borderstyle"), w.alias("outline"))), [
    ("Arial", True, "&H00FFFFFF", "&H00000000", 1, 2.0, "STYLE\n::cue {\n  font-family: Arial;\n  font-weight: bold;\n  color: #FFFFFF;\n  background-color: transparent;\n  text-shadow: -2px 0 #000000, 2px 0 #000000, 0 -2px #000000, 0 2px #000000;\n}"),
    ("Arial", False, "&H00FFFFFF", "&H00000000", 3, 2.0, "STYLE\n::cue {\n  font-family: Arial;\n  color: #FFFFFF;\n  background-color: #000000;\n  text-shadow: none;\n}"),
    (None, False, None, None, 1, 0.0, "STYLE\n::cue {\n  background-color: transparent;\n}"),
])


@rows("k09_style_lines", "name string, line string", [
    ("plain", "Style: plain,Arial,64,&H00FFFFFF,&H00FFFF00,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,0,1,2,20,20,20,1"), ("box", "Style: box,Arial,64,&H00FFFFFF,&H00FFFF00,&H33000000,&H00000000,0,0,0,0,100,100,0,0,3,4,0,2,20,20,20,1"),
    ("classic", "Style: classic,Arial,64,&H00FFFFFF,&H00FFFF00,&H33000000,&H00000000,0,0,0,0,100,100,0,0,3,16,0,2,20,20,80,1"), ("scheme", "Style: scheme,Arial,64,&H0015CCFA,&H00FFFFFF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,3,1,2,20,20,20,1"),
])
def k09_style_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    looks = {"plain": styles.ASSConfig(), "box": styles.ASSConfig(background_color="#000000CC"), "classic": styles.ASSConfig(style_preset="classic"), "scheme": styles.with_scheme(styles.ASSConfig(), " Yellow-Pop ")}
    return spark.createDataFrame([(k, styles.style_line(v, k)) for k, v in looks.items()], "name string, line string")


@rows("f73_style_presets", "preset string, font_size int, alignment int, margin_v int, karaoke_effect string, kinetic_style string", [
    ("classic", 64, 2, 80, None, None), ("tiktok", 80, 5, 0, "instant", "spotlight"), ("modern_box", 58, 2, 80, None, None), ("cinematic", 48, 2, 120, None, None), ("outline", 64, 2, 60, None, None), ("bold_center", 100, 5, 0, "instant", "reveal"),
])
def f73_style_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.presets(spark).select("preset", "font_size", "alignment", "margin_v", "karaoke_effect", "kinetic_style")


@rows("f72_color_schemes", "scheme string, primary_color string, outline_color string, outline_width double", [
    ("azure-gold", "#FFC209", "#1387C0", 0.0), ("sakura-purple", "#F7C3D9", "#063C85", 0.0), ("mint-ocean", "#A1FEEF", "#28314E", 0.0), ("gardenia-green", "#FFFFFF", "#77964A", 0.0), ("sunset-warm", "#FAEDD1", "#1387C0", 0.0), ("prussian-elegant", "#FFFFFF", "#003153", 0.0),
    ("burgundy-classic", "#F7F2DF", "#800020", 0.0), ("langgan-spring", "#C1D796", "#8A3A5A", 0.0), ("mars-teal", "#FFFFFF", "#003153", 0.0), ("spring-field", "#FBFFF2", "#008E6B", 0.0), ("navy-pink", "#FFFFFF", "#063C85", 0.0), ("apricot-dark", "#FEA72E", "#3A3C50", 0.0), ("yellow-pop", "#FACC15", "#000000", 3.0),
])
def f72_color_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.schemes(spark).select("scheme", "primary_color", "outline_color", "outline_width")


@rows("j09_lookups", "want string, outline_color string, natural_scope string", [("mint-ocean", "#28314E", None), ("stagger", None, "word"), ("fade", None, "line"), ("none such", None, None)])
def j09_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("mint-ocean",), ("stagger",), ("fade",), ("none such",)], "want string")
    colors = F.broadcast(styles.schemes(spark)).withColumnRenamed("scheme", "want")
    motions = F.broadcast(kinetic.catalogue(spark)).withColumnRenamed("style", "want")
    return wanted.join(colors, "want", "left").join(motions, "want", "left").select("want", "outline_color", "natural_scope")


@rows("f74_kinetic_catalogue", "style string, scope string, tags string", [
    ("fade", "line", "\\fad(300,0)"), ("zoom", "line", "\\fscy80\\t(0,300,\\fscy100)"), ("rise", "line", "\\fscy0\\t(0,400,\\fscy100)"), ("blur_in", "line", "\\blur6\\t(0,300,\\blur0)"), ("pop", "line", "\\fscy60\\alpha&HFF&\\t(0,250,\\fscy100\\alpha&H00&)"),
    ("reveal", "word", "\\alpha&HFF&\\t(0,180,\\alpha&H00&)"), ("bounce", "word", "\\bord2\\blur0\\t(0,1,\\bord8\\blur4)\\t(1,200,\\bord2\\blur0)"), ("shake", "word", "\\frz0\\t(0,60,\\frz3)\\t(60,120,\\frz-3)\\t(120,180,\\frz0)"),
    ("pulse", "word", "\\bord2\\blur0\\t(0,200,\\bord4\\blur2)\\t(200,400,\\bord2\\blur0)"), ("swing", "word", "\\frz-8\\t(0,200,\\frz8)\\t(200,400,\\frz0)"), ("spotlight", "word", "\\alpha&H50&\\bord1\\blur1\\t(0,80,\\alpha&H00&\\bord4\\blur0)"),
    ("glow", "word", "\\bord2\\blur0\\t(0,100,\\bord5\\blur4)\\t(100,300,\\bord2\\blur1)"), ("neon", "word", "\\bord2\\blur1\\t(0,200,\\bord7\\blur6)\\t(200,500,\\bord3\\blur2)"), ("wave", "word", "\\frz0\\t(0,200,\\frz4)\\t(200,400,\\frz-4)\\t(400,600,\\frz0)"),
    ("flicker", "word", "\\alpha&H00&\\t(0,50,\\alpha&HC0&)\\t(50,100,\\alpha&H00&)\\t(150,200,\\alpha&HC0&)\\t(200,250,\\alpha&H00&)"), ("typewriter", "word", "\\alpha&HFF&\\t(0,1,\\alpha&H00&)"), ("stagger", "word", ""),
])
def f74_kinetic_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in kinetic.CATALOGUE:
        scope, motion = kinetic.resolve(name, word_level=True)
        one = spark.range(1).select(F.lit(name).alias("style"), F.lit(scope).alias("scope"), kinetic.override(motion).alias("tags"))
        out = one if out is None else out.unionAll(one)
    return out


@rows("f75_rebased_motions", "style string, tags string", [("zoom", "\\fscy40\\t(0,300,\\fscy50)"), ("shake", "\\t(0,80,\\frz13)\\t(80,160,\\frz7)\\t(160,240,\\frz10)"), ("bounce", "\\fscy65\\t(0,300,\\fscy50)")])
def f75_rebased_motions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [(k, kinetic.rebase(kinetic.resolve(k, word_level=False)[1], 50.0, 10.0)) for k in ("zoom", "shake", "bounce")]
    one = [spark.range(1).select(F.lit(k).alias("style"), kinetic.override(m).alias("tags")) for k, m in made]
    return one[0].unionAll(one[1]).unionAll(one[2])


scalar("f76_word_overrides", "at int", lambda at: kinetic.override(kinetic.resolve("bounce", True)[1], at), [(0, "\\bord2\\blur0\\t(0,1,\\bord8\\blur4)\\t(1,200,\\bord2\\blur0)"), (450, "\\bord2\\blur0\\t(450,451,\\bord8\\blur4)\\t(451,650,\\bord2\\blur0)")])
scalar("f77_stagger", "word string, at int", kinetic.stagger, [("Hi", 450, "{\\alpha&HFF&\\t(450,570,\\alpha&H00&)}H{\\alpha&HFF&\\t(490,610,\\alpha&H00&)}i"), ("", 0, ""), ("市", 5, "{\\alpha&HFF&\\t(5,125,\\alpha&H00&)}市")])


# ---- documents

_HEADER = "WEBVTT\nKind: subtitles\nLanguage: en\n\nREGION\nid:fred\nwidth:40%\n\nSTYLE\n::cue {color: red}\n\nNOTE author: Ann\n\nNOTE\ntwo\nlines\n\n00:01.000 --> 00:02.000\nHi\n\nNOTE late: no\n"
scalar("r04_vtt_header", "content string", lambda c: F.to_json(text_formats.vtt_header(c)), [
    (_HEADER, '{"kind":"subtitles","language":"en","regions":[{"id":"fred","width":"40%"}],"styles":["::cue {color: red}"],"notes":["author: Ann","two\\nlines"],"pairs":{"author":"Ann"}}'), ("WEBVTT\n\n00:01.000 --> 00:02.000\nHi", '{"regions":[],"styles":[],"notes":[],"pairs":{}}'),
])
scalar("d02_detect_path", "path string, content string", registry.detect_path, [
    ("/a/B.SRT", None, "srt"), ("x.vtt", None, "vtt"), ("talk.md", "**Ann:** hi", "markdown"), ("talk.md", "plain", "md"), ("gemini_1.md", None, "markdown"), ("cut.xml", "<?xml?><xmeml version='4'>", "premiere_xml"), ("cut.xml", "<tt/>", "ttml"), ("x.ytt", None, "srv3"),
    ("x.smi", None, "sami"), ("x.txt", None, "aud"), ("x.unknown", None, None), ("WEBVTT\n\n00:01.000 --> 00:02.000\nHi", None, "vtt"), ("one\ntwo", None, None), ("x.edl/y.json3", None, "json3"),
])
scalar("d03_can_read", "source string, content string", lambda s, c: F.concat_ws(",", *(F.when(F.coalesce(registry.can_read(s, c, f), F.lit(False)), F.lit(f)) for f in ("vtt", "markdown", "premiere_xml", "json3", "srv3", "srt", "aud"))), [
    ("a.vtt", None, "vtt"), ('{"wireMagic": "pb3"}', None, "json3"), ('{"a": 1}', None, ""), ('<timedtext format="3"><body/></timedtext>', None, "srv3"), ("a.ytt", None, "srv3"), ("a.txt", None, "aud"), ("a.md", "see [00:10] now", "markdown"), ("<xmeml>\n", None, "premiere_xml"),
])

_TALK = """---
title: "A: talk"
duration: 12.5
target_lang: zh
description: |
  one
  two
---
<thinking>no
</thinking>
## [00:00:10] Opening
**Ann:** Hello there. [00:00:12]
> [zh] 你好
Going on here
[Applause] [Laughter] [00:00:15]
[Music] [00:16]
**Bo:** [00:20] Yes. [00:24.5]
Plain text [00:30 → 00:33]
More [[00:40](http://x.invalid?v=1&t=41)]
![cover](a.png)
#### 00:01:00 Part two
Cleo Dane: Well, so it goes.
and on.
## Last one [01:10]
"""
_docs = lambda spark: spark.createDataFrame([(1, _TALK), (2, None), (3, "")], "doc_id long, content string")


@rows("r22_markdown_segments", "doc_id long, segment_idx int, segment_type string, section string, speaker string, text string, translation string", [
    (1, 0, "section_header", "Opening", None, "Opening", None), (1, 1, "dialogue", "Opening", "Ann:", "Hello there.", "你好"), (1, 2, "dialogue", "Opening", None, "Going on here", None), (1, 3, "event", "Opening", None, "[Applause]", None), (1, 4, "event", "Opening", None, "[Laughter]", None),
    (1, 5, "event", "Opening", None, "[Music]", None), (1, 6, "dialogue", "Opening", "Bo:", "Yes.", None), (1, 7, "dialogue", "Opening", None, "Plain text", None), (1, 8, "dialogue", "Opening", None, "More", None), (1, 9, "section_header", "Part two", None, "Part two", None),
    (1, 10, "dialogue", "Part two", "Cleo Dane", "Well, so it goes. and on.", None), (1, 11, "section_header", "Last one", None, "Last one", None),
])
def r22_markdown_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.read_segments(_docs(spark)).select("doc_id", "segment_idx", "segment_type", "section", "speaker", "text", "translation")


@rows("r23_markdown_stamps", "segment_idx int, timestamp double, end_timestamp double", [
    (0, 10.0, None), (1, None, 12.0), (2, None, None), (3, 15.0, None), (4, 15.0, None), (5, 16.0, None), (6, 20.0, 24.5), (7, 30.0, 33.0), (8, None, 41.0), (9, 60.0, None), (10, 60.0, None), (11, 70.0, None),
])
def r23_markdown_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.read_segments(_docs(spark)).select("segment_idx", "timestamp", "end_timestamp")


@rows("r24_markdown_cues", "id string, start_ms long, duration_ms long, speaker string, text string, translation string, target_lang string", [
    ("segment_00000", 0, 12000, "Ann:", "Hello there.", "你好", "zh"), ("segment_00001", 15000, 100, None, "[Applause]", None, None), ("segment_00002", 15000, 1000, None, "[Laughter]", None, None), ("segment_00003", 16000, 4000, None, "[Music]", None, None),
    ("segment_00004", 20000, 4500, "Bo:", "Yes.", None, None), ("segment_00005", 30000, 3000, None, "Plain text", None, None), ("segment_00006", 33000, 8000, None, "More", None, None), ("segment_00007", 60000, 1818, "Cleo Dane", "Well, so it goes. and on.", None, None),
])
def r24_markdown_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = lambda c: F.rint(F.col(c) * 1000).cast("long").alias(f"{c}_ms")
    return transcripts.read_cues(_docs(spark)).select("id", ms("start"), ms("duration"), "speaker", "text", "translation", "target_lang")


@rows("w12_markdown_merged", "id string, start_ms long, end_ms long, speaker string, text string", [
    ("merged_00000", 0, 12000, "Ann:", "Hello there."), ("merged_00001", 15000, 20000, None, "[Applause] [Laughter] [Music]"), ("merged_00002", 20000, 24500, "Bo:", "Yes."), ("merged_00003", 30000, 41000, None, "Plain text More"), ("merged_00004", 60000, 61818, "Cleo Dane", "Well, so it goes. and on."),
])
def w12_markdown_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = lambda c: F.rint(c * 1000).cast("long")
    return transcripts.read_cues(_docs(spark), merge=True).select("id", ms(F.col("start")).alias("start_ms"), ms(F.col("start") + F.col("duration")).alias("end_ms"), "speaker", "text")


@rows("r25_front_matter", "field string, value string", [("title", "A: talk"), ("duration", "12.5"), ("target_lang", "zh"), ("description", "one\ntwo")])
def r25_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.read_front_matter(_docs(spark)).select("field", "value")


@rows("k24_transcript_written", "doc_id long, content string", [(1, '---\ntitle: "A: talk"\nlanguage: en\n---\n\n**Ann:** [00:00:01] Hello there. [00:00:03]\n> [zh] 你好\n\n[00:00:04] Again.\n\n**Bo:** [00:01:05] Yes.\n')])
def k24_transcript_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([(1, 0, 1.0, 2.5, "Ann", "Hello there.", "你好", "zh"), (1, 1, 4.0, 1.0, "Ann", "Again.", None, None), (1, 2, 65.2, 1.0, "Bo:", "Yes.", "", None)], "doc_id long, cue_idx int, start double, duration double, speaker string, text string, translation string, target_lang string")
    facts = spark.createDataFrame([(1, {"language": "en", "title": "A: talk", "unknown": "x"})], "doc_id long, facts map<string,string>")
    return transcripts.write_transcript(made, facts)


@rows("r16_csv_cells", "cue_idx int, start_ms long, speaker string, text string", [(0, 0, None, "hello,dear,old,friend"), (1, 2000, None, "two\nlines"), (2, 4000, None, 'say "hi"')])
def r16_csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([(1, 'start,end,text\n0,1000,hello,dear,old,friend\n2000,3000,"two\nlines"\nbad,row,x\n5000,4000,backwards\n4000,5000,"say ""hi"""\n')], "doc_id long, content string")
    return registry.read(docs, "csv").select("cue_idx", F.rint(F.col("start") * 1000).cast("long").alias("start_ms"), "speaker", "text")


@rows("r26_audition_markers", "doc_id long, cue_idx int, start_ms long, speaker string, text string", [(1, 0, 1000, "Ann", "Hello, all"), (1, 1, 3000, None, "Named"), (2, 0, 1000, None, "Tabs")])
def r26_audition_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "Name,Start,Duration,Time Format,Type,Description"
    docs = spark.createDataFrame([(1, f'{head}\nNamed,3.000,1.000,decimal,Cue,\nAnn - Marker 001,48000,48000,samples,Cue,"Hello, all"\nMarker 02,5.000,1.000,decimal,Cue,\n'), (2, head.replace(",", "\t") + "\nMarker 1\t1.000\t1.000\tdecimal\tCue\tTabs\n")], "doc_id long, content string")
    found = docs.select("doc_id", "content", registry.detect_format(F.col("content")).alias("fmt")).where("fmt = 'audition_csv'")
    return registry.read(found, "audition_csv").select("doc_id", "cue_idx", F.rint(F.col("start") * 1000).cast("long").alias("start_ms"), "speaker", "text")


# ---- sentences

_TRACK = [
    (1, 0, 0.0, 1.0, "Hello there. How", None), (1, 1, 1.0, 1.0, "are you?", None), (1, 2, 2.0, 1.0, "[Music] [Applause]", None), (1, 3, 3.0, 1.0, "Fine, and", "ANN:"), (1, 4, 4.0, 1.0, "you? [laughs]", None),
    (2, 0, 0.0, 1.0, "He said:", "BO:"), (2, 1, 1.0, 1.0, "come in. And", None), (2, 2, 2.0, 1.0, "so he came", None), (2, 3, 3.0, 1.0, "Next.", "ANN:"), (3, 0, 0.0, 1.0, "- Yes.", None), (3, 1, 1.0, 1.0, "trailing words", None), (3, 2, 2.0, 1.0, "[Music]", None), (3, 3, 3.0, 1.0, "more", None),
]


def _split(spark: SparkSession) -> DataFrame:
    return sentences.split_sentences(spark.createDataFrame(_TRACK, "track_id long, cue_idx int, start double, duration double, text string, speaker string"))


@rows("g06_sentences", "track_id long, first_position long, last_position long, text string, speaker string", [
    (1, 0, 0, "Hello there.", None), (1, 0, 1, "How are you?", None), (1, 2, 2, "[Music]", None), (1, 2, 2, "[Applause]", None), (1, 3, 4, "Fine, and you?", "ANN:"), (1, 4, 4, "[laughs]", None),
    (2, 0, 1, "He said: come in.", "BO:"), (2, 1, 2, "And so he came", None), (2, 3, 3, "Next.", "ANN:"), (3, 0, 0, "Yes.", None), (3, 1, 1, "trailing words", None), (3, 2, 2, "[Music]", None), (3, 3, 3, "more", None),
])
def g06_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark).select("track_id", "first_position", "last_position", "text", "speaker")


@rows("j07_sentence_times", "text string, start_ms long, end_ms long", [
    ("Hello there.", 0, 750), ("How are you?", 813, 2000), ("[Music]", 2000, 2389), ("[Applause]", 2444, 3000), ("Fine, and you?", 3000, 4308), ("[laughs]", 4385, 5000),
])
def j07_sentence_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = lambda c: F.round(c * 1000).cast("long")
    return _split(spark).where("track_id = 1").select("text", ms(F.col("start")).alias("start_ms"), ms(F.col("start") + F.col("duration")).alias("end_ms"))


def _python(name: str, columns: str, call: Callable, cases: list[tuple]) -> None:
    """A plain function of a state machine over given arguments, shown as text."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(k, call(*c[:-1])) for k, c in enumerate(cases)], "nr long, value string")

    QUERIES[name], ORACLES[name] = query, values([(k, c[-1]) for k, c in enumerate(cases)], "nr long, value string")


_cue = lambda text, speaker=None: sentences.Cue(0, 0.0, 1.0, text, speaker)
_python("g07_event_splits", "", lambda t: "|".join(sentences.split_inline_events(t)), [
    ("And breathe out. [Breathes out]", "And breathe out.|[Breathes out]"), ("It's nice for [laughter]", "It's nice for|[laughter]"), ("[Breathes in] And breathe in.", "[Breathes in]|And breathe in."), ("he said [INAUDIBLE] something", "he said [INAUDIBLE] something"), ("so [A] [B]", "so|[A]|[B]"), ("", ""),
])
_python("w15_segments", "", lambda *texts: " / ".join(f"{'E' if s.event else 'S'}:{s.speaker or ''}:{s.text if len(s.text) < 50 else len(s.text)}" for s in sentences.segmented([_cue(*t) for t in texts])), [
    (("one",), ("two", "ANN:"), ("three",), ("[Music]",), ("four",), "S::one / S:ANN::two three / E::[Music] / S::four"), (("a" * 1500,), ("b" * 600,), ("c",), "S::2101 / S::c"), (("[A] [B]", "BO:"), "E:BO::[A] / E:BO::[B]"), (("x", "A:"), ("y", "B:"), "S:A::x / S:B::y"),
])
_python("w16_carried", "", lambda segs, sents: " / ".join(f"{p or ''}:{t}" for t, p in sentences.carried([sentences.Segment(e, s, [t]) for e, s, t in segs], sents)), [
    ([(False, "A:", "He said:"), (False, None, "come in.")], [["He said:"], ["come in."]], "A::He said: come in."), ([(False, "A:", "open end"), (True, None, "[Music]"), (False, None, "on.")], [["open end"], [], ["on."]], "A::open end / A::[Music] / :on."),
    ([(False, "A:", "One. two"), (False, "B:", "Three.")], [["One.", "two"], ["Three."]], "A::One. / :two / B::Three."), ([(False, None, "[Door] >> so it is.")], [["[Door] >> so it is."]], ":[Door] / :>> so it is."),
])
_python("a11_merged_customs", "", lambda *c: repr(sorted((sentences.merge_customs(list(c)) or {}).items())), [
    ({"a": "1"}, None, {"b": "2"}, "[('a', '1'), ('b', '2')]"), ({"a": "1"}, {"a": "2"}, "[('_source_count', '2'), ('_split_from_multiple', 'true'), ('a', '1')]"), (None, {}, "[]"),
])
_python("f13_clean_custom", "", lambda c: repr(sorted((sentences.clean_custom(c) or {}).items())), [
    ({"ass_raw_text": "{\\an8}{\\b1}hi", "ass_raw_event_body": "x", "ass_raw_event_type": "Dialogue", "k": "v"}, "[('ass_raw_text', '{\\\\an8}{\\\\b1}'), ('k', 'v')]"), ({"ass_raw_text": "plain"}, "[]"), (None, "[]"),
])


@rows("x05_own_splitter", "text string", [("a b",), ("c d",), ("[Music]",), ("e",)])
def x05_own_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A splitter of the user's own, made once per task: every two words."""

    def make():
        return lambda texts: [[" ".join(t.split()[k : k + 2]) for k in range(0, len(t.split()), 2)] for t in texts]

    own = spark.createDataFrame([(1, 0, 0.0, 4.0, "a b c d", "A:"), (1, 1, 4.0, 1.0, "[Music]", None), (1, 2, 5.0, 1.0, "e", None)], "track_id long, cue_idx int, start double, duration double, text string, speaker string")
    split = sentences.split_sentences(own, make)
    return split.select(F.explode(F.split(F.regexp_replace("text", "(?<=b) ", "|"), "\\|")).alias("text"))


# ---- bilingual layouts

_LAYOUTS = (
    [(1, k, float(k), 1.0, t, None) for k, t in enumerate(["你好吗\nHow are you", "我很好\nI am fine in the hall", "再见吧\nGood bye and farewell", "只有中文"])]
    + [(2, k, float(k // 2), 1.0, t, None) for k, t in enumerate(["市长走了", "The mayor left and was gone", "面包师来了", "The baker came to the hall", "老师看了", "The teacher saw it all"])]
    + [(3, k, float(k % 3), 1.0, t, s) for k, (t, s) in enumerate([("The mayor left and was gone", "EN"), ("The baker came to the hall", "EN"), ("The teacher saw it all", "EN"), ("市长走了", "ZH"), ("面包师来了", "ZH"), ("老师看了", "ZH")])]
    + [(4, k, float(k), 1.0, t, None) for k, t in enumerate(["The mayor left", "The baker\ncame", "The teacher"])]
    + [(5, k, float(k // 2), 1.0, t, None) for k, t in enumerate(["市长走了", "The mayor left and was gone", "老师看了", "The clerk was there"])]
    + [(6, k, float(k), 1.0, t, None) for k, t in enumerate(["The mayor left", "and the baker came", "so it was"])]
)
_layouts = lambda spark: spark.createDataFrame(_LAYOUTS, "track_id long, cue_idx int, start double, duration double, text string, style string")


@rows("a05_bilingual_layouts", "track_id long, mode string", [(1, "line_by_line"), (2, "same_timing_pairs"), (3, "style_grouped"), (4, "none"), (5, "same_timing_pairs"), (6, "none")])
def a05_bilingual_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilingual.bilingual_mode(_layouts(spark)).select("track_id", "mode")


@rows("p11_simple_mono", "track_id long, simple boolean", [(1, False), (2, False), (3, False), (4, False), (5, False), (6, True)])
def p11_simple_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilingual.simple_mono(_layouts(spark)).select("track_id", "simple")


@rows("a06_language_votes", "track_id long, side string, language string", [(1, "primary", "zh"), (1, "secondary", "en"), (2, "primary", "zh"), (2, "secondary", "en"), (3, "primary", "zh"), (3, "secondary", "en"), (4, "primary", "en"), (5, "primary", "zh"), (5, "secondary", "en"), (6, "primary", "en")])
def a06_language_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilingual.alignment_sides(_layouts(spark)).select("track_id", "side", "language").distinct()


@rows("g08_alignment_sides", "track_id long, side string, cue_idx int, text string", [
    (1, "primary", 0, "你好吗"), (1, "primary", 1, "我很好"), (1, "primary", 2, "再见吧"), (1, "primary", 3, "只有中文"), (1, "secondary", 0, "How are you"), (1, "secondary", 1, "I am fine in the hall"), (1, "secondary", 2, "Good bye and farewell"),
    (3, "secondary", 0, "The mayor left and was gone"), (3, "secondary", 1, "The baker came to the hall"), (3, "secondary", 2, "The teacher saw it all"), (3, "primary", 3, "市长走了"), (3, "primary", 4, "面包师来了"), (3, "primary", 5, "老师看了"),
    (4, "primary", 0, "The mayor left"), (4, "primary", 1, "The baker came"), (4, "primary", 2, "The teacher"),
])
def g08_alignment_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilingual.alignment_sides(_layouts(spark).where("track_id in (1, 3, 4)")).select("track_id", "side", "cue_idx", "text")


_ROLLED = [(1, k, float(k // 2), 1.0, t) for k, t in enumerate(["OK", "市长在河边走了很久", "ABC", "老师看了那本书很久", "12", "34"])] + [(2, k, float(k), 1.0, "只有中文在这里") for k in range(20)] + [(2, k, float(k // 2), 1.0, t) for k, t in ((40, "中文"), (41, "English one"), (42, "中文"), (43, "English two"))]


@rows("a13_rolled_back", "track_id long, side string, n long", [(1, "primary", 4), (2, "primary", 28), (2, "secondary", 12)])
def a13_rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides in one script become one: pairs of Latin texts, and a real bilingual track that stays."""
    same = [(1, k, float(k // 2), 1.0, t) for k, t in enumerate(["市长在河边", "ABC def the", "老师看了书", "the and was"])]
    pairs = [(2, k, float(k // 2), 1.0, "只有中文在这里" if k % 2 == 0 else "The mayor was there") for k in range(24)] + [(2, k, float(k), 1.0, "只有中文在这里") for k in range(24, 40)]
    same = [(1, k, s, d, t if k % 2 else "ABC") for k, s, d, t in ((r[1], r[2], r[3], r[4]) for r in same)]
    made = spark.createDataFrame(same + pairs, "track_id long, cue_idx int, start double, duration double, text string")
    return bilingual.alignment_sides(made).groupBy("track_id", "side").agg(F.count("*").alias("n"))


@rows("u03_rollback_order", "nr long, cue_idx int, language string", [(1, 0, "zh"), (2, 1, "zh"), (3, 2, "zh"), (4, 3, "zh")])
def u03_rollback_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pairs in ten rows' reach and one script: the rows of both sides in source order."""
    made = spark.createDataFrame([(1, 0, 0.0, 1.0, "市长走了"), (1, 1, 0.0, 1.0, "12月3日4月5日67年"), (1, 2, 1.0, 1.0, "老师看了"), (1, 3, 1.0, 1.0, "89年12月3日67")], "track_id long, cue_idx int, start double, duration double, text string")
    sides = bilingual.alignment_sides(made).where("side = 'primary'")
    from pyspark.sql import Window

    return sides.select(F.row_number().over(Window.partitionBy("track_id").orderBy("cue_idx")).cast("long").alias("nr"), "cue_idx", "language")


ORACLES["s04_source_order"] = ORACLES["u03_rollback_order"]
QUERIES["s04_source_order"] = u03_rollback_order


@rows("c06_merged_bilingual", "track_id long, cue_idx int, text string, translation string, target_lang string", [
    (1, 0, "你好吗", "How are you", "en"), (1, 1, "我很好", "I am fine in the hall", "en"), (1, 2, "再见吧", "Good bye and farewell", "en"), (1, 3, "只有中文", None, None),
    (5, 0, "市长走了", "The mayor left and was gone", "en"), (5, 2, "老师看了", "The clerk was there", "en"), (6, 0, "The mayor left", None, None), (6, 1, "and the baker came", None, None), (6, 2, "so it was", None, None),
])
def c06_merged_bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilingual.merge_bilingual(_layouts(spark).where("track_id in (1, 5, 6)"), "auto", "zh", "en").select("track_id", "cue_idx", "text", "translation", "target_lang")


@rows("j02_written_back", "cue_idx int, start double, duration double, words int", [(0, 5.0, 1.5, 1), (1, 1.0, 1.0, 2), (2, 9.0, 1.0, 0)])
def j02_written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = "array<struct<symbol:string,start:double,duration:double>>"
    own = spark.createDataFrame([(1, 0, 0.0, 1.0, None), (1, 1, 1.0, 1.0, [("a", 1.0, 0.5), ("b", 1.5, 0.5)]), (1, 2, 2.0, 1.0, None)], f"track_id long, cue_idx int, start double, duration double, words {word}")
    new = spark.createDataFrame([(1, 0, "primary", 5.0, 1.5, [("x", 5.0, 1.5)]), (1, 2, "primary", 8.0, 1.0, None), (1, 2, "secondary", 9.0, 1.0, None), (1, 99, "primary", 1.0, 1.0, None)], f"track_id long, cue_idx int, side string, start double, duration double, words {word}")
    return bilingual.write_back(own, new).select("cue_idx", "start", "duration", F.coalesce(F.greatest(F.size("words"), F.lit(0)), F.lit(0)).alias("words"))


# ---- cues as a container

_WORD = "array<struct<symbol:string,start:double,duration:double>>"
_worded = lambda spark: spark.createDataFrame([(1, 0, 1.0, 2.0, "a b", "A", [("a", 1.0, 0.5), ("b", 2.0, 1.0)]), (1, 1, 4.0, 1.0, "c", None, None), (2, 0, 0.5, 1.0, "d", "B", [])], f"track_id long, cue_idx int, start double, duration double, text string, speaker string, words {_WORD}")
_shown = lambda df: df.select("track_id", "cue_idx", F.round("start", 6).alias("start"), F.round("duration", 6).alias("duration"), F.array_join(F.transform("words", lambda w: F.concat_ws(":", w["symbol"], F.round(w["start"], 4).cast("string"), F.round(w["duration"], 4).cast("string"))), " ").alias("words"))
_SHOWN = "track_id long, cue_idx int, start double, duration double, words string"


@rows("p02_shifted_words", _SHOWN, [(1, 0, 0.0, 1.5, "b:0.5:1.0"), (1, 1, 2.5, 1.0, None)])
def p02_shifted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(cues.shift_time(_worded(spark), -1.5))


@rows("p03_offset_words", _SHOWN, [(1, 0, -0.5, 2.0, "a:-0.5:0.5 b:0.5:1.0"), (1, 1, 2.5, 1.0, None), (2, 0, -1.0, 1.0, "")])
def p03_offset_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(cues.timecode_offset(_worded(spark), -1.5))


@rows("p04_with_offset", _SHOWN, [(1, 0, 1.25, 2.0, "a:1.25:0.5 b:2.25:1.0"), (1, 1, 4.25, 1.0, None), (2, 0, 0.75, 1.0, "")])
def p04_with_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(cues.words_with_offset(cues.with_offset(_worded(spark), 0.25), 0.25))


@rows("p05_trimmed_words", _SHOWN, [(1, 0, 1.25, 1.25, "a:1.25:0.25 b:2.0:0.5"), (1, 1, 4.0, -1.5, None), (2, 0, 1.25, 0.25, "")])
def p05_trimmed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(cues.trim(_worded(spark), 2.5, 1.25))


@rows("p09_word_levels", "fmt string, wanted boolean, track_id long, word_level boolean", [
    (f, w, t, {"srt": w is True, "json": w is not False, "sbv": False}[f] and t == 1) for f in ("srt", "json", "sbv") for w in (None, True, False) for t in (1, 2)
])
def p09_word_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for fmt in ("srt", "json", "sbv"):
        for wanted in (None, True, False):
            one = cues.word_levels(_worded(spark), wanted, fmt).select(F.lit(fmt).alias("fmt"), F.lit(wanted).cast("boolean").alias("wanted"), "track_id", "word_level")
            out = one if out is None else out.unionAll(one)
    return out


@rows("p18_from_rows", "cue_idx int, text string, language string, start double", [(0, "a", "en", 1.0), (1, "b", "de", 2.0), (2, None, "en", None)])
def p18_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.from_rows(spark, [{"text": "a", "start": 1.0, "unknown": 1}, {"text": "b", "start": 2.0, "language": "de"}, {}], language="en").select("cue_idx", "text", "language", "start")


@rows("p18_documents", "track_id long, cues long, kind string, first_text string", [(1, 2, "subtitles", "a b"), (2, 1, "subtitles", "d")])
def p18_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.document(_worded(spark), kind="subtitles").select("track_id", F.size("cues").cast("long").alias("cues"), "kind", F.get("cues", F.lit(0))["text"].alias("first_text"))


@rows("p19_with_alignment", "track_id long, cue_idx int, words string", [(1, 0, "a b"), (1, 1, "x"), (2, 0, "")])
def p19_with_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([(1, 1, [("x", 4.0, 1.0)])], f"track_id long, cue_idx int, words {_WORD}")
    done = cues.with_alignment(_worded(spark), new, ["track_id", "cue_idx"])
    return done.select("track_id", "cue_idx", F.array_join(F.transform("words", lambda w: w["symbol"]), " ").alias("words"))


@rows("p14_custom_fields", "nr long, got string, fields string", [(0, "1", "a=1,b=2,c=9"), (1, None, "c=9"), (2, None, "c=9")])
def p14_custom_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(0, {"a": "1", "b": "2", "z": "0"}), (1, {}), (2, None)], "nr long, custom map<string,string>")
    changed = cues.custom_drop(cues.custom_set(F.col("custom"), "c", F.lit("9")), "z")
    return df.select("nr", cues.custom_get(F.col("custom"), "a").alias("got"), F.array_join(F.transform(F.array_sort(F.map_keys(changed)), lambda k: F.concat_ws("=", k, changed[k])), ",").alias("fields"))


@rows("k32_dictionaries", "cue_idx int, json string, same boolean", [(0, '{"start":1.0,"duration":2.0,"text":"a b","speaker":"A","words":[{"symbol":"a","start":1.0,"duration":0.5},{"symbol":"b","start":2.0,"duration":1.0}]}', True), (1, '{"start":4.0,"duration":1.0,"text":"c"}', True)])
def k32_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _worded(spark).where("track_id = 1").withColumn("json", cues.to_dict(_worded(spark)))
    back = own.withColumn("back", cues.from_dict(F.col("json")))
    return back.select("cue_idx", "json", (F.col("back.start").eqNullSafe(F.col("start")) & F.col("back.text").eqNullSafe(F.col("text")) & F.col("back.speaker").eqNullSafe(F.col("speaker")) & (F.size("back.words").eqNullSafe(F.size("words")))).alias("same"))


@rows("x01_text_function", "cue_idx int, text string", [(0, "B A"), (1, "C"), (2, None)])
def x01_text_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(0, "a b"), (1, "c"), (2, None)], "cue_idx int, text string")
    return cues.transform_text(own, lambda t: " ".join(reversed(t.upper().split())))


@rows("x02_word_function", "track_id long, cue_idx int, words string, native string", [(1, 0, "aa bb", "A B"), (1, 1, None, None), (2, 0, "", "")])
def x02_word_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda df, name: df.select("track_id", "cue_idx", F.array_join(F.transform("words", lambda w: w["symbol"]), " ").alias(name))
    by_string, by_column = cues.transform_words(_worded(spark), lambda s: s * 2), cues.transform_words(_worded(spark), F.upper, native=True)
    return shown(by_string, "words").join(shown(by_column, "native"), ["track_id", "cue_idx"])


@rows("u02_first_wins", "nr long, fields string", [(0, "a=1,b=3"), (1, "b=3"), (2, "a=1")])
def u02_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(0, {"a": "1"}, {"a": "2", "b": "3"}), (1, {}, {"b": "3"}), (2, {"a": "1"}, {})], "nr long, x map<string,string>, y map<string,string>")
    both = styles.first_wins(F.col("x"), F.col("y"))
    return df.select("nr", F.array_join(F.transform(F.array_sort(F.map_keys(both)), lambda k: F.concat_ws("=", k, both[k])), ",").alias("fields"))


@rows("j03_raw_bodies", "doc_id long, cue_idx int, raw string", [(1, 0, "A"), (1, 1, "B"), (2, 0, None)])
def j03_raw_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, cue_idx int")
    raws = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (2, 0, "C"), (2, 1, "D")], "doc_id long, cue_idx int, body string")
    return styles.zip_raw(own, raws)


@rows("j10_missing_styles", "doc_id long, name string", [(1, "Top"), (2, "Default")])
def j10_missing_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(1, "Default"), (1, "Top"), (2, "Default")], "doc_id long, name string")
    return styles.missing_styles(own, spark.createDataFrame([(1, "Default"), (2, "Top")], "doc_id long, name string"))


@rows("k02_srt_with_mark", "doc_id long, content string", [(1, "﻿1\n00:00:01,000 --> 00:00:02,999\nA: hi\n\n2\n00:00:03,000 --> 00:00:04,000\nno label\n")])
def k02_srt_with_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(1, 0, 1.0, 1.9999, " hi ", "A", True), (1, 1, 3.0, 1.0, "no label", "B", False)], "doc_id long, cue_idx int, start double, duration double, text string, speaker string, original_speaker boolean")
    return text_formats.write_srt_content(own)


@rows("a07_candidates", "track_id long, name string, lines long", [(1, "Ann Dale", 3), (1, "Bo", 2), (2, "Ann", 2), (2, "Bo", 1), (3, "Ann", 2), (3, "Bo", 2)])
def a07_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By frequency and neighbourhood; by alternating labels with gaps; by labels on every line; notes that repeat are none."""
    lines = {
        1: ["Ann Dale: a", "Bo: b", "Ann Dale: c", "plain", "Ann Dale: d", "Bo: e", "Chapter One: f"],
        2: ["Ann: a", "plain", "Bo: b", "", "Ann: c"],
        3: ["Ann: a", "Bo: b", "Ann: c", "Bo: d"],
        4: ["Note: a", "Note: b", "Warning: c"],
    }
    df = spark.createDataFrame([(t, k, x) for t, own in lines.items() for k, x in enumerate(own)], "track_id long, cue_idx int, text string")
    return segments.speaker_candidates(df)


@rows("j08_labelled_cues", "cue_idx int", [(0,), (2,)])
def j08_labelled_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(1, 0, "Ann:"), (1, 1, "Note:"), (1, 2, "Bo"), (2, 3, "Ann")], "track_id long, cue_idx int, speaker string")
    known = spark.createDataFrame([(1, "Ann"), (1, "Bo"), (2, "Cleo")], "track_id long, speaker string")
    return segments.by_candidates(own, known, "track_id").select("cue_idx")


@rows("p01_one_speaker", "cue_idx int", [(0,)])
def p01_one_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.filter_by_speaker(_worded(spark).where("track_id = 1"), "A").select("cue_idx")


@rows("p08_translated", "track_id long, has_translation boolean", [(1, True), (2, False)])
def p08_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.has_translation(spark.createDataFrame([(1, ""), (1, "x"), (2, None), (2, "")], "track_id long, translation string"))


@rows("xp10_alignable_cases", "nr long, alignable boolean", [(0, True), (1, False), (2, False), (3, False), (4, False), (5, False)])
def xp10_alignable_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(0, "Hello", 1.0, 1.0, None, None), (1, "", 1.0, 1.0, None, None), (2, "Hello", 1.0, 0.01, None, None), (3, "m 0 0 l 1 1", 1.0, 1.0, None, "drawing"), (4, "翻译 小王", 1.0, 1.0, None, None), (5, "la", 1.0, 1.0, "{\\k20}la", None)]
    df = spark.createDataFrame(own, "nr long, text string, start double, duration double, raw string, kind string")
    return df.select("nr", bilingual.alignable(*map(F.col, ("text", "start", "duration", "raw", "kind"))).alias("alignable"))


@rows("p15_container", "track_id long, cue_idx int, text string", [(1, 0, "a b"), (1, 1, "c"), (1, 2, "d"), (2, 0, "d"), (2, 1, "e")])
def p15_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(1, 0, "d"), (2, 7, "e")], "track_id long, cue_idx int, text string")
    return cues.append(_worded(spark).select("track_id", "cue_idx", "text"), more)


# ---- words in documents

_WORDED_DOCS = {
    "json": '{"supervisions":[{"text":"a b","start":1.0,"end":3.0,"speaker":"A","words":[{"word":"a","start":1.0,"end":1.5,"score":0.5},{"word":"b","start":2.0,"duration":1.0}]},{"text":"c","start":4.0,"duration":1.0,"end":9.0}]}',
    "json3": '{"wireMagic":"pb3","events":[{"tStartMs":0,"dDurationMs":9,"id":1},{"tStartMs":1000,"dDurationMs":2000,"segs":[{"utf8":">> a"},{"utf8":" b","tOffsetMs":1000,"acAsrConf":255}]},{"tStartMs":3000,"aAppend":1,"segs":[{"utf8":"\\n"}]},{"tStartMs":4000,"dDurationMs":1000,"segs":[{"utf8":"c"}]}]}',
    "srv3": '<timedtext format="3"><body><p t="1000" d="2000"><s>a</s><s t="1000"> b</s></p><p t="2000" d="10" a="1"><s>x</s></p><p t="4000" d="1000"><s>c</s></p></body></timedtext>',
    "ttml": '<tt xmlns="http://www.w3.org/ns/ttml"><body><div><p begin="1s"><span begin="1s" end="1.5s">a</span> <span begin="2s" dur="1s">b</span></p><p begin="00:00:04.000" end="5s">c</p></div></body></tt>',
    "lrc": "[ti:x]\n[00:01.00]<00:01.00>a <00:02.00>b\n[00:04.00]c\n",
    "ass": "[Events]\nDialogue: 0,0:00:01.00,0:00:03.00,Default,A,0,0,0,,{\\k100}a {\\kf100}b\nDialogue: 0,0:00:04.00,0:00:05.00,Default,,0,0,0,,c\n",
}
_A = [("json", 0, "A", "a:1.0:0.5:0.5 b:2.0:1.0"), ("json3", 0, ">>", "a:1.0:1.0 b:2.0:1.0:1.0"), ("srv3", 0, None, "a:1.0:1.0 b:2.0:1.0"), ("ttml", 0, None, "a:1.0:0.5 b:2.0:1.0"), ("lrc", 0, None, "a:1.0:0.0 b:2.0:0.0"), ("ass", 0, "A", "a:1.0:1.0 b:2.0:1.0")]


@rows("r_words_in_documents", "fmt string, cue_idx int, start double, duration double, speaker string, text string, words string", [
    r for f, k, s, w in _A for r in ((f, 0, 1.0, 3.0 if f == "lrc" else 2.0, s, "a b", w), (f, 1, 4.0, 5.0 if f == "lrc" else 1.0, None, "c", None))
])
def r_words_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for fmt, content in _WORDED_DOCS.items():
        read = word_formats.read_words(spark.createDataFrame([(1, content), (2, None)], "doc_id long, content string"), fmt)
        shown = F.array_join(F.transform("words", lambda w: F.concat_ws(":", w["symbol"], w["start"].cast("string"), w["duration"].cast("string"), w["score"].cast("string"))), " ")
        one = read.select(F.lit(fmt).alias("fmt"), "cue_idx", "start", "duration", "speaker", "text", shown.alias("words"))
        out = one if out is None else out.unionAll(one)
    return out


@rows("k_words_in_documents", "fmt string, content string", [
    ("json", '{"version":2,"duration":5.0,"num_segments":2,"speakers":["A"],"supervisions":[{"start":1.0,"end":3.0,"duration":2.0,"text":"a b","speaker":"A","words":[{"word":"a","start":1.0,"end":1.5},{"word":"b","start":2.0,"end":3.0}]},{"start":4.0,"end":5.0,"duration":1.0,"text":"c"}]}'),
    ("json3", '{"wireMagic":"pb3","events":[{"tStartMs":0,"dDurationMs":5000,"id":1},{"tStartMs":1000,"dDurationMs":2000,"segs":[{"utf8":"a"},{"utf8":" b","tOffsetMs":1000}]},{"tStartMs":3000,"aAppend":1,"segs":[{"utf8":"\\n"}]},{"tStartMs":4000,"dDurationMs":1000,"segs":[{"utf8":"c"}]},{"tStartMs":5000,"aAppend":1,"segs":[{"utf8":"\\n"}]}]}'),
    ("srv3", '<?xml version="1.0" encoding="utf-8" ?><timedtext format="3">\n<body>\n<p t="1000" d="2000"><s>a</s><s t="1000"> b</s></p>\n<p t="4000" d="1000"><s>c</s></p>\n</body>\n</timedtext>\n'),
    ("ttml", '<?xml version="1.0" encoding="UTF-8"?>\n<tt xmlns="http://www.w3.org/ns/ttml" xmlns:tts="http://www.w3.org/ns/ttml#styling" xml:lang="en"><body><div>\n<p begin="00:00:01.000" end="00:00:03.000"><span tts:fontWeight="bold">A:</span> <span begin="00:00:01.000" end="00:00:01.500">a</span> <span begin="00:00:02.000" end="00:00:03.000">b</span></p>\n<p begin="00:00:04.000" end="00:00:05.000">c</p>\n</div></body></tt>\n'),
])
def k_words_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _worded(spark).where("track_id = 1").withColumnRenamed("track_id", "doc_id")
    out = None
    for fmt in ("json", "json3", "srv3", "ttml"):
        one = word_formats.write_words(own, fmt).select(F.lit(fmt).alias("fmt"), "content")
        out = one if out is None else out.unionAll(one)
    return out


@rows("k34_render_options", "wanted boolean, words boolean", [(None, True), (True, True), (False, False)])
def k34_render_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word option of a JSON document: by custom, forced, and off."""
    own = _worded(spark).where("track_id = 1").withColumnRenamed("track_id", "doc_id")
    out = None
    for wanted in (None, True, False):
        one = word_formats.write_words(own, "json", wanted).select(F.lit(wanted).cast("boolean").alias("wanted"), F.contains("content", F.lit('"words"')).alias("words"))
        out = one if out is None else out.unionAll(one)
    return out


# ---- long cues

_say = lambda *times: [(w, s, d) for w, s, d in times]
_WORDS = _say(("alpha", 0.0, 0.5), ("bravo", 0.5, 0.5), ("charlie", 1.6, 0.5), ("delta", 2.1, 0.5), ("echo", 2.6, 0.4))
_python("w18_pause_split", "", lambda w, most: str(standard.pause_split(w, most)), [(_WORDS, 14, "2"), (_WORDS, 40, "None"), (_WORDS[:2], 10, "None"), (_say(("aaaa", 0.0, 1.0), ("bbbb", 1.1, 1.0), ("cccc", 2.2, 1.0)), 8, "None")])
_groups = lambda gs: "|".join(" ".join(w[0] for w in g) for g in gs)
_python("w17_word_groups", "", lambda w, most, s: _groups(standard.word_groups(w, most, s)), [(_WORDS, 20, 9.0, "alpha bravo charlie|delta echo"), (_WORDS, 100, 1.2, "alpha bravo|charlie delta|echo"), (_WORDS, 14, 9.0, "alpha bravo|charlie delta|echo"), (_WORDS, 3, 9.0, "alpha|bravo|charlie|delta|echo")])
_python("w20_orphan_merge", "", lambda w, most, s: _groups(standard.merge_orphan([w[:4], w[4:]], most, s)), [(_WORDS, 20, 9.0, "alpha bravo charlie delta echo"), (_WORDS, 20, 2.0, "alpha bravo charlie delta|echo"), (_WORDS, 8, 9.0, "alpha bravo charlie delta|echo")])
_CJK = _say(*((c, float(k), 1.0) for k, c in enumerate("我们用组件好")))
_python("w19_word_snap", "", lambda seg: _groups(standard.snap("我们用组件好", [_CJK[:4], _CJK[4:]], 4, seg)), [(None, "我 们 用 组|件 好"), (lambda t: ["我们", "用", "组件", "好"], "我 们 用|组 件 好"), (lambda t: ["我们用组件", "好"], "我 们 用 组|件 好")])
_SHORT = StandardizationConfig(max_chars_per_line=10, max_lines=1, max_duration=7.0, min_duration=0.5, min_gap=0.1)
_pieces = lambda got: " / ".join(f"{s:.2f}+{d:.2f} {t!r} {o!r}" for s, d, t, o, _ in got)
_python("g03_split_cues", "", lambda s, d, t, o, w: _pieces(standard.split_cue(s, d, t, o, w, _SHORT)), [
    (0.0, 2.0, "short one", "x", None, "0.00+2.00 'short one' 'x'"),
    (0.0, 3.0, "alpha bravo charlie delta echo", None, _WORDS, "0.00+0.50 'alpha ' None / 0.60+0.50 'bravo ' None / 1.60+0.50 'charlie ' None / 2.20+0.80 'delta echo' None"),
    (1.0, 4.0, "one two, three four", "eins zwei, drei vier", None, "1.00+1.73 'one two,' 'eins zwei, ' / 2.83+2.17 'three four' 'drei vier'"),
])
_python("g04_shares", "", lambda s, d, t: _pieces(standard.split_by_shares(s, d, t, None, _SHORT)), [(0.0, 10.0, "abcdefgh", "0.00+4.95 'abcd' None / 5.05+4.95 'efgh' None"), (0.0, 1.0, "", "0.00+1.00 '' None"), (0.0, 1.0, "one two", "0.00+1.00 'one two' None")])


@rows("c01_split_long", "cue_idx int, part int, start_ms long, text string", [(0, 0, 0, "alpha "), (0, 1, 600, "bravo "), (0, 2, 1600, "charlie "), (0, 3, 2200, "delta echo"), (1, 0, 4000, "")])
def c01_split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(0, 0.0, 3.0, "alpha bravo charlie delta echo", _WORDS), (1, 4.0, 1.0, None, None), (2, None, 1.0, "x", None)], f"cue_idx int, start double, duration double, text string, words {_WORD}")
    return standard.split_long(own, _SHORT).select("cue_idx", "part", F.rint(F.col("start") * 1000).cast("long").alias("start_ms"), "text")


scalar("f71_palette", "place long, spec string", color.speaker_color, [(0, "auto", "#658AE4"), (11, "auto", "#008C8C"), (1, "#ff0000, 00FF00", "#00FF00"), (2, "#ff0000,00FF00", "#ff0000"), (0, "", None)])


@rows("k03_vtt_head", "content string, again string", [
    ("WEBVTT\nKind: subtitles\nLanguage: en\n\nREGION\nid:fred\nwidth:40%\n\nSTYLE\n::cue {color: red}\n\nNOTE author: Ann\n\nNOTE\ntwo\nlines\n\n",
     '{"kind":"subtitles","language":"en","regions":[{"id":"fred","width":"40%"}],"styles":["::cue {color: red}"],"notes":["author: Ann","two\\nlines"],"pairs":{"author":"Ann"}}'),
])
def k03_vtt_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header read, written and read again."""
    df = spark.createDataFrame([(_HEADER,)], "c string").select(text_formats.vtt_head(text_formats.vtt_header(F.col("c"))).alias("content"))
    return df.select("content", F.to_json(text_formats.vtt_header(F.col("content"))).alias("again"))


@rows("f23_cue_settings", "cue_idx int, cue_id string, settings string", [(0, "intro", "align:start,line:0"), (1, None, ""), (2, "7", "position:10%")])
def f23_cue_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = "WEBVTT\n\nintro\n00:01.000 --> 00:02.000 align:start line:0\nHi\n\n00:03.000 --> 00:04.000\nplain\n\n7\n00:05.000 --> 00:06.000 position:10%\nx\n"
    found = text_formats.read_vtt_settings(spark.createDataFrame([(1, content), (2, None)], "doc_id long, content string"))
    return found.select("cue_idx", "cue_id", F.array_join(F.transform(F.array_sort(F.map_keys("settings")), lambda k: F.concat_ws(":", k, F.col("settings")[k])), ",").alias("settings"))


@rows("f11_without_preamble", "nr long, value string", [(0, "text"), (1, "text --- more")])
def f11_without_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(0, "---\na: b\n---\n<thinking>x\ny</thinking>\ntext"), (1, "text --- more")], "nr long, c string")
    return df.select("nr", F.trim(text.without_preamble(F.col("c"))).alias("value"))


scalar("f27_tag_prefix", "raw string", styles.tag_prefix, [("{\\an8}{\\fad(0,500)}Hi {\\i1}there", "{\\an8}{\\fad(0,500)}"), ("Hi", ""), ("{\\an8}", "{\\an8}")])
scalar("f25_ass_signals", "raw string", lambda r: F.to_json(kinds.signals(r)), [
    ("{\\an8\\fs20\\bord1\\b1\\pos(1,2)}x", '{"an":8,"fs":20.0,"bord":1.0,"bold":1,"pos":true,"animated_size":false,"karaoke":false}'), ("plain", '{"pos":false,"animated_size":false,"karaoke":false}'), ("{\\t(0,1,\\fs9)\\kf20}", '{"fs":9.0,"pos":false,"animated_size":true,"karaoke":true}'),
])
scalar("d05_line_ends", "content string", lambda c: F.when(registry.line_terminator(c) == "\r\n", "crlf").otherwise("lf"), [("a\r\nb\r\nc\n", "crlf"), ("a\nb\r\n", "lf"), ("a", "lf")])


@rows("r12_ttml_times", "nr long, ms long", [(0, 3723500), (1, 1500), (2, 250), (3, 2000), (4, 0), (5, 12500), (6, 1033)])
def r12_ttml_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock, offsets and frames at 30, as begin of a paragraph."""
    times = ("01:02:03.500", "1.5s", "250ms", "60f", "bad", "12.5", "00:00:01:01")
    docs = spark.createDataFrame([(k, f'<tt><body><p begin="{t}" dur="1s">x</p></body></tt>') for k, t in enumerate(times)], "doc_id long, content string")
    return registry.read(docs, "ttml").select(F.col("doc_id").alias("nr"), F.rint(F.col("start") * 1000).cast("long").alias("ms"))


@rows("w10_echo_cues", "cue_idx int, text string, words long", [(0, "one two", 2), (1, "three", 1)])
def w10_echo_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of 10 ms that only show the line again are dropped."""
    content = "WEBVTT\n\n00:00:00.000 --> 00:00:02.000\n \none<00:00:01.000><c> two</c>\n\n00:00:02.000 --> 00:00:02.010\none two\n \n\n00:00:02.010 --> 00:00:04.000\none two\n<00:00:02.010>three<00:00:03.000>\n"
    words = document_formats.rolling_words(content)
    return spark.createDataFrame([(k, said, len(w)) for k, (_, _, _, said, w) in enumerate(words)], "cue_idx int, text string, words long")


_python("k31_output_formats", "", lambda fmt, path, source: registry.output_format(fmt, path, source), [
    (None, None, None, "srt"), ("VTT", "a.srt", None, "vtt"), (None, "a/b.LRC", "vtt", "lrc"), (None, "a.unknown", "ass", "ass"), (None, "a.txt", None, "txt"), (None, "a.md", None, "markdown"), (None, "a.json3", None, "json3"),
])


@rows("k31_rendered", "doc_id long, content string", [(1, "1\n00:00:00,000 --> 00:00:01,733\none two,\n\n2\n00:00:01,833 --> 00:00:04,000\nthree four\n")])
def k31_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(1, 0, 0.0, 4.0, "one two, three four", None)], "doc_id long, cue_idx int, start double, duration double, text string, speaker string")
    return registry.render(own, path="x.srt", standardization=_SHORT)


scalar("f09_closing_marks", "text string", text.ends_with_mark, [("Yes.", True), ("(so)", False), ("（对）", True), ("“Go!”", True), ("well…", True), ("[x]", True), ("no", False), ("so:", False)], "boolean")
scalar("f20_speakers_among", "line string", lambda t: F.concat_ws("|", text.speaker_among(t, F.array(F.lit("Ann Dale"), F.lit("Bo")))["speaker"], text.speaker_among(t, F.array(F.lit("Ann Dale"), F.lit("Bo")))["text"]), [
    ("Ann Dale: hello", "Ann Dale:|hello"), ("Note: hello", "Note: hello"), (">> Cleo: hi", ">> Cleo:|hi"), ("Bo：你好", "Bo：|你好"), ("no label", "no label"),
])
