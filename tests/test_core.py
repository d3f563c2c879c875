from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cuemill.functions import languages, text, timecode
from cuemill import config
from cuemill.operators import bilingual, pipelines, segments, timing, words
from cuemill.plans import collect, wordlevel
from cuemill.sources import document_formats, registry, text_formats

QUERIES, ORACLES = collect()


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("NaT", "<NA>", "None"):
        return "null"
    if hasattr(x, "tolist") and not isinstance(x, str | bytes):
        x = x.tolist()
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int | float):
        return str(int(x)) if x == int(x) else f"{x:.6g}"
    return str(x)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for path in glob.glob(data + "/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, data, name):
    got = QUERIES[name](spark, data).toPandas()
    if name not in ORACLES:
        assert len(got) and not got.isna().all().any()  # rows, and no column without any value
        return
    want = duck.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(tuple(map(value, r)) for r in f[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_stamps_of_known_values(spark):
    assert one(spark, timecode.srt_stamp(F.lit(3661.5))) == "01:01:01,500"
    assert one(spark, timecode.srt_stamp(F.lit(1.234))) == "00:00:01,234"
    assert one(spark, timecode.lrc_stamp(F.lit(59.9996))) == "01:00.000"
    assert one(spark, timecode.drop_frame_timecode(F.lit(60.06))) == "00:01:00;02"
    assert one(spark, timecode.drop_frame_timecode(F.lit(600.6))) == "00:10:00;18"
    assert timecode.TimecodeOffset.of("01:00:00:12", 24).total_seconds == 3600.5
    with pytest.raises(ValueError):
        timecode.TimecodeOffset.of("12")


def test_text_of_known_values(spark):
    assert one(spark, text.normalize_text(F.lit(" don’t &amp;lt; wait…\n now "))) == "don't < wait now"
    assert one(spark, text.normalize_text(F.lit(None).cast("string"))) == ""
    assert one(spark, text.speaker_of(F.lit(">> Ann: hi")))[0] == ">> Ann:"
    assert one(spark, text.speaker_of(F.lit("not a label")))[0] is None
    assert one(spark, text.wrap(F.lit("aa bb cc dd"), 5)) == "aa bb\ncc dd"
    assert one(spark, text.wrap(F.lit("aa bb cc dd ee ff"), 5, 2)) == "aa bb\ncc dd"
    assert one(spark, text.cjk_ratio(F.lit("中文ab"))) == 0.5
    assert one(spark, languages.detect_script(F.lit("123"))) is None


CUES = "track_id long, cue_idx int, start double, duration double, speaker string, text string"


def test_overlaps_of_the_three_modes(spark):
    cues = spark.createDataFrame([(1, 0, 0.0, 3.0, "A", "a"), (1, 1, 2.0, 2.0, "B", "b"), (1, 2, 5.0, 2.0, "A", "c")], CUES)
    assert [tuple(r) for r in timing.overlap_pairs(cues).collect()] == [(1, 0, 1)]
    merged = sorted(timing.merge_overlaps(cues).collect(), key=lambda r: r.start)
    assert [(r.start, r.end, r.speaker, r.text) for r in merged] == [(0.0, 4.0, None, "- A: a\n- B: b"), (5.0, 7.0, "A", "c")]
    trimmed = {r.cue_idx: round(r.duration, 3) for r in timing.trim_overlaps(cues).collect()}
    assert trimmed == {0: 1.95, 1: 2.0, 2: 2.0}


def test_overlaps_across_many_bins_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(1, k, rng.uniform(0, 900), rng.choice([0.5, 40.0, 200.0]), None, "t") for k in range(150)]
    want = {(a[1], b[1]) for a in rows for b in rows if (b[2], b[1]) > (a[2], a[1]) and b[2] < a[2] + a[3]}
    got = timing.overlap_pairs(spark.createDataFrame(rows, CUES)).collect()
    assert len(got) == len(want) and {(r.first, r.second) for r in got} == want


def test_sanitize_and_shift(spark):
    cues = spark.createDataFrame([(1, 0, 0.0, 2.0, None, "a"), (1, 1, 2.02, 2.0, None, "b"), (1, 2, 9.0, 0.3, None, "c")], CUES)
    out = {r.cue_idx: (r.start_ms, r.duration_ms) for r in timing.sanitize_timeline(cues).collect()}
    assert out == {0: (0, 1940), 1: (2020, 2000), 2: (9000, 800)}
    assert [(r.start, r.duration) for r in timing.shift_time(cues, -3.0).orderBy("cue_idx").collect()] == [(0.0, pytest.approx(1.02)), (6.0, 0.3)]


def test_operators_on_empty_and_null(spark):
    empty = spark.createDataFrame([], CUES)
    nulls = spark.createDataFrame([(1, 0, None, None, None, None), (None, 1, 1.0, 1.0, None, None)], CUES)
    for df in (empty, nulls):
        for f in (timing.overlap_pairs, timing.merge_overlaps, timing.trim_overlaps, timing.validate, timing.sanitize_timeline, segments.merge_same_speaker, segments.split_long_lines, bilingual.bilingual_mode, segments.merge_pairs):
            f(df).collect()
        assert timing.overlap_pairs(df).count() == 0


def test_formats_read_foreign_documents(spark):
    docs = {
        "srt": "﻿1\r\n00:00:00,480 --> 00:00:03,980\r\nJOHN: Hi there\r\n",
        "vtt": "WEBVTT\n\nNOTE x\n\n00:01.000 --> 00:02.500 align:start\n<v Ann>Hello</v>\n",
        "sbv": "0:00:00.000,0:00:02.500\nhello\n",
        "ass": "[Script Info]\nScriptType: v4.00+\n[Events]\nFormat: Layer\nDialogue: 0,0:00:01.00,0:00:02.00,Default,Bob,0,0,0,,{\\i1}one,\\Ntwo\n",
        "json3": '{"events":[{"tStartMs":0,"dDurationMs":1000,"segs":[{"utf8":"a"},{"utf8":" b"}]},{"tStartMs":1,"dDurationMs":5,"aAppend":1,"segs":[{"utf8":"\\n"}]}]}',
        "ttml": '<tt xmlns="http://www.w3.org/ns/ttml"><body><div><p begin="1s" dur="500ms">x<br/>y</p></div></body></tt>',
        "markdown": "---\na: b\n---\n## [00:00:00] Part\n\n**Ann:** Hello there. [00:00:05]\n\n[Applause] [00:00:08]\n",
        "lrc": "[ti:x]\n[00:01.00]a\n[00:03.50]b\n",
        "txt": "[1.0-2.5] hi\nplain\n",
    }
    want = {
        "srt": [(0.48, 3.5, "JOHN:", "Hi there")], "vtt": [(1.0, 1.5, "Ann", "Hello")], "sbv": [(0.0, 2.5, None, "hello")], "ass": [(1.0, 1.0, "Bob", "one,\ntwo")], "json3": [(0.0, 1.0, None, "a b")],
        "ttml": [(1.0, 0.5, None, "x\ny")], "lrc": [(1.0, 2.5, None, "a"), (3.5, 5.0, None, "b")], "txt": [(1.0, 1.5, None, "hi"), (0.0, 0.0, None, "plain")],
    }
    for fmt, content in docs.items():
        df = spark.createDataFrame([(1, content), (2, None), (3, "")], "doc_id long, content string")
        got = [(round(r.start, 3), round(r.duration, 3), r.speaker, r.text) for r in registry.read(df, fmt).where("doc_id = 1").orderBy("cue_idx").collect()]
        if fmt in want:
            assert got == want[fmt], fmt
        else:
            assert [g[3] for g in got] == ["Hello there.", "[Applause]"] and got[0][:2] == (0.0, 5.0)  # a stamp at the end is the end
        assert df.where("doc_id = 1").select(registry.detect_format(F.col("content")).alias("f")).first().f == fmt or fmt == "txt"
    with pytest.raises(registry.FormatNotSupportedError):
        registry.read(df, "nope")


def test_conversion_between_formats(spark):
    df = spark.createDataFrame([(1, "1\n00:00:01,000 --> 00:00:02,000\nhi\n\n2\n00:00:03,000 --> 00:00:04,500\ntwo\nlines\n")], "doc_id long, content string")
    vtt = registry.convert(df, "srt", "vtt")
    assert registry.convert(vtt, "vtt", "srt").first().content == df.first().content


def test_rolling_words(spark):
    content = """WEBVTT
Kind: captions

00:00:00.000 --> 00:00:02.000 align:start position:0%

&gt;&gt; hello<00:00:00.500><c> big</c><00:00:01.000><c> world</c>

00:00:02.000 --> 00:00:02.010 align:start position:0%
hello big world

00:00:02.010 --> 00:00:04.000 align:start position:0%
hello big world
next<00:00:03.000><c> one</c>

00:00:04.000 --> 00:00:04.010
next one

00:00:04.010 --> 00:00:05.000
next one
tail
"""
    rows = document_formats.read_word_vtt(spark.createDataFrame([(1, content), (2, None)], "doc_id long, content string")).orderBy("cue_idx").collect()
    assert [(r.text, r.speaker, [(w.symbol, round(w.start, 2), round(w.duration, 2)) for w in r.words]) for r in rows] == [
        ("hello big world", ">>", [("hello", 0.0, 0.5), ("big", 0.5, 0.5), ("world", 1.0, 1.0)]),
        ("next one tail", None, [("next", 2.01, 0.99), ("one", 3.0, 1.0), ("tail", 4.0, 0.01)]),
    ]


def test_word_documents_hold_every_cue(spark, data):
    said = "Tom & <i>Jerry</i> &amp; {\\N} -->"
    cue = spark.createDataFrame([(1, 0, 1.0, 0.07, said, None)], "doc_id long, cue_idx int, start double, duration double, text string, speaker string")
    worded = segments.with_even_words(cue)
    back = document_formats.read_word_vtt(text_formats.write_word_vtt(worded)).collect()
    assert [r.text for r in back] == [said] and [w.symbol for w in back[0].words] == said.split()
    ass = text_formats.write_word_ass(worded).first().content
    assert ass.count("\\kf") == 6 and "\\{\\\u2060N\\}" in ass
    cues = wordlevel._word_documents(spark, data)
    expected = spark.read.parquet(f"{data}/supervisions.parquet").where("start >= 0 and duration > 0 and length(trim(text)) > 0")
    first = spark.read.parquet(f"{data}/supervisions.parquet").groupBy("track_id", "cue_idx").agg({"row_id": "min"}).withColumnRenamed("min(row_id)", "row_id")
    assert cues.count() == expected.join(first, "row_id", "left_semi").count()
    written = text_formats.write_word_vtt(cues).selectExpr("sum(size(split(content, ' --> ')) - 1) AS n").first().n
    assert written == cues.where("size(words) > 0").count()


def test_options_are_checked():
    config.StandardizationConfig(), config.VTTConfig("center"), config.FrameRate(29.97, True), config.RenderConfig()
    for wrong in (lambda: config.StandardizationConfig(min_duration=0), lambda: config.StandardizationConfig(margin_collision_mode="x"), lambda: config.VTTConfig("middle"), lambda: config.FrameRate(25, True)):
        with pytest.raises(ValueError):
            wrong()


def test_word_level_functions(spark):
    raw = "{\\an8\\kf30}hel{\\k20}lo {\\K50}you"
    assert [tuple(s) for s in one(spark, words.parse_karaoke(F.lit(raw)))] == [("hel", 0.0, 0.3), ("lo ", 0.3, 0.2), ("you", 0.5, 0.5)]
    assert one(spark, words.word_offsets(F.lit("a bb a x"), F.array(*map(F.lit, ["a", "bb", "a", "q"])))) == [1, 3, 6, 0]
    for t in ("", "abc", "水ポンプ、と橋。", "é́x y", "a b c d e f"):
        parts = words.slices(t, [1.0, 3.0, 2.0])
        assert "".join(parts) == t and len(parts) == 3
    assert words.slices(None, [1.0]) is None and words.slices("a", []) is None
    cues = spark.createDataFrame([(1, k, s, d, None, "x") for k, (s, d) in enumerate([(0.0, 2.0), (1.0, 2.0), (2.0, 1.0), (5.0, 1.0)])], CUES)
    assert {r.cue_idx: r.tier for r in words.event_tiers(cues).collect()} == {0: 0, 1: 1, 2: 0, 3: 0}


def test_sentences_over_cue_borders(spark):
    cues = spark.createDataFrame([(1, 0, 0.0, 2.0, "A", "One two. Three"), (1, 1, 2.0, 2.0, "A", "four! Five."), (1, 2, 5.0, 1.0, "B", "Six"), (2, 0, 0.0, 1.0, None, None)], CUES)
    got = sorted((r.track_id, r.first_cue, r.last_cue, r.text) for r in words.split_sentences(cues).collect())
    assert got == [(1, 0, 0, "One two."), (1, 0, 1, "Three four!"), (1, 1, 1, "Five."), (1, 2, 2, "Six")]


def test_standardized_cues_keep_limits_and_words(spark):
    long = " ".join(f"word{k}" for k in range(60))
    cues = spark.createDataFrame([(1, 0, 0.0, 20.0, "A", long), (1, 1, 20.02, 0.2, "B", "short"), (1, 2, None, 1.0, None, "x")], CUES)
    rows = pipelines.standardize(cues).orderBy("cue_idx", "part").collect()
    assert " ".join(" ".join(r.text.split()) for r in rows if r.cue_idx == 0) == long
    assert all(len(line) <= 42 for r in rows for line in r.text.split("\n")) and all(r.duration <= 7.5 for r in rows)
    assert [r.duration for r in rows if r.cue_idx == 1] == [0.8]


def test_translations_of_another_number_are_refused(spark):
    cues = spark.createDataFrame([(1, 0, 0.0, 1.0, None, "a"), (1, 1, 1.0, 1.0, None, "b")], CUES)
    one_ = spark.createDataFrame([(1, 0, "x")], "track_id long, cue_idx int, translation string")
    with pytest.raises(Exception, match="differ in number"):
        pipelines.set_translations(cues, one_, "de").collect()
    both = one_.union(spark.createDataFrame([(1, 1, "y")], one_.schema))
    assert sorted(r.translation for r in pipelines.set_translations(cues, both, "de").collect()) == ["x", "y"]
    assert {r.translation for r in pipelines.strip_translations(pipelines.set_translations(cues, both, "de")).collect()} == {None}


def test_matches_lose_no_link(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.choice([1, 3, 8, 12, 13, 20, 40]))).strip() for _ in range(120)]
    texts += [t + "。" for t in ("市长来了", "市长在河边走了很久很久才回家")] + ["市长来了", "市长在河边走了很久很久才回家"] + [t[1:] for t in texts[:30]] + [t + "b" for t in texts[:30]]
    lines = [(k % 3, k, t) for k, t in enumerate(texts)]
    squash = lambda t: " ".join(t.split())
    want = {}
    for t, i, x in lines:
        x = squash(x)
        found = [(min(len(x), len(y)) / max(len(x), len(y)), -j) for u, j, y in ((u, j, squash(y)) for u, j, y in lines) if u == t and j != i and x and y and (x in y or y in x)]
        found = [f for f in found if f[0] > 0.8]
        if found:
            want[i] = -max(found)[1]
    df = spark.createDataFrame(lines, "track_id int, id long, text string")
    assert {r.id: r.match for r in words.match_texts(df, df).collect()} == want


def test_folds_stream_over_one_long_track(spark):
    n = 200_000
    cues = spark.range(n).select(F.lit(1).cast("long").alias("track_id"), F.col("id").cast("int").alias("cue_idx"), (F.col("id") * 1.0).alias("start"), F.when(F.col("id") % 3 == 0, 1.5).otherwise(0.2).alias("duration"))
    done = timing.sanitize_timeline(cues)
    assert done.count() == n and done.where("duration_ms < 100").count() == 0
    assert words.event_tiers(cues).groupBy("tier").count().orderBy("tier").collect()[0][0] == 0


def test_a_wrong_colour_fails(spark):
    from cuemill.functions import color

    with pytest.raises(Exception, match="no colour"):
        spark.range(1).select(color.palette(F.lit("#GGGGGG"))).collect()
