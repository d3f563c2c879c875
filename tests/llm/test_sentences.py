from __future__ import annotations

import pytest

from cuemill.llm import sentences as S

STATS = S.Corpus(
    {"dr", "mr", "prof", "st", "etc", "p", "vol", "no", "cf", "ca", "hr", "z", "b", "sr", "д", "т"}, {"etc", "т", "д"}, {"the", "der", "el", "le", "что", "a", "in", "mayor"}
)


def cut(*cues):
    d = S.Document(list(cues), STATS)
    ends = d.ends()
    return [d.text[a:b].strip() for a, b in zip([0, *ends], ends)]


@pytest.mark.parametrize(
    ("cues", "want"),
    [
        (["Dr. Ann came. The mayor left!"], ["Dr. Ann came.", "The mayor left!"]),
        (["Sacks, crates, etc. The mayor left."], ["Sacks, crates, etc.", "The mayor left."]),
        (["See vol. 3, p. 4 and no. 5 at 2.5 km. The end."], ["See vol. 3, p. 4 and no. 5 at 2.5 km.", "The end."]),
        (["The mayor... the baker left. The", "mayor came."], ["The mayor... the baker left.", "The\nmayor came."]),
        (["“Stop!” said the mayor. “Go!” said the baker."], ["“Stop!” said the mayor.", "“Go!” said the baker."]),
        (["He replied: “The mayor left.” The baker came."], ["He replied: “The mayor left.”", "The baker came."]),
        (["Am 3. Mai kam er. Der Arzt ging."], ["Am 3. Mai kam er.", "Der Arzt ging."]),
        (["« Arrêtez ! » a crié le maire. Le maire part ?"], ["« Arrêtez ! » a crié le maire.", "Le maire part ?"]),
        (["line one.The mayor left."], ["line one.", "The mayor left."]),
        (["「止まれ！」と市長が叫びました。司書……先生は春に。"], ["「止まれ！」と市長が叫びました。", "司書……先生は春に。"]),
        (["“停下！”市长喊道。园丁说：“走吧。”老师来了（9.5%）。"], ["“停下！”市长喊道。", "园丁说：“走吧。”", "老师来了（9.5%）。"]),
        (["डॉ. वेलमार आए। माली गया |"], ["डॉ. वेलमार आए।", "माली गया |"]),
        (["市长来了 书记员走了", "老师来了\n园丁走了"], ["市长来了", "书记员走了", "老师来了", "园丁走了"]),
        (["no mark at all", "second"], ["no mark at all", "second"]),
        ([""], []),
    ],
)
def test_known_texts(cues, want):
    assert cut(*cues) == want


SCHEMA = "track_id long, cue_idx int, row_id long, text string"


def told(spark, stats=STATS):
    """The same facts as rows."""
    words = stats.abbreviations | stats.enders | stats.ordinary
    return spark.createDataFrame([(w, (w in stats.abbreviations) + 2 * (w in stats.enders) + 4 * (w in stats.ordinary)) for w in sorted(words)], "word string, flags int")


def read(stats):
    """Facts as rows back in sets."""
    rows = stats.collect()
    return S.Corpus(*({r.word for r in rows if r.flags & bit} for bit in (1, 2, 4)))


def test_rows_positions_repeats_and_nulls(spark):
    rows = [(1, 0, 10, "The mayor"), (1, 1, 11, "left. The baker came. "), (1, 1, 12, "left. The baker came. "), (1, 2, 13, None), (None, 0, 14, "A."), (2, None, 15, "A."), (3, 0, 16, "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", S.F.lit("x"))
    got = sorted((r.row_id, r.end_pos) for r in S.sentence_ends(df, told(spark)).collect())
    assert got == [(11, 5), (11, 21), (12, 5), (12, 21)]
    assert S.sentence_ends(df.limit(0), told(spark)).count() == 0


def test_blocks_give_what_the_whole_gives(spark, monkeypatch):
    rows = [(1, k, k, t) for k, t in enumerate(["Dr. Ann saw the", "mayor. The baker", "came at 2.5 km. And", "left!"] * 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, S.sentence_ends(df, told(spark)).collect()))
    monkeypatch.setattr(S, "BLOCK", 10)
    assert sorted(map(tuple, S.sentence_ends(df, told(spark)).collect())) == whole


def test_corpus_learns_abbreviations(spark):
    texts = ["Dr. Vel saw it. The mayor left the hall.", "Dr. Ol came. The hall was open etc. The mayor saw etc. and left.", "In the hall, Dr. Um spoke. The mayor left."] * 5
    stats = read(S.corpus(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")))
    assert "dr" in stats.abbreviations and "dr" not in stats.enders
    assert "etc" in stats.enders and "hall" not in stats.abbreviations and "the" in stats.ordinary
    assert read(S.corpus(spark.createDataFrame([], "text string"))).abbreviations == set()


def test_more_documents_leave_a_document_as_it_is(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 100)
    own = [(1, k, k, "The mayor saw it and left.") for k in range(300)]
    for k, t in ((20, "Here Xyq. Harper spoke."), (150, "Then Xyq. Harper left."), (210, "And Xyq. Dale came."), (299, "He saw")):
        own[k] = (1, k, k, t)
    want = None
    for more in (0, 20, 100):
        rest = [(2 + k // 1000, k % 1000, 1000 + k, "The baker left. A clerk, no. 4, came and left a note.") for k in range(300 * more)]
        df = spark.createDataFrame(own + rest, SCHEMA)
        got = sorted((r.row_id, r.end_pos) for r in S.sentence_ends(df, S.corpus(df)).where("row_id < 1000").collect())
        want = want or got
        assert got == want and (20, 23) in got and (20, 9) not in got, (more, got[18:24], len(got))


def test_facts_and_marks_of_the_whole_document_reach_every_block(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 64)
    texts = ["no mark at all"] * 400
    texts[10] = "so Qpl. in small letters."
    texts[330] = "saw Qpl. Harper"
    rows = [(1, k, k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.row_id, r.end_pos) for r in S.sentence_ends(df, told(spark)).collect())
    assert got == [(399, 14)]


def test_long_quotations(spark):
    quote = "“" + "The mayor left. " * 60 + "The end.” Then he came."
    d = S.Document([quote], STATS)
    assert len(d.ends()) == 2
    assert len(S.Document(["“ The mayor left. The end came. “No.” The mayor came."], STATS).ends()) == 4
