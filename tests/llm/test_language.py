from __future__ import annotations

import datetime as dt

import pytest

from cuemill.llm import encoding, language
from cuemill.session import table

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def profiles(spark):
    return encoding.fit(table(spark, D, "supervisions", "text", "language"), table(spark, D, "lexicon"))


def test_held_out_documents_by_language(spark, profiles):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang", "text")
    judged = language.classify(docs.withColumnRenamed("lang", "told"), profiles, "doc_id", "told").collect()
    right = sum(r.lang == r.told for r in judged)
    assert right >= 0.97 * len(judged)


EN, FR = "The mayor praised the bridge before the meeting.", "Le greffier a vérifié la carte après le déjeuner."


def test_tracks_stretches_and_labels(spark, profiles):
    rows = [(k, 1, k, EN if k not in (4, 5, 6) else FR) for k in range(12)] + [(20, 2, 0, None), (21, 2, 1, "[Wind]"), (22, 2, 2, ""), (23, 1, 3, EN), (24, 3, 0, FR), (25, 3, 1, FR)]
    cues = spark.createDataFrame(rows, "row_id long, track_id long, cue_idx int, text string")
    judged = language.classify(cues, profiles, "row_id", "track_id", "cue_idx").cache()
    tracks = language.track_languages(judged)
    assert {r.track_id: r.lang for r in tracks.collect()} == {1: "en", 2: None, 3: "fr"}
    foreign = language.foreign_cues(judged, tracks)
    assert sorted((r.row_id, r.lang) for r in foreign.collect()) == [(4, "fr"), (5, "fr"), (6, "fr")]
    assert [(r.first_cue, r.last_cue, r.cues) for r in language.stretches(foreign).collect()] == [(4, 6, 3)]
    at = dt.datetime(2031, 1, 1)
    told = spark.createDataFrame([(1, "eng", at), (3, "pt-BR", at), (3, "pt-BR", at), (2, None, at), (9, "en", at)], "track_id long, language string, ingested_at timestamp_ntz")
    assert [(r.track_id, r.lang) for r in language.label_cases(judged, told, tracks).collect()] == [(3, "fr")]


def test_doubtful_texts_are_rejected(profiles):
    c = language.Classifier(profiles)
    assert [c.classify(t)[0] for t in (None, "", "Hm.", "– 25 –", "♪ music ♪", "(Applaus)")] == [None] * 6
    assert c.classify("x " * 100_000)[1] >= 0


def test_empty_tables(spark, profiles):
    cues = spark.createDataFrame([], "row_id long, track_id long, cue_idx int, text string")
    judged = language.classify(cues, profiles, "row_id", "track_id", "cue_idx")
    tracks = language.track_languages(judged)
    assert tracks.count() == 0 and language.foreign_cues(judged, tracks).count() == 0


def test_texts_in_none_of_the_languages_are_rejected(profiles):
    c = language.Classifier(profiles)
    for t in ("Мер міста відкрив новий міст через річку після довгої наради.", "Вчора ввечері ми пішли до театру і побачили нову виставу.", "महापौरांनी नदीवरील नवीन पुलाचे उद्घाटन काल संध्याकाळी केले.", "De burgemeester opende gisteren de nieuwe brug over de rivier.", "Borgmesteren åbnede i går den nye bro over floden."):
        assert c.classify(t)[0] is None, t
    for t, lang in (("Инженер проверил старую башню весной.", "ru"), ("माली ने बिना झिझक रिपोर्ट को ठुकराया।", "hi"), (EN, "en"), (FR, "fr")):
        assert c.classify(t)[0] == lang, t


def test_segments_within_a_text(spark, profiles):
    df = spark.createDataFrame([(1, EN + " " + FR + "\n– 25 –", "x"), (2, EN, "x"), (3, None, "x"), (4, "", None)], "row_id long, text string, lang string")
    got = sorted((r.row_id, r.first, r.last, r.lang) for r in language.mixed_segments(df, profiles).collect())
    assert got == [(1, 0, len(EN) + 1, "en"), (1, len(EN) + 1, len(EN + " " + FR + "\n– 25 –"), "fr")]


def test_label_codes_as_columns(spark):
    from cuemill.llm.labels import code_of

    labels = ["en-GB", "fr_CA", "deu", "Japanese", " zh-Hans", "und", "", None, "ES", "x-y"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    assert [r[0] for r in df.select(language.label_code(df["label"])).collect()] == [code_of(x) for x in labels]


def test_garbling_is_told_without_restoring(profiles, monkeypatch):
    c = language.Classifier(profiles)
    monkeypatch.setattr(c.mender, "mend", None)
    assert c.classify("Der GÃ¤rtner lobte die BrÃ¼cke.") == (None, 0.0)
