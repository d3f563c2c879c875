from __future__ import annotations

import pytest

from cuemill.llm import compress, encoding
from cuemill.llm.labels import code_of, script_of
from cuemill.session import table


@pytest.fixture(scope="module")
def profiles(spark):
    return encoding.fit(table(spark, "/root/testdata/sf0.01", "supervisions", "text", "language"), table(spark, "/root/testdata/sf0.01", "lexicon"))


ORIGINALS = [
    "Der Gärtner prüfte die Brücke während des Sturms.",
    "Le médecin a présenté le budget après le déjeuner, n’est-ce pas ?",
    "El médico revisó la torre antigua en el último momento.",
    "O capitão do porto apresentou a torre antiga na segunda-feira.",
    "Инженер проверил старую башню весной.",
    "测量员在河边否决了市场大厅。",
    "技師は月曜日に水ポンプを確認しました。",
]


@pytest.mark.parametrize("original", ORIGINALS)
@pytest.mark.parametrize("read", ["cp1252", "mac_roman", "cp437", "cp850"])
def test_utf8_read_as_a_single_byte_charset_comes_back(profiles, original, read):
    spoilt = "".join(encoding_char(b, read) for b in original.encode("utf-8"))
    garbled, restored, chain = encoding.Mender(profiles).mend(spoilt)
    assert garbled and chain
    if restored is not None:
        assert restored.replace("\xa0", " ") == original.replace("\xa0", " ")


def encoding_char(b, charset):
    try:
        return bytes([b]).decode(charset)
    except UnicodeDecodeError:
        return chr(b)


def test_sound_texts_stay(profiles):
    mender = encoding.Mender(profiles)
    for t in [*ORIGINALS, "The café’s roof, said Zoë – naïve, I know (at € 12, 20 °C).", "LE TRÉSORIER A VÉRIFIÉ LA LISTE DES IMPÔTS.", "plain ascii?", "", None, "♪ 掌声 ♪"]:
        assert not mender.mend(t)[0], t


def test_twice_partly_and_beyond_repair(profiles):
    mender = encoding.Mender(profiles)
    twice = "".join(encoding_char(b, "cp1252") for b in "".join(encoding_char(b, "cp1252") for b in ORIGINALS[0].encode()).encode())
    assert mender.mend(twice)[1] == ORIGINALS[0]
    assert mender.mend("„Der Arzt prüfte das Dach am Montag.â€œ")[1] == "„Der Arzt prüfte das Dach am Montag.“"
    assert mender.mend("Le greffier a d�fendu la carte.") == (True, None, None)


@pytest.mark.parametrize(
    ("spoilt", "original"),
    [("â€“ 56 â€“", "– 56 –"), ("[ MÃºsica ]", "[ Música ]"), ("ЙОЦЕОЕТ РТПЧЕТЙМ УФБТХА ВБЫОА ЧЕУОПК", "инженер проверил старую башню весной"), ("«L’architecte a rejeté l’horaire le matin, et cela a pris 288 jours.Â»", "«L’architecte a rejeté l’horaire le matin, et cela a pris 288 jours.»")],
)
def test_misread_text_of_everyday_characters_only(profiles, spoilt, original):
    mender = encoding.Mender(profiles)
    assert mender.mend(spoilt)[:2] == (True, original)
    assert not mender.mend(original)[0]


def test_every_plausible_candidate_may_win(profiles, monkeypatch):
    mender = encoding.Mender(profiles)
    spoilt, original = "Der GÃ¤rtner lobte die BrÃ¼cke.", "Der Gärtner lobte die Brücke."
    decoys = [(f"Der Gzq{chr(97 + k)}xkvner lobte die Brwj{chr(97 + k)}pcke.", "decoy", 2) for k in range(20)]
    monkeypatch.setattr(mender, "candidates", lambda text: [*decoys, (original, "right", 2)] if text == spoilt else [])
    assert mender.mend(spoilt) == (True, original, "right")
    costs = [(mender.least(t), mender.cost(t)) for t in [*ORIGINALS, spoilt, "VOILÀ\xa0!", "�"]]
    assert all(least <= cost for least, cost in costs)


def test_rows_in_and_out(spark, profiles):
    rows = [(1, "Der GÃ¤rtner lobte die BrÃ¼cke.", "x"), (1, "Der GÃ¤rtner lobte die BrÃ¼cke.", "x"), (2, None, "x"), (3, "", "x"), (4, "ok " * 50_000, "x"), (5, "é" * 30_000, None)]
    df = spark.createDataFrame(rows, "row_id long, text string, restored string")
    out = encoding.find_garbled(df, profiles).collect()
    assert [r.row_id for r in out if r.row_id == 1] == [1, 1] and all(r.restored == "Der Gärtner lobte die Brücke." for r in out if r.row_id == 1)
    assert encoding.find_garbled(df.limit(0), profiles).count() == 0


def test_fit_on_nothing(spark):
    cues = spark.createDataFrame([], "text string, language string")
    lexicon = spark.createDataFrame([], "lang string, term string, target_lang string, target_term string")
    nothing = encoding.fit(cues, lexicon)
    assert list(nothing.dictionaries) == ["und"]
    encoding.Mender(nothing).mend("BrÃ¼cke")
    only = encoding.fit(cues, spark.createDataFrame([("en", "the bridge", "de", "die Brücke")], lexicon.schema))
    assert sorted(only.dictionaries) == ["de", "en"]


def test_labels_and_scripts():
    assert [code_of(x) for x in ("en-GB", "fr_CA", "deu", "Japanese", "zh-Hans", "und", "", None, "ES")] == ["en", "fr", "de", "ja", "zh", None, None, None, "es"]
    assert [script_of(x) for x in ("abc", "мэр", "市長は", "市长", "पुल", "123")] == ["latin", "cyrillic", "kana", "han", "devanagari", None]


def test_sizes_tell_languages_apart(profiles):
    sizes = profiles.sizes("The gardener repaired the bridge despite the rain.")
    assert min(sizes, key=sizes.get) == "en"
    assert compress.lowered("ABC É") == "abc é" and compress.lowered("Abc") == "Abc"


def test_sound_foreign_letters_and_names_stay(profiles):
    mender = encoding.Mender(profiles)
    for t in ("DeÁngelis, LaÉtitia und McÉwan kamen.", "DeÁngelis", "LaÉtitia praised the map.", "Åse købte rødgrød på øen.", "Zażółć gęślą jaźń w środę.", "Žluťoučký kůň úpěl ďábelské ódy.", "Şişli’de güneş çıktı, ağaç büyüdü.", "Їжак з'їв ґудзик."):
        assert not mender.mend(t)[0], (t, mender.mend(t))


def test_one_misread_letter_and_lost_bytes(profiles):
    mender = encoding.Mender(profiles)
    assert mender.mend("O presidente da câmara descreveu o orÁamento no bairro antigo.")[:2] == (True, "O presidente da câmara descreveu o orçamento no bairro antigo.")
    assert mender.mend("Der Bibliothekar vergaÃ den Vertrag hinter dem Bahnhof.")[0]
    assert mender.mend("�")[0]


def test_profiles_count_every_labelled_row(spark):
    texts = [(f"report {k} of the caf{'e' if k % 4 else 'é'} house", "en") for k in range(30_000)]
    cues = spark.createDataFrame(texts, "text string, language string").repartition(3)
    lexicon = spark.createDataFrame([], "lang string, term string, target_lang string, target_term string")
    made = encoding.fit(cues, lexicon)
    assert made.chars["é"] == pytest.approx(2.0, abs=1e-12)
    assert {"report", "of", "the", "cafe", "café", "house"} <= set(compress._TERM.findall(made.dictionaries["en"].decode()))
    # a text delivered again counts again
    twice = encoding.fit(cues.unionAll(cues.where("text like '%é%'")), lexicon)
    assert twice.chars["é"] == pytest.approx(-compress.math.log2(0.4), abs=1e-12)


def test_hundredth_of_counted_leads():
    leads = [(0.5, 150), (0.1, 1), (0.2, 1), (0.3, 150)]
    flat = sorted(x for x, n in leads for _ in range(n))
    assert compress._hundredth(leads) == flat[len(flat) // 100]
    assert compress._hundredth([(0.5, 19)]) == compress._hundredth([]) == 0.0


def test_readings_that_cannot_pay_are_not_undone(profiles, monkeypatch):
    undone, undo = [], encoding._undo
    monkeypatch.setattr(encoding, "_undo", lambda *a: undone.append(a) or undo(*a))
    mender = encoding.Mender(profiles)
    for t in ("Инженер проверил старую башню весной и раба.", "Der Gärtner prüfte die Brücke während des Sturms."):
        assert not mender.mend(t)[0] and not undone, (t, undone)
    # each cut of a text is undone once, however much ASCII lies around it
    assert mender.mend("Le greffier a d�fendu la carte.")[0]
    assert len(undone) == len(set(undone))


def test_garbled_keys_are_those_of_restored_texts(spark, profiles):
    texts = [*ORIGINALS, "Der GÃ¤rtner lobte die BrÃ¼cke.", "Le greffier a d�fendu la carte.", "„Der Arzt prüfte das Dach am Montag.â€œ", "ЙОЦЕОЕТ РТПЧЕТЙМ УФБТХА ВБЫОА ЧЕУОПК", "orÁamento vergaÃ", None, "", "plain"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *texts])], "row_id long, text string")
    found = sorted(r.row_id for r in encoding.find_garbled(df, profiles).collect())
    assert found and sorted(r.row_id for r in encoding.garbled_keys(df, profiles).collect()) == found
    assert encoding.garbled_keys(df.limit(0), profiles).count() == 0
