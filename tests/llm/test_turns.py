from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.llm import turns as T

PEOPLE = [(1, "Ann Griburest", "Ann", "Griburest", "Farm Bloc"), (2, "Bo Quiladör", "Bo", "Quiladör", "Civic Union"), (3, "Cleo Kedigar", "Cleo", "Kedigar", "Farm Bloc"), (4, "Dora Kedigar", "Dora", "Kedigar", "Green Dyke")]
REGISTER = T.Register([(i, g, s, p) for i, _, g, s, p in PEOPLE])


def test_labels_of_one_person():
    for label in ("Ann Griburest", "GRIBUREST Ann", "Griburest, A.", "Dr. Griburest", "the hon. Ann Griburest", "griburest", "A Griburest", "Gribruest", "Griburest (Farm Bloc)", "GRIBUREST:", "Griburest —"):
        assert REGISTER.resolve(label) == (1,), label
    assert REGISTER.resolve("QUILADOR") == (2,) and REGISTER.resolve("Bo Quilaödr") == (2,)
    assert REGISTER.resolve("Kedigar") == (3, 4) and REGISTER.resolve("D. Kedigar") == (4,) and REGISTER.resolve("Kedigar (Green Dyke)") == (4,)
    assert REGISTER.resolve("The clerk replied") == () and REGISTER.resolve("") == () and REGISTER.resolve("laughter") == ()


def test_lines_are_read():
    read = lambda text, column=None: T.parse_line(text, column, REGISTER)
    assert read("[00:00:35] **GRIBUREST:** The uh… baker left. [coughs] (0:59)") == (True, True, (1,), "The baker left.")
    assert read(">> Quiladör, Bo: [laughter] Yes.") == (True, True, (2,), "Yes.")
    assert read("00:01:10 - Um, the mayor left.")[3] == "the mayor left."
    assert read("Um.")[0] is False and read("[applause]")[0] is False and read("♪ coughs ♪")[0] is False and read(None)[0] is False and read("")[0] is False
    assert read("The mayor said: no.", "Bo Quiladör") == (True, True, (2,), "The mayor said: no.")
    assert read("**Stranger:** Hello.")[:3] == (True, True, ())


SCHEMA = "track long, line long, header boolean, start double, stop double, text string, speaker string"


def found(spark, lines, **how):
    speakers = spark.createDataFrame(PEOPLE, "speaker_id long, full_name string, given_name string, surname string, party string")
    return T.turns(spark.createDataFrame(lines, SCHEMA), speakers, **how)


def test_turns(spark):
    lines = [
        (1, 0, False, 0.0, 1.0, "Before anyone.", None), (1, 1, False, 1.0, 2.0, "Ann Griburest: One.", None), (1, 2, False, 2.0, 3.0, "[applause]", "Bo Quiladör"), (1, 3, False, 3.0, 4.0, "Two.", None),
        (1, 3, False, 3.0, 4.0, "Two.", None), (1, 4, True, 4.0, 4.0, "## Part", None), (1, 5, False, 5.0, 6.0, "Three.", ""), (1, 6, False, 6.0, 7.0, "Four.", "Bo Quiladör"), (1, 7, False, 7.0, 8.0, None, None),
        (1, 8, False, 8.0, 9.0, "Five six seven eight.", None), (1, 9, False, 9.0, 10.0, "six seven eight. Nine.", None), (1, 10, False, None, None, "**Stranger:** Hm so.", None), (None, 1, False, 0.0, 1.0, "x", "Bo"),
    ]
    got = sorted((r.first_line, r.last_line, r.speaker_id, r.text) for r in found(spark, lines).collect())
    assert got == [(1, 3, 1, "One. Two."), (5, 5, 1, "Three."), (6, 9, 2, "Four. Five six seven eight. Nine.")]


def test_blocks_sweep_like_the_whole(spark, monkeypatch):
    import random

    rng = random.Random(8)
    lines = []
    for track in range(3):
        for k in range(60):
            who = rng.choice([None, None, None, "Ann Griburest", "Bo Quiladör", "Stranger X"])
            kind = rng.choice(["talk"] * 6 + ["note", "header"])
            lines.append((track, k, kind == "header", float(k), k + 0.5, {"talk": f"Word number {k} here.", "note": "[coughs]", "header": "## Part"}[kind], who))
    rows = lambda: sorted(map(tuple, found(spark, lines).drop("turn").collect()))
    whole = rows()
    monkeypatch.setattr(T, "BLOCK", 5)
    assert rows() == whole and len(whole) > 20


def test_one_of_two_namesakes_by_the_track(spark):
    lines = [(1, 0, False, 0.0, 1.0, "A.", "Dora Kedigar"), (1, 1, False, 1.0, 2.0, "B.", "Kedigar"), (2, 0, False, 0.0, 1.0, "C.", "Kedigar"), (2, 1, False, 1.0, 2.0, "D.", "Cleo Kedigar")]
    assert sorted((r.track_id, r.first_line, r.last_line, r.speaker_id) for r in found(spark, lines).collect()) == [(1, 0, 1, 4), (2, 0, 1, 3)]


def test_empty(spark):
    assert found(spark, [(1, 0, False, 0.0, 1.0, "x", None)]).count() == 0
    assert T.turns(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "speaker_id long, full_name string, given_name string, surname string, party string")).count() == 0


def test_overlaps_of_any_length_are_dropped(spark):
    shown = [f"w{k}" for k in range(120)]
    df = spark.createDataFrame([(" ".join(shown[:90]), " ".join(shown[10:]))], "before string, now string")
    assert df.select(T._fresh(F.col("before"), F.col("now")).alias("x")).first().x == " ".join(shown[90:])


def test_labels_and_notes_of_any_length():
    read = lambda text, column=None: T.parse_line(text, column, REGISTER)
    assert read("**The right honourable member for the upper dyke, Dr. Ann Griburest:** Yes.") == (True, True, (1,), "Yes.")
    assert read("Yes. [" + "a long noise from behind the hall " * 5 + "]")[3] == "Yes."
    assert read("The long speech of the old engineer who came with Ann Griburest that day: no.")[1] is False


def test_sweep_by_time_and_calibrated_pauses(spark, monkeypatch):
    lines = [(1, k, False, float(10 * k), 10.0 * k + 9.5, f"Number {k}.", "Ann Griburest") for k in range(40)]
    lines[20:] = [(1, k, False, 10.0 * k + 60, 10.0 * k + 69.5, f"Number {k}.", "Ann Griburest") for k in range(20, 40)]
    lines += [(1, 99, False, 15.0, 19.8, "Between.", None), (1, 100, False, None, None, "Behind.", None)]
    split = lambda: sorted((r.first_line, r.last_line, r.pauses) for r in found(spark, lines, by_time=True, split_at_pauses=True).collect())
    whole = split()
    assert whole == [(0, 100, 0), (20, 39, 0)]
    text = {r.first_line: r.text for r in found(spark, lines, by_time=True, split_at_pauses=True).collect()}[0]
    assert text.startswith("Number 0. Number 1. Between. Behind. Number 2.")
    assert [(r.first_line, r.last_line, r.pauses) for r in found(spark, lines, by_time=True).collect()] == [(0, 100, 1)]
    monkeypatch.setattr(T, "BLOCK", 7)
    monkeypatch.setattr(T, "BLOCK_SECONDS", 45)
    assert split() == whole
