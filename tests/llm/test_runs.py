from __future__ import annotations

import random

from cuemill.llm import runs

SCHEMA = "track_id long, cue_idx int, start double, duration double, text string"
BASE = "The mayor praised the bridge before the meeting, and that took 12 days."


def found(spark, rows, **columns):
    return sorted((r.track_id, r.first_position, r.last_position) for r in runs.event_runs(spark.createDataFrame(rows, SCHEMA)).where("events > 1").collect())


def test_same_words_in_other_writing():
    same = [
        BASE, BASE.upper(), "<i>" + BASE + "</i>", "[SPEAKER_00]: " + BASE, ">> " + BASE, BASE.replace(" ", " "), BASE.replace("praised", "praised praised"),
        BASE.replace("the bridge", "the- the bridge"), "Um, " + BASE, BASE.replace(".", "..."), BASE.replace("mayor", "may0r"), "“" + BASE + "”",
    ]
    assert len({"".join(runs.words_of(t)) for t in same}) == 1
    other = [BASE.replace("12", "13"), BASE.replace("mayor", "baker"), BASE.replace("bridge", "brÃ¼cke"), "Voto 5: el puente.", "Voto 3: el puente."]
    assert len({"".join(runs.words_of(t)) for t in [BASE, *other]}) == 6


def test_slips_but_not_words(spark):
    many = [(2, k, float(k), 1.0, BASE if k % 2 else "Le maire a cité la carte.") for k in range(40)] + [(3, k, float(k), 1.0, "Le maire a copié la carte." if k % 2 else "Nothing else") for k in range(40)]
    rows = many + [(1, 0, 0.0, 1.0, BASE), (1, 1, 1.0, 1.0, BASE.replace("praised", "prasied")), (1, 2, 2.0, 1.0, BASE.replace("bridge", "bridg")), (1, 3, 3.0, 1.0, "Le maire a cité la carte."), (1, 4, 4.0, 1.0, "Le maire a copié la carte.")]
    assert found(spark, rows) == [(1, 0, 2)]


def test_random_tracks_over_block_borders_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 7)
    rng = random.Random(1)
    rows, want = [], []
    for track in range(6):
        texts = []
        while len(texts) < rng.choice([1, 7, 20, 45]):
            texts += [rng.choice(["alpha beta", "gamma delta", "epsilon zeta", None, ""])] * rng.choice([1, 1, 2, 9])
        rows += [(track, k, float(k), 1.0, t) for k, t in enumerate(texts)]
        start = 0
        for k in range(1, len(texts) + 1):
            if k == len(texts) or texts[k] != texts[k - 1] or not texts[k]:
                if k - start > 1:
                    want.append((track, start, k - 1))
                start = k
    rng.shuffle(rows)
    assert found(spark, rows + rows[:20]) == sorted(want)
    every = runs.event_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.events for r in every) == len(rows)
    assert all(r.duration == r.events for r in every)


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(None, 0, 0.0, 1.0, "a"), (1, None, 0.0, 1.0, "a"), (1, 0, None, None, "word"), (1, 1, None, None, "word"), (1, 2, 1.0, 1.0, None)]
    out = runs.event_runs(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", block int, words string")).collect()
    assert sorted((r.first_position, r.last_position, r.duration) for r in out) == [(0, 1, None), (2, 2, 1.0)]
    assert runs.event_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert len(runs.words_of("a b " * 100_000)) == 200_000


def test_distance():
    assert [runs.distance(*p) for p in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "xyz"), ("a", "abcd"))] == [0, 1, 1, 3, 3]


def test_verdicts_do_not_depend_on_the_size_of_the_corpus(spark):
    common = [(2, k, float(k), 1.0, f"The harbour and the mayor, {k}.") for k in range(40)]
    rows = common + [
        (1, 0, 0.0, 1.0, "A harbour was seen."), (1, 1, 1.0, 1.0, "A harbuor was seen."), (1, 2, 2.0, 1.0, "A hrabour was seen."),
        (1, 3, 3.0, 1.0, "Zedrik left."), (1, 4, 4.0, 1.0, "Zedrok left."), (1, 5, 5.0, 1.0, "A grosser man."), (1, 6, 6.0, 1.0, "A harbur man."), (1, 7, 7.0, 1.0, "A habour man."),
    ]
    for times in (1, 20, 100):
        copies = [(track + 10 * k, *r) for k in range(times) for track, *r in rows]
        assert [x[1:] for x in found(spark, copies) if x[0] % 10 == 1] == [(0, 2), (6, 7)] * times


def test_thirds_are_one_edit_from_both():
    assert "harbour" in runs.thirds("harbuor", "hrabour") and "harbour" in runs.thirds("harbur", "habour") and "bridge" in runs.thirds("brdge", "brdige")
    assert runs.slips("mit groer eile", "mit grosser eile") == [("groer", "grosser", 1)]
