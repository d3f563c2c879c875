from __future__ import annotations

import random

import pytest

from cuemill.llm import bitext as B

SUBJECTS = [("the mayor", "der Bürgermeister"), ("the baker", "der Bäcker"), ("the doctor", "der Arzt"), ("the clerk", "der Schreiber"), ("the surveyor", "der Landvermesser")]
VERBS = [("praised", "lobte"), ("forgot", "vergaß"), ("quoted", "zitierte"), ("repaired", "reparierte")]
OBJECTS = [("the bridge", "die Brücke"), ("the budget", "den Haushalt"), ("the map", "die Karte"), ("the letter", "den Brief"), ("the wooden gate", "das Holztor"), ("the library", "die Bibliothek")]
LEXICON = [("en", a, "de", b) for a, b in SUBJECTS + VERBS + OBJECTS[:4]]
SCHEMA = "track_id long, line_number int, seg_id long, text string, translation_id long, translation string"


def corpus(seed, tracks=6, lines=40):
    """Invented tracks with omissions, merges and swaps, and the true pairs."""
    rng = random.Random(seed)
    rows, truth, ids = [], set(), iter(range(1, 10**6))
    for track in range(tracks):
        left, right = [], []
        for _ in range(lines):
            (s, t), (u, v), (o, p) = rng.choice(SUBJECTS), rng.choice(VERBS), rng.choice(OBJECTS)
            n = rng.randrange(1000)
            left.append([f"{s} {u} {o} {n}.", []])
            right.append([f"{t} {v} {p} {n}.", [len(left) - 1]])
        for k in range(0, lines - 7, 9):
            right[k], right[k + 1] = right[k + 1], right[k]
            right[k + 3] = [right[k + 3][0] + " " + right[k + 4][0], right[k + 3][1] + right[k + 4][1]]
            right[k + 4] = None
            right[k + 6] = None
        right = [r for r in right if r]
        seg = [next(ids) for _ in left]
        tra = [next(ids) for _ in right]
        truth |= {(seg[i], tra[j]) for j, (_, sources) in enumerate(right) for i in sources}
        for k in range(len(left)):
            rows.append((track, k, seg[k], left[k][0], tra[k] if k < len(right) else None, right[k][0] if k < len(right) else None))
    return rows, truth


def frames(spark, rows):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(LEXICON, "lang string, term string, target_lang string, target_term string")


def test_pairs_against_the_truth(spark):
    rows, truth = corpus(1)
    got = {(r.seg_id, r.translation_id) for r in B.align(*frames(spark, rows)).collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got)


def test_blocks_find_the_same(spark, monkeypatch):
    rows, truth = corpus(2, tracks=2, lines=60)
    monkeypatch.setattr(B, "BLOCK", 16)
    got = {(r.seg_id, r.translation_id) for r in B.align(*frames(spark, rows)).collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.9 * len(got)


def test_sides_that_drift_apart(spark, monkeypatch):
    rows, truth = corpus(3, tracks=1, lines=700)
    monkeypatch.setattr(B, "BLOCK", 128)
    got = {(r.seg_id, r.translation_id) for r in B.align(*frames(spark, rows)).collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.9 * len(got)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, 0, 1, "the mayor praised the bridge 5.", 2, "der Bürgermeister lobte die Brücke 5."), (1, 0, 3, "the mayor praised the bridge 5.", 2, "der Bürgermeister lobte die Brücke 5."), (1, 1, 4, None, None, None), (1, 2, 5, "", None, None), (None, 3, 6, "x", 7, "y"), (2, 0, 8, "the baker", None, None)]
    got = {(r.seg_id, r.translation_id) for r in B.align(*frames(spark, rows)).collect()}
    assert got == {(1, 2), (3, 2)}
    assert B.align(*frames(spark, [])).count() == 0


def long_track(lines, omitted):
    """One long track whose second side leaves out a stretch, and the true pairs."""
    rng = random.Random(9)
    rows, truth = [], set()
    left, right = [], []
    for k in range(lines):
        (s, t), (u, v), (o, p) = rng.choice(SUBJECTS), rng.choice(VERBS), rng.choice(OBJECTS)
        n = rng.randrange(100_000)
        left.append(f"{s} {u} {o} {n}.")
        if not lines // 2 <= k < lines // 2 + omitted:
            right.append((k, f"{t} {v} {p} {n}."))
    for k, text in enumerate(left):
        other = right[k] if k < len(right) else None
        rows.append((1, k, k, text, 1_000_000 + k if other else None, other[1] if other else None))
    truth = {(source, 1_000_000 + j) for j, (source, _) in enumerate(right)}
    return rows, truth


@pytest.mark.parametrize("omitted", [120, 500])
def test_long_omissions_in_a_long_track(spark, omitted):
    rows, truth = long_track(3000, omitted)
    got = {(r.seg_id, r.translation_id) for r in B.align(*frames(spark, rows)).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got & truth) >= 0.97 * len(got)
