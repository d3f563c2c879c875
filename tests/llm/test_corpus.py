from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuemill.llm import mixing, packing, reading, tokens
from cuemill.llm.packing import Capacity

D = "/root/testdata/sf0.01"


def test_tokens_give_the_text_back_and_nulls_none(spark):
    texts = ["The mayor.", "", None, "水ポンプ é 123", "word " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = {r.doc_id: r.tokens for r in tokens.with_tokens(df, "doc_id").collect()}
    own = tokens.encoding()
    assert own.decode(own.encode_ordinary(texts[3])) == texts[3]
    assert sizes == {k: len(own.encode_ordinary(t)) if t else 0 for k, t in enumerate(texts)}


def items(spark, sizes):
    return spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long")


def test_packing_keeps_everything_whole_within_all_limits(spark):
    rng = random.Random(4)
    sizes = [rng.randrange(1, 300) for _ in range(4000)] + [1000, 2501, 1, 0, None]
    cap = Capacity(1000, 12, 4e5)
    packed = packing.pack(items(spark, sizes), "doc_id", "tokens", cap, shard_bins=100).collect()
    by_item, by_bin = {}, {}
    for r in packed:
        by_item.setdefault(r.item, []).append(r.tokens)
        by_bin.setdefault(r.container, []).append(r.tokens)
    assert {k: sum(v) for k, v in by_item.items()} == {k: s for k, s in enumerate(sizes) if s}
    assert all(len(v) == math.ceil(sizes[k] / 1000) for k, v in by_item.items())
    for held in by_bin.values():
        assert sum(held) <= 1000 and len(held) <= 12 and (sum(x * x for x in held) <= 4e5 or len(held) == 1)


def test_packing_is_tight_and_handles_ties(spark):
    packed = packing.pack(items(spark, [500] * 2001), "doc_id", "tokens", Capacity(1000, 100, 1e6), shard_bins=64)
    fills = [r.fill for r in packing.containers(packed, Capacity(1000, 100, 1e6)).collect()]
    assert len(fills) == 1001 and sorted(fills)[1] == 1.0
    assert packing.pack(items(spark, []), "doc_id", "tokens", Capacity(10, 5, 100.0)).count() == 0


def test_best_fit_prefers_the_least_rest():
    assert packing.best_fit([(0, 7), (1, 5), (2, 3), (3, 5)], Capacity(10, 9, 1e9)) == [[0, 2], [1, 3]]
    assert packing.best_fit([(0, 5), (1, 5)], Capacity(10, 1, 1e9)) == [[0], [1]]
    assert packing.best_fit([(0, 5), (1, 5)], Capacity(10, 9, 30.0)) == [[0], [1]]


def test_best_fit_looks_at_every_container_that_may_be_best():
    # many containers with a little less room, but only the last one has documents already
    items = [(k, 90) for k in range(30)] + [(30, 45), (31, 44), (32, 5)]
    assert [30, 31, 32] in packing.best_fit(items, Capacity(100, 50, 1e4, (1.0, 0.1, 0.0)))


def test_best_fit_equals_a_search_of_all_containers():
    rng = random.Random(6)
    for cap in (Capacity(200, 6, 2e4), Capacity(200, 50, 4e4), Capacity(200, 9, 3e4, (0.2, 1.0, 0.5))):
        items = [(k, rng.randrange(1, 160)) for k in range(400)]
        bins, (wt, wd, wa) = [], cap.weights
        for k, size in sorted(items, key=lambda x: (-x[1], x[0])):
            open_ = [b for b in bins if b[0] >= size and b[1] >= 1 and b[2] >= size * size]
            norm = lambda b, size=size: wt * ((b[0] - size) / cap.tokens) ** 2 + wd * ((b[1] - 1) / cap.documents) ** 2 + wa * ((b[2] - size * size) / cap.attention) ** 2
            best = min(open_, key=lambda b: (norm(b), b[0], bins.index(b)), default=None)
            if best is None:
                bins.append(best := [cap.tokens, cap.documents, cap.attention, []])
            best[0], best[1], best[2] = best[0] - size, best[1] - 1, best[2] - size * size
            best[3].append(k)
        assert packing.best_fit(items, cap) == [b[3] for b in bins]


TARGETS = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("none", 0.1, 1)]


def test_mixing_reaches_targets_within_the_caps(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "A ", "a", "a", "b", "c", " c"]), rng.randrange(1, 400)) for k in range(9000)] + [(9001, None, 5), (9002, "x", 5), (9003, "a", None), (9004, "b", 0)]
    selection, shares, schedule = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, tokens long"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"))
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"a", "b", "c", "none", "x"} and got["x"].tokens == 0 and got["none"].tokens == 0
    for s in "abc":
        assert abs(got[s].reached_share - got[s].weight) < 0.01
        assert got[s].most_repeats <= got[s].max_repeats
    times = {r.doc_id: r.times for r in selection.collect()}
    assert 9001 not in times and 9003 not in times and min(times.values()) >= 1
    for s in "bc":  # whole passes come first: use counts of a source differ by one at most
        used = {times.get(k, 0) for k, x, _ in rows[:9000] if x.strip().lower() == s}
        assert max(used) - min(used) <= 1


def test_each_limit_binds_alone(spark):
    rng = random.Random(5)
    sizes = items(spark, [rng.randrange(20, 200) for _ in range(3000)])
    for cap, limit in ((Capacity(1000, 1000, 1e9), "tokens"), (Capacity(1000, 4, 1e9), "documents"), (Capacity(1000, 1000, 6e4), "attention")):
        bound = [r.binding for r in packing.containers(packing.pack(sizes, "doc_id", "tokens", cap), cap).collect()]
        assert bound.count(limit) > 0.9 * len(bound), (limit, len(bound))


def test_passes_take_the_blocks_in_other_orders(spark):
    rows = [(k, "ab"[k % 3 == 0], 10) for k in range(6000)]
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 6)], "source string, target_share double, max_repeats int")
    selection, shares, schedule = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, tokens long"), targets)
    taken = {}
    for r in schedule.where("source = 'b'").orderBy("pass", "position").collect():
        taken.setdefault(r["pass"], []).append(r.block)
    assert len(taken) == 3 and sorted(taken[1]) == sorted(taken[2]) == list(range(3)) and len({tuple(v) for v in taken.values()}) > 1
    # every record of a source is used once a pass as often as ``times`` says
    blocks = {(p, b) for p, own in taken.items() for b in own}
    for r in selection.where("source = 'b'").collect():
        assert all((p, r.block) in blocks for p in range(1, r.times + 1))
    _, tempered, _ = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, tokens long"), targets, wanted_entropy=0.69)
    got = {r.source: r for r in tempered.collect()}
    assert 0 < got["a"].exponent < 1 and mixing.entropy({k: r.reached_share for k, r in got.items()}) == pytest.approx(0.69, abs=0.003)


def test_entropy_yields_to_repeats():
    w, a = mixing.weights_for_entropy({"a": 90.0, "b": 10.0}, {"a": 1, "b": 2}, 100.0, 0.69)
    assert w["b"] == pytest.approx(0.2, abs=1e-6) and 0 < a < 1


def test_exponents():
    own = {"a": 0.7, "b": 0.2, "c": 0.1}
    a = mixing.exponent_for_entropy(own, 1.0)
    assert mixing.entropy(mixing.normalised({k: v**a for k, v in own.items()})) == pytest.approx(1.0, abs=1e-6)
    w, e = mixing.weights({"a": 90.0, "b": 10.0}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, 100.0)
    assert 0 < e < 1 and w["b"] * 100 <= 20 + 1e-6 and w["b"] == pytest.approx(0.2, abs=1e-6)
    assert mixing.weights({}, {}, {}, 0.0) == ({}, 0.0)


def test_mixing_nothing(spark):
    selection, shares, schedule = mixing.mix(spark.createDataFrame([], "doc_id long, source string, tokens long"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"))
    assert selection.count() == 0 and {r.tokens for r in shares.collect()} == {0}


def test_held_out_grades(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/reading_labels.parquet")
    train, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0 and grade is not null")
    judged = reading.reading_levels(docs.join(labels.select("doc_id").distinct(), "doc_id"), train)
    rows = judged.join(held.withColumnRenamed("grade", "told"), "doc_id").select("level", "told").collect()
    level, told = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert np.corrcoef(level, told)[0, 1] > 0.9 and np.abs(level - told).mean() < 1.1


def test_reading_without_labels_words_or_rows(spark):
    docs = spark.createDataFrame([(1, "The mayor left.", "en", "s"), (2, None, "en", "s"), (3, "12 ... 3", None, None), (4, "x " * 100_000, "de", "s")], "doc_id long, text string, lang string, source string")
    none = spark.createDataFrame([(1, None)], "doc_id long, grade int")
    assert {r.doc_id: r.level for r in reading.reading_levels(docs, none).collect()} == {1: None, 2: None, 3: None, 4: None}
    some = spark.createDataFrame([(1, 2), (1, 3), (4, 9), (77, 5)], "doc_id long, grade int")
    levels = {r.doc_id: r.level for r in reading.reading_levels(docs, some).collect()}
    assert levels[2] is None and levels[3] is None and 1 <= levels[1] < levels[4] <= 12
    assert reading.profile(reading.reading_levels(docs.limit(0), some)).count() == 0


def test_connectives_of_several_words_count_once():
    reader = reading.Reader("es", {})
    plain, linked = (reader.features(t) for t in ("El alcalde llegó sin prisa, por la noche.", "El alcalde llegó sin embargo, por tanto."))
    at = reading.FEATURES.index("connectives")
    assert plain[at] == 0 and linked[at] == pytest.approx(100 * 2 / 7)
    assert reader.features("Word " * 9)[reading.FEATURES.index("rarity")] == reading.RAREST


def test_levels_do_not_depend_on_the_size_of_the_corpus(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{D}/reading_labels.parquet").select("doc_id", "grade")
    more = docs.crossJoin(spark.range(5).withColumnRenamed("id", "k")).withColumn("doc_id", F.col("doc_id") + 10_000_000 * F.col("k")).drop("k")
    a, b = ({r.doc_id: r.level for r in reading.reading_levels(x, labels).where("doc_id < 10000000").collect()} for x in (docs, more))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)
