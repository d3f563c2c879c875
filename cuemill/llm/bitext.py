"""Sentence alignment of bilingual tracks in geometric bitext space.

Points of correspondence are numbers, equal names and terms of a lexicon, through its
pivot language where both sides are others; each lies at (character offset in the text,
character offset in the translation).  A chain of points of consistent slope is searched
in rectangles that grow from its end until they hold one; points in crowded rows or
columns are noise and dropped.  Along the chain, sentences are joined in blocks: points
are spent greedily by weight, so that a sentence of two statements takes two partners
and one that only shares chance terms takes none.  Inversions are blocks off the chain
within the rectangle's width.

The lexicon is partial: a first pass pairs what is beyond doubt, words that go together
in these pairs over all tracks are learned as further terms, and a second pass uses both.
Learned terms never pass through the driver: each block gets those of its own words by a join.

Tracks longer than ``BLOCK`` lines are read in blocks with ``CONTEXT`` lines around them.
As omissions let the sides drift apart, the blocks are cut along a course of the whole
track: the longest rising row of lines that share what few lines of the track hold.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.session import cut

BLOCK = 1024
CONTEXT = 48
WIDTH = 6
CHAIN_POINTS = 6
LEAST_TOGETHER = 3
LEAST_DICE = 0.35
LEAST_FIRST, LEAST_THROUGH = 0.5, 0.3  # of the way over a third language

_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_WORD = re.compile(r"[^\W\d_]+(?:[ऀ-ःऺ-ॏ]+[^\W\d_]*)*")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿]")


def _fold(text: str) -> str:
    return text.casefold().replace("’", "'")


class Terms:
    """Terms of all languages by concept; longest first, word borders where a script has them."""

    def __init__(self, lexicon: list[tuple[str, str]]):
        self.concept: dict[str, str] = {}
        for pivot, term in lexicon:
            self.concept.setdefault(_fold(term), _fold(pivot))
            self.concept.setdefault(_fold(pivot), _fold(pivot))
        parts = sorted(self.concept, key=len, reverse=True)
        alternatives = "|".join(re.escape(p) if _UNSPACED.search(p) else rf"(?<!\w){re.escape(p)}(?!\w)" for p in parts)
        self.pattern = re.compile(alternatives) if parts else None

    def read(self, text: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
        """Concepts and numbers with their offsets, and the words left over."""
        folded = _fold(text)
        found = [("#" + m.group().replace(",", "."), m.start()) for m in _NUMBER.finditer(folded)]
        rest = folded
        if self.pattern:
            spans = [(self.concept[m.group()], m.start(), m.end()) for m in self.pattern.finditer(folded)]
            found += [(c, a) for c, a, _ in spans]
            for _, a, b in reversed(spans):
                rest = rest[:a] + " " * (b - a) + rest[b:]
        words = []
        for m in _WORD.finditer(rest):
            w = m.group()
            if _UNSPACED.search(w):
                words += [(w[k : k + 2], m.start() + k) for k in range(max(1, len(w) - 1))]
            else:
                words.append((w, m.start()))
        return found, words


class Bitext:
    """One block of lines: two sides with their points."""

    def __init__(self, left: list[str], right: list[str], terms: Terms, learned: dict[str, dict[str, float]]):
        self.sides = []
        for lines in (left, right):
            read = [terms.read(t) for t in lines]
            at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in lines])))
            self.sides.append((read, at))
        self.n, self.m = len(left), len(right)
        self.learned = learned
        df: Counter = Counter()
        for read, _ in self.sides:
            for found, words in read:
                df.update({c for c, _ in found} | {w for w, _ in words})
        total = max(2, self.n + self.m)
        self.weight = {c: max(0.3, math.log((total + 8) / k)) * (1.6 if c[0] == "#" else 1.0) for c, k in df.items()}

    def points(self) -> list[tuple[float, float, float, int, int]]:
        """(x, y, weight, i, j) of every correspondence whose row and column are not crowded."""
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for j, (found, words) in enumerate(self.sides[1][0]):
            for c, a in [*found, *((w, a) for w, a in words if len(w) > 4 and w[0].isalpha())]:
                where[c].append((j, a))
        out = []
        reach = max(12, abs(self.n - self.m) + 8, int(0.12 * self.m))
        for i, (found, words) in enumerate(self.sides[0][0]):
            for c, a in [*found, *((w, a) for w, a in words if len(w) > 4)]:
                near = [(j, b) for j, b in where.get(c, ()) if abs(j - i * self.m / max(1, self.n)) <= reach]
                if 0 < len(near) <= 4:
                    for j, b in near:
                        out.append((self.sides[0][1][i] + a, self.sides[1][1][j] + b, self.weight.get(c, 1.0) / len(near), i, j))
        return out

    def chain(self) -> np.ndarray:
        """Expected line of the other side for each line: slope-consistent chains in growing rectangles."""
        points = sorted(self.points())
        end_x, end_y = float(self.sides[0][1][-1]), float(self.sides[1][1][-1])
        slope = end_y / max(1.0, end_x)
        anchors = [(0.0, 0.0)]
        x, y = 0.0, 0.0
        arr = np.array([p[:3] for p in points]) if points else np.empty((0, 3))
        while len(arr):
            size, found = 400.0, None
            while True:
                inside = arr[(arr[:, 0] > x) & (arr[:, 0] <= x + size) & (arr[:, 1] > y - 0.5 * size * slope) & (arr[:, 1] <= y + 1.5 * size * slope)]
                if len(inside) >= CHAIN_POINTS:
                    offset = (inside[:, 1] - y) - slope * (inside[:, 0] - x)
                    order = np.argsort(offset)
                    best = None
                    for k in range(len(order) - CHAIN_POINTS + 1):
                        part = order[k : k + CHAIN_POINTS]
                        spread = offset[part[-1]] - offset[part[0]]
                        drift = abs(float(np.mean(offset[part])))
                        score = spread + 0.5 * drift
                        if best is None or score < best[0]:
                            best = (score, part, spread)
                    if best[2] <= 90 + 0.15 * size or size > end_x:
                        found = inside[best[1]]
                        break
                if size > end_x + 400:
                    break
                size *= 1.5
            if found is None:
                break
            nx, ny = float(np.max(found[:, 0])), float(np.mean(found[:, 1] - slope * found[:, 0])) + slope * float(np.max(found[:, 0]))
            anchors.append((float(np.mean(found[:, 0])), float(np.mean(found[:, 1]))))
            if nx <= x:
                break
            x, y = nx, max(0.0, ny)
        anchors.append((end_x, end_y))
        ax, ay = zip(*sorted(anchors), strict=True)
        middle = (self.sides[0][1][:-1] + self.sides[0][1][1:]) / 2
        expected = np.interp(middle, ax, ay)
        return np.searchsorted(self.sides[1][1], expected, side="right") - 1

    def shared(self, i: int, j: int, left: Counter, right: Counter) -> tuple[float, Counter]:
        """Weight of what two sentences share, and the tokens spent for it."""
        spent: Counter = Counter()
        score = 0.0
        both = left & right
        for c, k in both.items():
            if c[0] in "#*" or len(c) > 4 or _UNSPACED.search(c):
                score += self.weight.get(c.lstrip("*"), 1.0) * k
                spent[c] += k
        for c in left:
            partners = self.learned.get(c)
            if not partners or spent[c]:
                continue
            best = max(((p, s) for d, s in partners.items() if d in right and not spent[d] for p in (d,)), key=lambda z: z[1], default=None)
            if best:
                score += best[1] * min(self.weight.get(c.lstrip("*"), 1.0), self.weight.get(best[0].lstrip("*"), 1.0))
                spent[c] += 1
                spent[best[0]] += 1
        return score, spent

    def bags(self, side: int) -> list[Counter]:
        return [Counter([*(c if c[0] == "#" else "*" + c for c, _ in found), *(w for w, _ in words)]) for found, words in self.sides[side][0]]

    def pairs(self) -> list[tuple[int, int, float, float]]:
        """(i, j, weight, share of the smaller sentence explained) of sentence blocks."""
        if not self.n or not self.m:
            return []
        expected = self.chain()
        left, right = self.bags(0), self.bags(1)
        heap = []
        for i in range(self.n):
            for j in range(max(0, expected[i] - WIDTH), min(self.m, expected[i] + WIDTH + 1)):
                score, _ = self.shared(i, j, left[i], right[j])
                if score > 0:
                    heap.append((score - 0.12 * abs(j - expected[i]), i, j))
        heap.sort(key=lambda z: (-z[0], z[1], z[2]))
        self.vocabulary = [set().union(*bags) for bags in (left, right)]
        self.known: list[dict[str, bool]] = [{}, {}]
        total = [[self.mass(b, side) for b in bags] for side, bags in enumerate((left, right))]
        out = []
        used_left, used_right = [Counter(b) for b in left], [Counter(b) for b in right]
        for _, i, j in heap:
            score, spent = self.shared(i, j, used_left[i], used_right[j])
            least = min(total[0][i], total[1][j])
            share = score / max(least, 1e-9)
            if score >= LEAST_SCORE and share >= LEAST_COVER:
                used_left[i] -= spent
                used_right[j] -= spent
                out.append((i, j, score, share))
        out += self.fill(out, used_left, used_right, total)
        return out + self.moved(out, left, right, total)

    def moved(self, done: list, left: list[Counter], right: list[Counter], total: list) -> list[tuple[int, int, float, float]]:
        """Inversions beyond the chain's width: lines left over on both sides that agree nearly whole."""
        taken_left, taken_right = {i for i, *_ in done}, {j for _, j, *_ in done}
        rest = [j for j in range(self.m) if j not in taken_right]
        heap = []
        for i in range(self.n):
            if i in taken_left:
                continue
            for j in rest:
                score, _ = self.shared(i, j, left[i], right[j])
                share = score / max(min(total[0][i], total[1][j]), 1e-9)
                if score >= MOVED_SCORE and share >= MOVED_COVER:
                    heap.append((score, share, i, j))
        out = []
        used_left, used_right = {}, {}
        for _, _, i, j in sorted(heap, reverse=True):
            a, b = used_left.setdefault(i, Counter(left[i])), used_right.setdefault(j, Counter(right[j]))
            score, spent = self.shared(i, j, a, b)
            share = score / max(min(total[0][i], total[1][j]), 1e-9)
            if score >= MOVED_SCORE and share >= MOVED_COVER:
                used_left[i], used_right[j] = a - spent, b - spent
                out.append((i, j, score, share))
        return out

    def fill(self, done: list, left: list[Counter], right: list[Counter], total: list) -> list[tuple[int, int, float, float]]:
        """Pairs of lines left over between paired neighbours, on weaker evidence but never against a number."""
        partner = {i: j for i, j, *_ in sorted(done, key=lambda z: z[2])}
        taken_left, taken_right = {i for i, *_ in done}, {j for _, j, *_ in done}
        heap = []
        for i in range(self.n):
            near = [partner[k] + (i - k) for k in (i - 1, i + 1, i - 2, i + 2) if k in partner]
            for j in {y + d for y in near for d in (-1, 0, 1)}:
                if not 0 <= j < self.m or (i in taken_left and j in taken_right):
                    continue
                score, spent = self.shared(i, j, left[i], right[j])
                numbers = {c for c in left[i] if c[0] == "#"}, {c for c in right[j] if c[0] == "#"}
                free = i not in taken_left and j not in taken_right
                share = score / max(min(total[0][i], total[1][j]), 1e-9)
                if numbers[0] and numbers[1] and not numbers[0] & numbers[1]:
                    continue
                if score >= (1.2 if free else 1.8) and share >= (FILL_COVER if free else LEAST_COVER):
                    heap.append((share, score, i, j))
        out = []
        for _, _, i, j in sorted(heap, reverse=True):
            score, spent = self.shared(i, j, left[i], right[j])
            share = score / max(min(total[0][i], total[1][j]), 1e-9)
            free = i not in taken_left and j not in taken_right
            if score >= (1.2 if free else 1.8) and share >= (FILL_COVER if free else LEAST_COVER):
                left[i] -= spent
                right[j] -= spent
                taken_left.add(i)
                taken_right.add(j)
                out.append((i, j, score, share))
        return out

    def mass(self, bag: Counter, side: int) -> float:
        """Weight of the tokens of a sentence that the other side is known to have words for."""
        return sum(self.weight.get(c.lstrip("*"), 1.0) * k for c, k in bag.items() if c[0] == "#" or self.expressed(c, side))

    def expressed(self, token: str, side: int) -> bool:
        known = self.known[side].get(token)
        if known is None:
            other = self.vocabulary[1 - side]
            known = self.known[side][token] = token[0] == "*" and token in other or any(p in other for p in self.learned.get(token, ()))
        return known


LEAST_SCORE = 2.0
LEAST_COVER = 0.4
FILL_COVER = 0.34
MOVED_SCORE = 3.5
MOVED_COVER = 0.55


COURSE_LINES = 4  # a sign is held by so many lines of a side at most
COURSE_WORDS = 12  # longest line read whole for signs of two


def _signs(segments: DataFrame, lexicon: list[tuple[str, str]], least: int) -> DataFrame:
    """Numbers and terms of every line, alone and in twos, as ``track, side, line, sign``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(lexicon)
        for batch in batches:
            out = []
            for track, line, *sides in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for side, text in enumerate(sides):
                    found, words = terms.read(text) if text else ((), ())
                    own = sorted({c for c, _ in found} | {w for w, _ in words if len(w) > 4})
                    shown = own + [f"{a} {b}" for k, a in enumerate(own[:COURSE_WORDS]) for b in own[k + 1 : COURSE_WORDS]]
                    out += [(track, side, line, sign) for sign in shown]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["track", "side", "line", "sign"])

    long = segments.groupBy("track").agg(F.max("line").alias("last")).where(F.col("last") >= least).select("track")
    lines = segments.join(long, "track", "left_semi").select("track", "line", "text", "translation").distinct()
    return lines.mapInArrow(work, "track long, side int, line long, sign string")


def rising(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest row of points that rises on both sides."""
    points = sorted(set(points), key=lambda p: (p[0], -p[1]))
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(points):
        n = bisect_left(ends, y)
        before.append(at[n - 1] if n else -1)
        if n == len(ends):
            ends.append(y)
            at.append(k)
        else:
            ends[n], at[n] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(points[k])
        k = before[k]
    return out[::-1]


def _course(segments: DataFrame, lexicon: list[tuple[str, str]], block: int, context: int) -> DataFrame:
    """Range of translation lines of each block of text lines, ``track, block, low, high``, for tracks longer than a block."""
    signs = _signs(segments, lexicon, block)
    own = Window.partitionBy("track", "side", "sign")
    signs = signs.withColumn("sign", F.xxhash64("sign")).withColumn("held", F.count("*").over(own)).where(F.col("held") <= COURSE_LINES)
    left = signs.where("side = 0").select("track", "sign", F.col("line").alias("i"))
    right = signs.where("side = 1").select("track", "sign", F.col("line").alias("j"))
    points = left.join(right, ["track", "sign"])
    # chance points lie off the course: a pair of lines must share two signs or more
    points = points.groupBy("track", "i", "j").count().where("count >= 2").select("track", "i", "j")
    sizes = segments.groupBy("track").agg(F.max(F.when(F.col("text") != "", F.col("line"))).alias("n"), F.max(F.when(F.col("translation") != "", F.col("line"))).alias("m")).where(F.greatest("n", "m") >= block)
    ends = sizes.select("track", F.lit(-1).cast("long").alias("i"), F.coalesce("n", F.lit(0)).alias("j")).unionAll(sizes.select("track", F.lit(-2).cast("long").alias("i"), F.coalesce("m", F.lit(0)).alias("j")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        track = None

        def ranges() -> pa.RecordBatch:
            n, m = (max([j for _, i, j in rows if i == which], default=0) for which in (-1, -2))
            way = rising([(i, j) for _, i, j in rows if i >= 0])
            xs, ys = [-1.0, *(p[0] for p in way), n + 1.0], [-1.0, *(p[1] for p in way), m + 1.0]
            firsts = np.arange(0, n + 1, block)
            low = np.floor(np.interp(firsts, xs, ys)).astype(int) - context
            high = np.ceil(np.interp(np.minimum(firsts + block, n + 1), xs, ys)).astype(int) + context
            low[0], high[-1] = 0, max(m, high[-1])
            return pa.RecordBatch.from_arrays([pa.array([track] * len(firsts), pa.int64()), pa.array(firsts // block, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["track", "block", "low", "high"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and r[0] != track:
                    yield ranges()
                    rows = []
                track = r[0]
                rows.append(r)
        if rows:
            yield ranges()

    return points.unionAll(ends).repartition("track").sortWithinPartitions("track", "i", "j").mapInArrow(work, "track long, block long, low long, high long")


def _blocks(segments: DataFrame, lexicon: list[tuple[str, str]]) -> DataFrame:
    clean = segments.where("track_id is not null and line_number is not null").select(
        F.col("track_id").cast("long").alias("track"), F.col("line_number").cast("long").alias("line"), "seg_id", "translation_id", "text", "translation"
    )
    at, home = F.col("line") % BLOCK, F.floor(F.col("line") / BLOCK)
    blocks = F.array_compact(F.array(home, F.when((at < CONTEXT) & (home > 0), home - 1), F.when(at >= BLOCK - CONTEXT, home + 1)))
    ranges = _course(clean, lexicon, BLOCK, CONTEXT)
    none = F.lit(None).cast
    left = clean.select("track", F.explode(blocks).alias("block"), "line", "seg_id", none("long").alias("translation_id"), "text", none("string").alias("translation"))
    right = clean.select("track", "line", none("long").alias("seg_id"), "translation_id", none("string").alias("text"), "translation")
    # tracks of one block have no course and need none
    mine = ranges.groupBy("track").agg(F.collect_list(F.struct("block", "low", "high")).alias("ranges"))
    there = F.transform(F.filter("ranges", lambda x: (F.col("line") >= x["low"]) & (F.col("line") <= x["high"])), lambda x: x["block"])
    right = right.join(mine, "track", "left").select("track", F.explode(F.when(F.col("ranges").isNull(), F.array(F.lit(0).cast("long"))).otherwise(there)).alias("block"), "line", "seg_id", "translation_id", "text", "translation")
    return left.unionByName(right)


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition("track", "block").sortWithinPartitions("track", "block", "line", "seg_id", "translation_id")


def _per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    rows: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and rows[0][:2] != r[:2]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _sides(rows: list[tuple]) -> tuple[list, list]:
    """Distinct lines of both sides: (line, ids, text)."""
    left: dict[int, tuple] = {}
    right: dict[int, tuple] = {}
    for _, _, line, seg, tra, text, translation in rows:
        if line is None:
            continue  # a learned term
        if text:
            left.setdefault(line, (line, [], text))[1].append(seg)
        if translation:
            right.setdefault(line, (line, [], translation))[1].append(tra)
    return [left[k] for k in sorted(left)], [right[k] for k in sorted(right)]


def learn(blocks: DataFrame, lexicon: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Learned terms, and the words and concepts of each block (``track, block, a``).

    Terms are ``a, b, weight``: what goes together in pairs beyond doubt, both ways, and
    what two share with a third.  A pair counts if seen ``LEAST_TOGETHER`` times with a Dice coefficient of ``LEAST_DICE``,
    however large the corpus is.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(lexicon)
        counts: Counter = Counter()
        own: list[tuple[int, int, str]] = []

        def flush() -> pa.RecordBatch:
            # pairs of words with their number, and words of blocks without one
            a, b = zip(*counts, strict=True) if counts else ((), ())
            tracks, numbers, held = zip(*own, strict=True) if own else ((), (), ())
            none, blank = [None] * len(counts), [None] * len(own)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([*none, *tracks], pa.int64()), pa.array([*none, *numbers], pa.int64()), pa.array([*a, *held], pa.string()),
                    pa.array([*b, *blank], pa.string()), pa.array([*counts.values(), *blank], pa.int64()),
                ],
                ["track", "block", "a", "b", "n"],
            )
            counts.clear()
            own.clear()
            return out

        for rows in _per_block(batches):
            left, right = _sides(rows)
            bitext = Bitext([x[2] for x in left], [x[2] for x in right], terms, {})
            found = bitext.pairs()
            degree = Counter(("l", i) for i, *_ in found) + Counter(("r", j) for _, j, *_ in found)
            bags = bitext.bags(0), bitext.bags(1)
            own += [(rows[0][0], rows[0][1], w) for w in {w for side in bags for bag in side for w in bag if w[0] != "#"}]
            for i, j, score, share in found:
                if degree["l", i] == 1 and degree["r", j] == 1 and share >= 0.6 and score >= 3:
                    a = {w for w in bags[0][i] if w[0] != "#"} - set(bags[1][j])
                    b = {w for w in bags[1][j] if w[0] != "#"} - set(bags[0][i])
                    counts.update((x, y) for x in a for y in b)
                    counts.update((x, "") for x in a)
                    counts.update(("", y) for y in b)
            if len(counts) + len(own) > 300_000:
                yield flush()
        yield flush()

    seen = cut(_ordered(blocks).mapInArrow(work, "track long, block long, a string, b string, n long"))
    counts = cut(seen.where("n is not null").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TOGETHER))
    left = counts.where("b = ''").select("a", F.col("n").alias("na"))
    right = counts.where("a = ''").select("b", F.col("n").alias("nb"))
    sure = (
        counts.where("a <> '' and b <> ''").join(left, "a").join(right, "b")
        .select("a", "b", (2 * F.col("n") / (F.col("na") + F.col("nb"))).alias("weight")).where(F.col("weight") >= LEAST_DICE)
    )
    direct = cut(sure.unionAll(sure.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.max("weight").alias("weight")))
    first = direct.where(F.col("weight") >= LEAST_FIRST).select("a", F.col("b").alias("via"), F.col("weight").alias("w1"))
    then = direct.select(F.col("a").alias("via"), "b", F.col("weight").alias("w2"))
    through = first.join(then, "via").where((F.col("a") != F.col("b")) & (F.col("w1") * F.col("w2") >= LEAST_THROUGH)).groupBy("a", "b").agg(F.max(F.col("w1") * F.col("w2")).alias("weight"))
    return direct.unionAll(through.join(direct.select("a", "b"), ["a", "b"], "left_anti")), seen.where("n is null").select("track", "block", "a")


def align(segments: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Pairs of sentences that render the same statement, fully or in part.

    ``segments``: ``track_id``, ``line_number``, ``seg_id``, ``text``, ``translation``,
    ``translation_id``; either text may be null or empty and then has no partner.  Rows
    that agree in track and line are one delivery repeated: the pair comes out for every
    delivered text row with every delivered translation.  Rows without track or line are
    ignored, further columns too.  Result: ``seg_id``, ``translation_id``, ``score``, ``cover``.
    """
    terms_rows = [(r[0], r[1]) for r in lexicon.select("term", "target_term").where("term is not null and target_term is not null").distinct().orderBy("term", "target_term").collect()]
    blocks = cut(_blocks(segments, terms_rows))
    learned, words = learn(blocks, terms_rows)
    # a term travels in a row without a line, its weight in millionths
    told = words.join(learned, "a").select(
        "track", "block", F.lit(None).cast("long").alias("line"), F.rint(F.col("weight") * 1_000_000).cast("long").alias("seg_id"), F.lit(None).cast("long").alias("translation_id"), F.col("a").alias("text"), F.col("b").alias("translation")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(terms_rows)
        for rows in _per_block(batches):
            block = rows[0][1]
            left, right = _sides(rows)
            known: dict[str, dict[str, float]] = defaultdict(dict)
            for _, _, line, weight, _, a, b in rows:
                if line is None:
                    known[a][b] = weight / 1_000_000
            known = {a: dict(sorted(x.items())) for a, x in known.items()}
            out = []
            for i, j, score, share in Bitext([x[2] for x in left], [x[2] for x in right], terms, known).pairs():
                if left[i][0] // BLOCK == block:
                    out += [(s, t, score, share) for s in left[i][1] for t in right[j][1] if s is not None and t is not None]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())],
                ["seg_id", "translation_id", "score", "cover"],
            )

    return _ordered(blocks.unionByName(told)).mapInArrow(work, "seg_id long, translation_id long, score double, cover double")
