"""Reading level of documents by regularised ordinal regression.

Features of a whole text: lexical diversity, word rarity in its language, connectives,
depth of clauses (a proxy), and lengths of words and sentences.  The proportional-odds
model is fitted with an L2 penalty on at most ``LABEL_LIMIT`` graded documents, chosen
by hash, and calibrated to the grades: level is the expected grade.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.session import cut

LABEL_LIMIT = 50_000
LEAST_SHARE = 5e-6
RAREST = -math.log2(LEAST_SHARE)  # bits of every word of that share or less: the feature is clipped there
GRADES = 12
PENALTY = 1.0
CACHE_WORDS = 400_000

# Connectives that open subordinate or consequent clauses; several words are one connective.
CONNECTIVES = {
    "en": "because, although, whereas, consequently, notwithstanding, however, therefore, moreover, furthermore, nevertheless, unless, while, since, though, hence, thus, provided that, whether, which, that, who, in order to, as well as",
    "de": "weil, obwohl, während, wohingegen, folglich, ungeachtet, jedoch, daher, deshalb, ferner, dennoch, sofern, indem, da, wenngleich, somit, also, ob, dass, welche, welcher, wobei, im hinblick auf",
    "fr": "car, bien que, quoique, alors que, par conséquent, nonobstant, cependant, donc, puisque, toutefois, néanmoins, tandis que, lorsque, parce que, afin de, pourtant, ainsi que, que, qui, dont, lequel, laquelle",
    "es": "porque, aunque, mientras que, por consiguiente, no obstante, sin embargo, por tanto, además, puesto que, pues, siempre que, cuando, así que, que, quien, cual, cuyo",
}
_WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_ASIDE = re.compile(r"\([^()\n]*\)|—[^—\n.!?]*—")
_TOKEN = re.compile(_WORD.pattern + r"|[.!?…]+[\s”»“)]+|\n{2,}")  # words and ends of sentences
_HYPHEN = re.compile(r"(\w)-\n(\w)")
_VOWELS = re.compile(r"[aeiouyäöüáàâéèêëíîïóôúùûœæ]+")

FEATURES = (
    "diversity", "rarity", "rare_share", "connectives", "clauses", "depth", "sentence_words", "longest_sentence",
    "word_chars", "long_words", "syllables", "log_words",
)


def _joined(text: str) -> str:
    """Words cut at line ends in one."""
    return _HYPHEN.sub(r"\1\2", text) if "-\n" in text else text


def words_in(text: str) -> list[str]:
    return _WORD.findall(_joined(text).lower())


class _Numbers(dict):
    """Numbers of words, the reader asked for new ones."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: str) -> int:
        return self.learn(word)


class Reader:
    """Features of texts of one language; what is known of a word is worked out once a task."""

    def __init__(self, lang: str | None, rarity: dict[str, float]):
        self.rarity = rarity
        lists = [CONNECTIVES[(lang or "")[:2].lower()]] if (lang or "")[:2].lower() in CONNECTIVES else CONNECTIVES.values()
        phrases = [p for one in lists for p in one.split(", ")]
        self.single = frozenset(p for p in phrases if " " not in p)
        self.several: dict[str, list[list[str]]] = {}
        for p in sorted((p.split() for p in phrases if " " in p), key=len, reverse=True):
            self.several.setdefault(p[0], []).append(p)
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers(self.learn)
        self.known = np.empty((1024, 7))

    def learn(self, token: str) -> int:
        k = self.number[token] = len(self.number)
        if k == len(self.known):
            self.known = np.concatenate((self.known, np.empty_like(self.known)))
        # bits, rare, connective, letters, long, syllables, and 1 for the end of a sentence or 2 for the beginning of a connective
        bits = self.rarity.get(token, RAREST)
        what = 2 if token in self.several else 0 if token[0].isalpha() else 1
        self.known[k] = bits, bits >= RAREST - 3, token in self.single, len(token), len(token) >= 10, max(1, len(_VOWELS.findall(token))), what
        return k

    def features(self, text: str | None) -> list[float] | None:
        """Feature values of a whole text; None for a text without words."""
        body = _joined(text or "").lower()
        if "(" in body or "—" in body:
            body = _ASIDE.sub(" ", body)
        tokens = _TOKEN.findall(body)
        if len(self.number) > CACHE_WORDS:
            self.clear()
        ids = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        what = self.known[ids, 6]
        spoken = what != 1
        where = np.cumsum(~spoken)[spoken]  # the sentence of each word
        ids = ids[spoken]
        n = len(ids)
        if not n:
            return None
        known = self.known[ids]
        lengths, links = np.bincount(where), np.bincount(where, known[:, 2])
        for at in np.flatnonzero(what == 2).tolist():
            for phrase in self.several[tokens[at]]:
                if tokens[at : at + len(phrase)] == phrase:
                    links[where[int(spoken[:at].sum())]] += 1
                    break
        links, lengths = np.sort(links[lengths > 0]), np.sort(lengths[lengths > 0])
        held, order = len(lengths), ids.tolist()
        window = [len(set(order[k : k + 50])) / min(50, n - k) for k in range(0, max(1, n - 25), 25)]
        total = float(links.sum())
        top = links[-max(1, held // 4) :]
        low = int(0.9 * (held - 1))
        ninth = lengths[low] + (0.9 * (held - 1) - low) * (lengths[min(low + 1, held - 1)] - lengths[low])
        bits, rare, _, letters, long, syllables, _ = (known.sum(0) / n).tolist()
        return [
            sum(window) / len(window), bits, rare, 100.0 * total / n, (body.count(",") + body.count(";") + total) / held,
            float(top.sum()) / len(top), n / held, math.log1p(float(ninth)), letters, long, syllables, math.log1p(n),
        ]


def word_rarity(docs: DataFrame, least_share: float = LEAST_SHARE) -> dict[str, dict[str, float]]:
    """Bits of each word by language over all documents; words of ``least_share`` or less are left to ``RAREST``.

    At most 1 / ``least_share`` words a language have more, so what is sent to the driver is bounded.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str | None, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    counts.setdefault(lang, Counter()).update(words_in(text))
            if sum(map(len, counts.values())) > 200_000:
                yield from flush()
        yield from flush()

    counts = docs.select("text", "lang").mapInArrow(work, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    totals = counts.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    kept = counts.join(F.broadcast(totals), F.equal_null("lang", "of")).where(share > least_share).select("lang", "word", (-F.log2(share)).alias("bits")).collect()
    counts.unpersist()
    bits: dict[str, dict[str, float]] = {}
    for lang, word, b in kept:
        bits.setdefault(lang, {})[word] = b
    return bits


class Ordinal:
    """Proportional-odds regression over standardised features."""

    def __init__(self, grades: int = GRADES, penalty: float = PENALTY):
        self.grades, self.penalty = grades, penalty

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 1500, rate: float = 0.1) -> Ordinal:
        self.centre, self.scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        z = (x - self.centre) / self.scale
        z = np.hstack([z, z**2 - 1])
        seen = np.bincount(y, minlength=self.grades + 1)[1:] + 0.5
        share = np.cumsum(seen)[:-1] / seen.sum()
        cuts = np.log(share / (1 - share))
        beta = np.zeros(z.shape[1])
        params = np.concatenate((beta, [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-3))))
        m, v = np.zeros_like(params), np.zeros_like(params)
        n, k = len(y), z.shape[1]
        for t in range(1, steps + 1):
            beta, cuts = params[:k], params[k] + np.concatenate(([0.0], np.cumsum(np.exp(params[k + 1 :]))))
            score = z @ beta
            edge = np.concatenate(([-np.inf], cuts, [np.inf]))
            up, low = 1 / (1 + np.exp(-(edge[y] - score))), 1 / (1 + np.exp(-(edge[y - 1] - score)))
            p = np.maximum(up - low, 1e-9)
            du, dl = up * (1 - up) / p, low * (1 - low) / p
            g_beta = z.T @ (du - dl) / n + self.penalty * beta / n
            g_cut = np.zeros(self.grades + 1)
            np.add.at(g_cut, y, -du)
            np.add.at(g_cut, y - 1, dl)
            g_cut = g_cut[1 : self.grades] / n
            g_first = g_cut.sum()
            g_step = np.exp(params[k + 1 :]) * (np.cumsum(g_cut[::-1])[::-1][1:])
            grad = np.concatenate((g_beta, [g_first], g_step))
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.beta, self.cuts = params[:k], params[k] + np.concatenate(([0.0], np.cumsum(np.exp(params[k + 1 :]))))
        return self

    def level(self, x: np.ndarray) -> np.ndarray:
        """Expected grade."""
        z = (x - self.centre) / self.scale
        z = np.clip(np.hstack([z, z**2 - 1]), -8, 8)
        below = 1 / (1 + np.exp(-(self.cuts[None, :] - (z @ self.beta)[:, None])))
        return 1 + (1 - below).sum(1)


def reading_levels(docs: DataFrame, labels: DataFrame, label_limit: int = LABEL_LIMIT) -> DataFrame:
    """Level of every document.

    ``docs``: ``doc_id``, ``text``, ``lang``, ``source``.  ``labels``: ``doc_id``, ``grade``
    (nulls ignored; several grades of a document are averaged and rounded).  A text
    without words has a null level; without labels all levels are null; repeated rows
    each have a level.  Result: ``doc_id``, ``lang``, ``source``, ``level``, ``grade``
    (level rounded into 1..12), ``words``.
    """
    context = docs.sparkSession.sparkContext
    rarity = context.broadcast(word_rarity(docs))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str | None, Reader] = {}
        for batch in batches:
            x = []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if lang not in readers:
                    readers[lang] = Reader(lang, rarity.value.get(lang, {}))
                x.append(readers[lang].features(text))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "lang", "source", "x"])

    # every text is read once for all that follows; a document's features are a twelfth of its text or less
    known = cut(docs.select("doc_id", "lang", "source", "text").mapInArrow(read, "doc_id long, lang string, source string, x array<double>"))
    graded = labels.where("grade between 1 and 12").groupBy("doc_id").agg(F.round(F.avg("grade")).cast("int").alias("grade"))
    there = known.where("x is not null").join(graded, "doc_id").withColumn("h", F.xxhash64("doc_id"))
    share = min(1.0, label_limit / max(1, there.count()))
    drawn = there.where(F.pmod("h", F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000))).groupBy("h", "doc_id").agg(F.first("x").alias("x"), F.first("grade").alias("grade"))
    rows = drawn.orderBy("h", "doc_id").limit(label_limit).select("x", "grade").collect()
    model = Ordinal().fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])) if rows else None

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).to_pylist()
            there = [k for k, f in enumerate(x) if f is not None]
            level: list[float | None] = [None] * len(x)
            if model and there:
                for k, v in zip(there, model.level(np.array([x[k] for k in there])), strict=True):
                    level[k] = float(v)
            words = [round(math.expm1(f[-1])) if f else 0 for f in x]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(level, pa.float64()), pa.array([None if v is None else round(v) for v in level], pa.int32()), pa.array(words, pa.int64())],
                ["doc_id", "lang", "source", "level", "grade", "words"],
            )

    return known.mapInArrow(judge, "doc_id long, lang string, source string, level double, grade int, words long")


def profile(levels: DataFrame) -> DataFrame:
    """Documents, words and levels by clean source and language."""
    return levels.groupBy(F.lower(F.trim("source")).alias("source"), "lang").agg(
        F.count("*").alias("documents"),
        F.sum("words").alias("words"),
        F.avg("level").alias("level"),
        F.percentile_approx("level", [0.1, 0.5, 0.9]).alias("deciles"),
    )
