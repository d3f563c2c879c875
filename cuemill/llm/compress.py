"""Per-language raw-content dictionaries for zstandard, and code lengths under them.

Everything that is learned comes from all labelled texts: the shares of characters, the
words whose texts make up the dictionaries (at most ``DICT_BYTES`` a language) and the
leads over rivals are counted in the tasks, and only the counts reach the driver.  Labels
are unreliable, so the texts clean themselves: lexicon terms give a first dictionary of
each language, a text counts only if compression agrees with its label, and a text enters
a dictionary only for the most frequent word that the dictionary so far does not hold.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.labels import code_of, script_of
from cuemill.session import cut

DICT_BYTES = 12_288
DICT_TEXT = 400  # characters of the longest text that may stand for a word in a dictionary
HELD_WORDS = 100_000  # words a task holds before it passes their counts on
ZSTD = {"window_log": 14, "hash_log": 13, "chain_log": 12, "search_log": 2, "min_match": 4, "target_length": 0, "strategy": 2}
LENGTHS = (24, 48, 96, 192)  # bytes of texts whose leads are calibrated apart
LEAD_SHARE = 0.5  # of the lead that 99 in 100 labelled texts of a language and length have
LONG_LEAD = 0.12  # the most asked of texts over the last length, few of which are labelled
_TAGS = re.compile(r"<[^<>]{1,40}>|\{\\[^{}]*\}")
_SPOILT = re.compile("[\u0080-\u009f�-]")
# Blanks, full-width digits and marks that occur in any language.
_EVERYDAY = "\u00a0\u3000\u2009\u202f０１２３４５６７８９♪–—…“”„‘’«»•€£°"
_NON_ASCII = re.compile("[^\x00-\x7f]")
_TERM = re.compile("[\u3040-\u30ff\u3400-\u9fff]{2}|[^\\W\\d_\u3040-\u30ff\u3400-\u9fff]+|[^\x00-\x7f\\w\\s]")  # words, pairs of characters where words are not parted, and marks


class Profiles:
    """Dictionaries of several languages; compressors are made where they are used."""

    def __init__(self, dictionaries: dict[str, bytes], chars: dict[str, float]):
        self.dictionaries, self.chars = dictionaries, chars
        self.scripts: dict[str, list[str]] = defaultdict(list)
        for language, data in sorted(dictionaries.items()):
            self.scripts[script_of(data.decode("utf-8", "ignore")) or "latin"].append(language)
        if "kana" in self.scripts:  # a text in Han alone may be Japanese too
            self.scripts["han"] = sorted({*self.scripts.get("han", []), *self.scripts["kana"]})
        self.all = sorted(dictionaries)
        # for each script a dictionary that knows letters but no language, and the least lead over it by language and length
        self.rivals: dict[str, bytes] = {}
        self.leads: dict[str, list[float]] = {}
        self._made: dict[str, Callable[[bytes], bytes]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": {}}

    def size(self, language: str, data: bytes) -> int:
        """Bytes of ``data`` under a language's dictionary."""
        made = self._made.get(language)
        if made is None:
            made = self._made[language] = compressor(self.dictionaries[language] if language in self.dictionaries else self.rivals[language]).compress
        return len(made(data))

    def rival(self, text: str) -> int | None:
        """Bytes of a text under the dictionary of its script that knows no language."""
        script = f"und-{script_of(text)}"
        return self.size(script, lowered(text).encode("utf-8", "surrogatepass")) if script in self.rivals else None

    def least_lead(self, language: str, data_length: int) -> float:
        own = self.leads.get(language)
        return own[bisect_right(LENGTHS, data_length)] if own else 0.0

    def languages_of(self, text: str) -> list[str]:
        return self.scripts.get(script_of(text) or "", self.all)

    def sizes(self, text: str) -> dict[str, int]:
        data, made = lowered(text).encode("utf-8", "surrogatepass"), self._made
        return {x: len(made[x](data)) if x in made else self.size(x, data) for x in self.languages_of(text)}

    def leads_by(self, language: str, text: str, least: int) -> bool:
        """Whether no other language's dictionary comes within less than ``least`` bytes of this one's."""
        sizes = self.sizes(text)
        own = sizes.pop(language, 1 << 30)
        return own + least <= min(sizes.values(), default=1 << 30)

    def cost(self, text: str) -> int:
        """Least bytes under any dictionary of the text's script."""
        return min(self.sizes(text).values())


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Small tables suit short texts; frames carry no header beyond the least."""
    settings = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_checksum=0, write_content_size=0, write_dict_id=0, **ZSTD)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=data)


def lowered(text: str) -> str:
    """Text in capitals in small letters, as the dictionaries hold running text."""
    return text.lower() if text.isupper() else text


def bare(text: str) -> str:
    return " ".join((_TAGS.sub(" ", text) if "<" in text or "{" in text else text).split())


def _grow(seed: str, ranked: Iterable[tuple[str, str]], limit: int) -> bytes:
    """Texts of the most frequent words, each for a word that none before it holds, until the limit; the most useful content lies last."""
    chosen: list[str] = []
    used, held = len(seed.encode()), set(_TERM.findall(seed))
    for word, text in ranked:
        if word in held:
            continue
        size = len(text.encode()) + 1
        if used + size > limit:
            break
        chosen.append(text)
        used += size
        held.update(_TERM.findall(text))
    return "\n".join([*reversed(chosen), seed]).encode()


def seeds_of(lexicon: DataFrame) -> dict[str, str]:
    """Lexicon terms by language."""
    terms: dict[str, list[str]] = defaultdict(list)
    for lang, term, target, target_term in lexicon.select("lang", "term", "target_lang", "target_term").distinct().orderBy("lang", "term", "target_lang", "target_term").collect():
        for label, text in ((lang, term), (target, target_term)):
            if (code := code_of(label)) and text:
                terms[code].append(text)
    return {code: "\n".join(dict.fromkeys(x)) for code, x in terms.items()}


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


_LABELLED = pa.schema([("code", pa.string()), ("text", pa.string()), ("own", pa.bool_())])


def labelled(cues: DataFrame, seeds: dict[str, str]) -> DataFrame:
    """Every labelled text once: ``code``, ``text``, ``own``, whether the lexicon's dictionaries agree with the label, and ``n``, the rows that hold it.

    Null labels and texts, unknown labels, texts of fewer than 4 characters and texts with lost or control characters are left out.
    """
    usable = cues.where("length(text) >= 4 and language <> ''").select("text", "language")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = Profiles({k: v.encode() for k, v in seeds.items()} or {"und": b"\n"}, {})
        for batch in batches:
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (code := code_of(label)) and not _SPOILT.search(text):
                    text = bare(text)
                    out.append((code, text, code not in seeds or first.leads_by(code, text, 0)))
            yield _frame(out, _LABELLED)

    return cut(usable.mapInArrow(work, "code string, text string, own boolean").groupBy("code", "text", "own").agg(F.count("*").alias("n")))


def _counted(texts: DataFrame, keys: Callable[[str, str, bool], Iterable[tuple]], schema: str, by: str = "1L") -> DataFrame:
    """The sum of ``by`` by the ``keys`` of (code, text, own); ``schema`` is that of a key."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32()}
    arrow = pa.schema([*((x.split()[0], types[x.split()[1]]) for x in schema.split(", ")), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for *row, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for key in keys(*row):
                    counts[key] += n
            if len(counts) > HELD_WORDS:
                yield _frame([(*k, n) for k, n in counts.items()], arrow)
                counts.clear()
        yield _frame([(*k, n) for k, n in counts.items()], arrow)

    return texts.select("code", "text", "own", F.expr(by)).mapInArrow(work, f"{schema}, n long").groupBy(*names).agg(F.sum("n").alias("n"))


class Letters:
    """Characters of all texts of each language: how many rows hold each, and which are common."""

    def __init__(self, texts: DataFrame, seeds: dict[str, str], least_share: float):
        def keys(code: str, text: str, own: bool) -> Iterator[tuple[str, str]]:
            yield code, "all"
            if own:
                yield code, "own"
                if not text.isascii():
                    for c in set(_NON_ASCII.findall(text)):
                        yield code, c

        seen: dict[str, dict[str, int]] = defaultdict(dict)
        for code, c, n in _counted(texts, keys, "code string, c string", "n").collect():
            seen[code][c] = n
        self.codes = sorted({*seeds, *(code for code, own in seen.items() if own["all"] >= 20)})
        self.common: dict[str, dict[str, int]] = {}  # by language, with the whole bits of their shares
        self.enough: dict[str, float] = {}
        self.shares: dict[str, float] = {}
        for code in self.codes:
            own = {c: n for c, n in seen.get(code, {}).items() if len(c) == 1}
            total = seen.get(code, {}).get("own", 0)
            enough = 2 + least_share * total
            self.enough[code] = least_share * total
            self.common[code] = {c: int(math.log2(total / n)) for c, n in own.items() if n >= enough}
            for c in self.common[code]:
                self.shares[c] = max(self.shares.get(c, 0.0), own[c] / total)
            for c in set(_NON_ASCII.findall(seeds.get(code, ""))):
                self.shares.setdefault(c, 0.003)
        for c, p in list(self.shares.items()):  # capitals of everyday letters are everyday too
            if len(c.upper()) == 1:
                self.shares.setdefault(c.upper(), p / 4)
        for c in _EVERYDAY:
            self.shares.setdefault(c, 0.004)

    def bits(self) -> dict[str, float]:
        return {c: math.log2(1 / max(p, 1e-6)) for c, p in self.shares.items()}


_WORDS = pa.schema([("code", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("h", pa.int64()), ("text", pa.string())])


def dictionaries(texts: DataFrame, seeds: dict[str, str], letters: Letters, dict_bytes: int = DICT_BYTES) -> tuple[dict[str, bytes], dict[str, list[str]]]:
    """Dictionaries, and words by rank, of all texts whose ``own`` is true and that hold common characters only.

    Words are ranked by the texts that hold them, and rarer ones than characters may be stay
    out; of those texts one of the most common characters, and of least hash, stands for the word.
    """
    common = letters.common

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple[str, str], list] = {}
        for batch in batches:
            for code, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if code not in common:
                    continue
                bits = [common[code].get(c, -1) for c in _NON_ASCII.findall(text)]
                if bits and min(bits) < 0:
                    continue
                own = (max(bits, default=0) << 32 | crc32(text.encode()), text) if len(text) <= DICT_TEXT else (1 << 62, None)
                for word in set(_TERM.findall(text)):
                    known = words.get((code, word))
                    if known is None:
                        words[code, word] = [1, *own]
                    else:
                        known[0] += 1
                        if own[0] < known[1]:
                            known[1:] = own
            if len(words) > HELD_WORDS:
                yield _frame([(*k, *v) for k, v in words.items()], _WORDS)
                words.clear()
        yield _frame([(*k, *v) for k, v in words.items()], _WORDS)

    found = texts.select("code", "text").mapInArrow(work, "code string, word string, n long, h long, text string")
    counts = found.groupBy("code", "word").agg(F.sum("n").alias("n"), F.min(F.when(F.col("text").isNotNull(), F.struct("h", "text")))["text"].alias("text")).where("text is not null")
    # a word takes two bytes of a dictionary or more, so words of a later rank cannot enter it
    rank = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "word"))
    ranked: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for code, word, text, n in counts.withColumn("rank", rank).where(F.col("rank") <= dict_bytes // 2).orderBy("code", "rank").select("code", "word", "text", "n").collect():
        if n >= letters.enough[code]:
            ranked[code].append((word, text))
    return {code: _grow(seeds.get(code, ""), ranked[code], dict_bytes) for code in letters.codes}, {code: [word for word, _ in own] for code, own in ranked.items()}


def build(texts: DataFrame, seeds: dict[str, str], least_share: float, clear: str = "own") -> tuple[Profiles, dict[str, frozenset[str]]]:
    """Profiles of all texts of ``labelled``, and what is usual outside ASCII; a text with a character in less than ``least_share`` of its language's texts stays out.

    ``clear`` names the column that tells which texts may enter the dictionaries.
    Without any text the dictionaries hold the lexicon only, and with neither there is
    one empty dictionary named ``und``.  Usual are words, and marks and letters of scripts
    that no single-byte charset yields, in ``least_share`` of the texts or more.
    """
    letters = Letters(texts, seeds, least_share)
    made, words = dictionaries(texts.where(clear), seeds, letters)
    usual = {
        code: frozenset([*(w for w in words.get(code, ()) if w[0].isalnum() and not w.isascii()), *(c for c in own if c in _EVERYDAY or c >= "\u0900" and unicodedata.category(c)[0] in "LMNP")])
        for code, own in letters.common.items()
    }
    return Profiles(made or {"und": b"\n"}, letters.bits()), usual


def is_usual(text: str, known: frozenset[str]) -> bool:
    """Whether all that a text holds outside ASCII is among what is usual."""
    return text.isascii() or all(w.isascii() or w in known for w in _TERM.findall(text)) and known.issuperset(_NON_ASCII.findall(_TERM.sub("", text)))


def calibrate(profiles: Profiles, texts: DataFrame) -> Profiles:
    """Add rivals of mixed letters and the leads over them that all labelled texts of each language have by length."""
    mixed: dict[str, list[str]] = defaultdict(list)
    for script, languages in profiles.scripts.items():
        for language in languages:
            letters = list(profiles.dictionaries[language].decode("utf-8", "ignore"))
            random.Random(language).shuffle(letters)
            mixed[f"und-{script}"].append("".join(letters[: len(letters) // len(languages)]))
    profiles.rivals = {k: "".join(v).encode() or b"\n" for k, v in mixed.items()}

    def keys(code: str, text: str, own: bool) -> Iterator[tuple[str, int, int, int]]:
        if code in profiles.dictionaries and code in profiles.languages_of(text) and (rival := profiles.rival(text)):
            data = lowered(text).encode("utf-8", "surrogatepass")
            yield code, bisect_right(LENGTHS, len(data)), rival, profiles.size(code, data)

    # sizes are whole bytes, so there are few different leads however many texts there are
    found: dict[tuple[str, int], list[tuple[float, int]]] = defaultdict(list)
    for code, length, rival, size, n in _counted(texts, keys, "code string, length int, rival int, size int").collect():
        found[code, length].append(((rival - size) / rival, n))
    for language in profiles.all:
        asked = [LEAD_SHARE * max(0.0, _hundredth(found[language, k])) for k in range(len(LENGTHS) + 1)]
        asked[-1] = min(asked[-1] or LONG_LEAD, LONG_LEAD) if any(asked) else 0.0
        profiles.leads[language] = asked
    return profiles


def _hundredth(leads: list[tuple[float, int]]) -> float:
    """The lead that 99 in 100 texts have; 0 for fewer than 20 texts."""
    total = sum(n for _, n in leads)
    below = total // 100
    for lead, n in sorted(leads) if total >= 20 else ():
        if below < n:
            return lead
        below -= n
    return 0.0
