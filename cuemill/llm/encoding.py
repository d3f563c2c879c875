"""Text that was written or read with a wrong encoding.

Chains of "written as one charset, read as another" are undone, wholly or in part, and
every candidate is compressed with the per-language dictionaries; the chain of least
description length, its own cost included, wins.
A candidate is compressed only if its characters are likelier than those it replaces
(an order-0 code length, the cheap bound before the real one).  Texts of everyday
characters are no exception: readings are passed over unseen only where no bytes of the
text form a sequence they could undo, or where no result could be that much likelier.
Where no chain pays, bytes that are lost may have been part of one: replacement characters,
and first bytes of UTF-8 sequences whose rest is gone.  Such a text counts as garbled, beyond
repair, if leaving them out or filling them in pays under the same dictionaries.  Any other
text is left unchanged, letters of languages without a dictionary included.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from cuemill.llm.compress import Profiles, build, calibrate, is_usual, labelled, lowered, seeds_of
from cuemill.session import cut

# Charset a text was wrongly read as -> charsets it may have been written in.
READINGS = {
    "cp1252": ("utf-8", "cp1251", "koi8-r", "gb18030", "cp932", "euc_jp", "mac_roman", "cp850", "big5", "cp866"),
    "mac_roman": ("utf-8", "cp1252"),
    "cp437": ("utf-8", "cp1252"),
    "cp850": ("utf-8", "cp1252"),
    "cp1251": ("utf-8", "cp1252", "koi8-r"),
    "koi8-r": ("utf-8", "cp1251"),
    "cp866": ("utf-8", "cp1251"),
    "gb18030": ("utf-8",),
    "cp932": ("utf-8",),
    "euc_jp": ("utf-8",),
    "big5": ("utf-8",),
}
MULTIBYTE = {"gb18030", "cp932", "euc_jp", "big5"}
STEP_COST = 2
CUT_COST = 2
MAX_STEPS = 3
LEAST_GAIN = 4
BIT_WEIGHT = 1 / 6
LOST_COST = 2
LOST = "�"
RARE_BITS = 14.0

_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_PRIVATE = re.compile("[\ue000-\uf8ff]")
_LOST_OR_PRIVATE = re.compile("[�]")
_HIGH = re.compile("[^\x00-\x7f]")
_TWO_HIGH = re.compile("[^\x00-\x7f]{2}")
_TRACE = re.compile("[\u3400-\u9fff\uf900-\ufaff\uff61-\uff9f\ue000-\uf8ff\ufffd\U00020000-\U0002ffff]")
_HIGH_BYTES = bytes(range(128, 256))
_BROKEN = re.compile("[\u0080-\u009f�-]")
# first bytes of UTF-8 sequences, read as cp1252 or mac_roman, without the rest, and the characters they are
_ORPHANS = re.compile("[Ã√ƒ≈âЂ]")
_ORPHAN = re.compile("(?:(?:(?<=[a-zß-öø-ÿ])Ã|[√ƒ≈])(?![\u00a0-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u2013-\u203a])|[âЂ](?![^\\W\\d_])|(?<![^\\W\\d_])â)")
_SYMBOLS = frozenset(map(chr, [*range(0xA1, 0xAA), *range(0xAB, 0xB7), *range(0xB8, 0xBA), *range(0xBB, 0xC0), 0xD7, 0xF7, 0x2020, 0x2021, 0x2030, *range(0x2190, 0x2300), *range(0x2500, 0x25A0)]))
_INWORD = re.compile("(?<=[^\\W\\d_])[" + "".join(sorted(_SYMBOLS)) + "]+(?=[^\\W\\d_])")
_CYRILLIC = {"cp1251", "koi8-r", "cp866"}
_WORD = re.compile(r"\S+")
_WORD_EDGE = re.compile(r"\b")
# a capital inside a word, but for names such as McÉwan
_RISE = re.compile(r"[a-zß-öø-ÿ][À-ÖØ-Þ](?:(?![a-z])|(?<!\b[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ][À-ÖØ-Þ])(?<!\b[A-ZÀ-ÖØ-Þ][a-z][a-zß-öø-ÿ][À-ÖØ-Þ]))|[а-яё][А-ЯЁ]")
# what a rise, or a symbol in a word, cannot be without
_MAYBE_RISE, _MAYBE_INWORD = re.compile("[À-ÖØ-ÞА-ЯЁ](?<=[a-zß-öø-ÿа-яё].)"), re.compile("[" + "".join(sorted(_SYMBOLS)) + "](?<=[^\\W\\d_].)")
_CAPITALS = frozenset(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF), *range(0x410, 0x430), 0x401]))
_THIN = re.compile("\u00e2([\u00a0-\u00bf])")
_MIXED = re.compile(
    "[A-Za-zÀ-ɏ][Ѐ-ԯऀ-ॿ぀-ヿ一-鿿]|[Ѐ-ԯऀ-ॿ぀-ヿ一-鿿][A-Za-zÀ-ɏ]"
)


def _high(text: str) -> list[str]:
    """The characters outside ASCII."""
    return [c for c in text if c > "\x7f"]


@lru_cache(maxsize=16)
def _to_byte(charset: str) -> dict[str, int]:
    """Characters of a single-byte charset, unassigned bytes as the control characters browsers take them for."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            pass
    if charset == "cp1252":
        for b in range(128, 256):
            table.setdefault(chr(b), b)
    return table


@lru_cache(maxsize=16)
def _to_latin(charset: str) -> dict[int, str]:
    """The same table for ``str.translate``, bytes as the characters of equal number."""
    return {ord(c): chr(b) for c, b in _to_byte(charset).items()}


@lru_cache(maxsize=16)
def _all_to_latin(charset: str) -> dict[int, str]:
    """The same table, where every other character of Latin-1 becomes one that is not of it."""
    return {b: "\uffff" for b in range(128, 256)} | _to_latin(charset)


@lru_cache(maxsize=4096)
def _utf8_alone(char: str) -> bool:
    """Whether the bytes of one character in some multibyte charset hold a valid UTF-8 sequence."""
    return any(_UTF8.search(char.encode(x, "ignore")) for x in MULTIBYTE)


@lru_cache(maxsize=64)
def _bytes_of(text: str, charset: str) -> bytes | None:
    """The bytes of a text that lies wholly in a single-byte charset."""
    try:
        return text.translate(_all_to_latin(charset)).encode("latin-1")
    except UnicodeEncodeError:
        return None


@lru_cache(maxsize=16)
def _sequence(charset: str) -> re.Pattern:
    """Characters that stand for a valid UTF-8 sequence of two bytes or more, as ``_UTF8`` has them in bytes."""
    table = _to_byte(charset)
    among = lambda a, b: "".join(c for c, x in table.items() if a <= x <= b)
    tail = (0x80, 0xBF)
    forms = [
        ((0xC2, 0xDF), tail), ((0xE0, 0xE0), (0xA0, 0xBF), tail), ((0xE1, 0xEC), tail, tail), ((0xED, 0xED), (0x80, 0x9F), tail), ((0xEE, 0xEF), tail, tail),
        ((0xF0, 0xF0), (0x90, 0xBF), tail, tail), ((0xF1, 0xF3), tail, tail, tail), ((0xF4, 0xF4), (0x80, 0x8F), tail, tail),
    ]
    return re.compile("|".join("".join(f"[{re.escape(among(*x))}]" for x in form) for form in forms if all(among(*x) for x in form)))


@lru_cache(maxsize=16)
def _ends(charset: str) -> tuple[frozenset[str], frozenset[str]]:
    """Characters that may stand for the first byte of a UTF-8 sequence, and for a later one."""
    table = _to_byte(charset)
    return frozenset(c for c, x in table.items() if 0xC2 <= x <= 0xF4), frozenset(c for c, x in table.items() if x <= 0xBF)


@lru_cache(maxsize=16)
def _pair_of(charset: str) -> re.Pattern:
    """A character of a single-byte charset outside ASCII with the one after it."""
    return re.compile(f"[{re.escape(''.join(_to_byte(charset)))}][\x00-\x7f]?")


@lru_cache(maxsize=16)
def _two_of(charset: str) -> re.Pattern:
    """Two characters of a single-byte charset outside ASCII."""
    return re.compile(f"[{re.escape(''.join(_to_byte(charset)))}]{{2}}")


@lru_cache(maxsize=16)
def _span(charset: str) -> re.Pattern:
    return re.compile("[\x00-\x7f" + re.escape("".join(_to_byte(charset))) + "]+")


def _decode(data: bytes, charset: str) -> str | None:
    if charset != "utf-8":
        try:
            return data.decode(charset)
        except UnicodeDecodeError:
            # a cut text may lack its last byte
            try:
                return data[:-1].decode(charset) + LOST
            except UnicodeDecodeError:
                return None
    return data.decode("utf-8", "replace")


def _undo(text: str, read: str, written: str) -> str | None:
    """Undo one wrong reading in all of the text that can have gone through it."""
    if read in MULTIBYTE:
        try:
            data = _LOST_OR_PRIVATE.sub("", text).encode(read)
        except UnicodeEncodeError:
            if read != "cp932" and read != "gb18030":
                return None
            data = text.encode(read, "replace")
            if data.count(b"?") > text.count("?") + text.count(LOST) + len(_PRIVATE.findall(text)):
                return None
        high = len(data) - len(data.translate(None, _HIGH_BYTES))
        if not high or not _UTF8.search(data):
            return None
        back = data.decode("utf-8", "replace")
        if back.count(LOST) > 0.25 * high / 2:
            return None
        return back
    if written != "utf-8" and (data := _bytes_of(text, read)) is not None:
        return _decode(data, written) or text
    table = _to_latin(read)

    def span(m: re.Match) -> str:
        part = m.group()
        if part.isascii():
            return part
        data = part.translate(table).encode("latin-1", "replace")
        if written == "utf-8":
            out, at = [], 0
            for x in _UTF8.finditer(data):
                out += [part[at : x.start()], x.group().decode("utf-8")]
                at = x.end()
            return "".join([*out, part[at:]])
        back = _decode(data, written)
        return part if back is None else back

    return _span(read).sub(span, text)


def _undo_thinned(text: str) -> str:
    """UTF-8 read as a single-byte charset whose control characters were then dropped: three-byte marks lost their middle."""
    for middle in (0x80, 0x82):
        text = _THIN.sub(lambda m: _sure(bytes([0xE2, middle, ord(m.group(1))]), m.group()), text)
    return text


def _sure(data: bytes, otherwise: str) -> str:
    char = data.decode("utf-8", "replace")
    return char if char in _THIN_MARKS else otherwise


# Marks whose UTF-8 form begins with E2 80 or E2 82.
_THIN_MARKS = "…‐‑‒–—‘’‚“”„†‡•‰‹›€"


class _Pairs(dict):
    """Bits that a character between ASCII can lose, with the one after it, if cp1252 was written in a multibyte charset."""

    def __init__(self, chars: dict[str, float], written: str):
        self.chars, self.written = chars, written

    def __missing__(self, pair: str) -> float:
        own, b = self.chars.get(pair[0], RARE_BITS), _to_byte("cp1252").get(pair[0])
        if b is None:
            gain = 0.0
        elif self.written == "gb18030" and pair[1:].isdigit():  # may be half of four bytes
            gain = 1e9
        else:
            try:
                back = bytes([b, *pair[1:].encode()]).decode(self.written)
                gain = max(0.0, own - sum([self.chars.get(c, RARE_BITS) for c in back if c > "\x7f"]))
            except UnicodeDecodeError:
                gain = max(0.0, own - RARE_BITS)  # stays, or is the last byte of a cut text
        self[pair] = gain
        return gain


class _Sequences(dict):
    """Bits that the characters of a valid UTF-8 sequence lose if it is undone."""

    def __init__(self, chars: dict[str, float], read: str):
        self.chars, self.read = chars, read

    def __missing__(self, sequence: str) -> float:
        table = _to_byte(self.read)
        back = bytes([table[c] for c in sequence]).decode("utf-8")
        self[sequence] = gain = sum([self.chars.get(c, RARE_BITS) for c in sequence]) - sum([self.chars.get(c, RARE_BITS) for c in back if c > "\x7f"])
        return gain


class Mender:
    """Restores one text at a time under fitted profiles."""

    def __init__(self, profiles: Profiles):
        self.profiles = profiles
        common = "".join(re.escape(c) for c, bits in profiles.chars.items() if bits < 13.5)
        self.rare = re.compile(f"[^\x00-\x7f{common}]")
        self.common = frozenset(c for c, bits in profiles.chars.items() if bits < 13.5)
        self.empty = min(profiles.size(x, b"") for x in profiles.all)
        self.odd = re.compile(f"{self.rare.pattern}|{_RISE.pattern}|{_INWORD.pattern}")
        # letters whose UTF-8 form begins with C3, C4 or C5
        self.fills = [c for c in map(chr, range(0xC0, 0x180)) if c.isalpha() and c.islower() and c in profiles.chars]
        self.gains = {(read, written): self.gain(read, written) for read, writings in READINGS.items() for written in writings if read not in MULTIBYTE and written not in MULTIBYTE and written != "utf-8"}

        self.ups = {pair: {c: g for c, g in gains.items() if g > 0} for pair, gains in self.gains.items()}
        self.pairs = {written: _Pairs(profiles.chars, written) for written in READINGS["cp1252"] if written in MULTIBYTE}
        self.sequences = {read: _Sequences(profiles.chars, read) for read in READINGS if read not in MULTIBYTE}
        # characters whose byte stands for nothing, so that all around them stays
        self.holes = {pair: frozenset(c for c in _to_byte(pair[0]) if c > "\x7f" and c not in gains) for pair, gains in self.gains.items()}
        # the charsets and gains that each character has a part in, as bits of a number
        self.parts: dict[str, int] = {}
        for k, chars in enumerate([*(_to_byte(read) for read in READINGS if read not in MULTIBYTE), *self.ups.values()]):
            for c in chars:
                self.parts[c] = self.parts.get(c, 0) | 1 << k
        # texts share few accents, alphabets and words
        self.readings_of, self.mend = lru_cache(10_000)(self._readings_of), lru_cache(5_000)(self._mend)
        self.is_garbled, self.cost_of = lru_cache(50_000)(self._is_garbled), lru_cache(20_000)(self.cost)
        self.bits_of = lru_cache(1_000)(self.bits)
        self.likelier, self.pays_by = lru_cache(100_000)(self._likelier), lru_cache(50_000)(self._pays)
        self.most: dict[str, float] = {}
        for gains in self.ups.values():
            for c, g in gains.items():
                self.most[c] = max(g, self.most.get(c, 0.0))

    def bits(self, text: str, high: list[str] | None = None) -> float:
        """Order-0 code length of what is not ASCII, with surcharges for what sound text does not hold."""
        if high is None:
            high = _high(text)
        if not high:
            return 0.0
        get = self.profiles.chars.get
        total = sum([get(c, RARE_BITS) for c in high])
        if (len(high) > 1 or total >= RARE_BITS) and (min(high) < "\xa0" or max(high) >= "\ue000"):
            total += (40.0 - RARE_BITS) * len(_BROKEN.findall(text))
        if not _SYMBOLS.isdisjoint(high) and _MAYBE_INWORD.search(text):
            total += 12.0 * len(_INWORD.findall(text))
        if not _CAPITALS.isdisjoint(high) and _MAYBE_RISE.search(text):
            total += 12.0 * len(_RISE.findall(text))
        return total

    def gain(self, read: str, written: str) -> dict[str, float]:
        """Bits each character would lose if read anew; below 0 where it would gain."""
        get, gains = self.profiles.chars.get, {}
        for c, b in _to_byte(read).items():
            back = bytes([b]).decode(written, "replace")
            if c > "\x7f" and back != LOST:
                gains[c] = get(c, RARE_BITS) - (get(back, RARE_BITS) if back > "\x7f" else 0.0)
        return gains

    def is_odd(self, text: str, high: list[str]) -> bool:
        """Whether ``odd`` finds anything; ``high`` are the characters outside ASCII."""
        if not self.common.issuperset(high):
            return True
        if not _SYMBOLS.isdisjoint(high) and _MAYBE_INWORD.search(text) and _INWORD.search(text):
            return True
        return not _CAPITALS.isdisjoint(high) and bool(_MAYBE_RISE.search(text) and _RISE.search(text))

    def _readings_of(self, parts: int) -> list[tuple[str, str, str, dict]]:
        """Every reading that characters with some ``parts`` may have come from, with its kind and gains."""
        out, single = [], [read for read in READINGS if read not in MULTIBYTE]
        place = {pair: len(single) + k for k, pair in enumerate(self.ups)}
        for read, writings in READINGS.items():
            if read in MULTIBYTE:
                out += [(read, written, "many", {}) for written in writings]
            elif parts >> single.index(read) & 1:
                for written in writings:
                    gains = self.ups.get((read, written))
                    if gains is None:
                        out.append((read, written, "utf-8" if written == "utf-8" else "two" if written == "euc_jp" else "any", {}))
                    elif parts >> place[read, written] & 1:
                        out.append((read, written, "single", gains))
        return out

    def _likelier(self, word: str) -> dict[tuple[str, str], float]:
        """The readings between single-byte charsets that a word would be likelier by, and the bits it loses."""
        high = _high(word)
        rises = 12.0 * len(_RISE.findall(word)) if not _CAPITALS.isdisjoint(high) else 0.0
        if not rises and self.most.keys().isdisjoint(high):
            return {}
        return {pair: bits for pair, gains in self.gains.items() if (bits := sum([gains.get(c, 0.0) for c in high]) + rises) > 0}

    def open_readings(self, text: str, more: float, high: list[str], odd: bool = True) -> list[tuple[str, str]]:
        """Every reading but those that have nothing to undo or cannot make the text likelier by enough, whole or in part.

        ``more`` are the bits that may go besides the characters' own.  Of a text that is not ``odd``, parts are words; where all that are likelier are so by too little, so are several and the text.
        """
        parts = 0
        for c in set(high):
            parts |= self.parts.get(c, 0)
        able = [c for c in high if c in self.most]  # to become likelier
        single = more + sum([self.most[c] for c in able]) > LEAST_GAIN
        two = _TWO_HIGH.search(text) or LOST in text
        # the first bytes of UTF-8 sequences (C2 to F4) read as ideographs or half-width kana in every multibyte charset, or not at all
        many = max(high) >= "\u3400" and _TRACE.search(text) and (two or any(map(_utf8_alone, high)))
        beside = two and _two_of("cp1252").search(text)
        apart = None
        likelier = None
        if single and not odd and more < LEAST_GAIN / 2:
            likelier = {}
            for w in text.split():
                if not w.isascii():
                    for pair, bits in self.likelier(w).items():
                        likelier[pair] = likelier.get(pair, 0.0) + bits
            likelier = {pair for pair, bits in likelier.items() if more + bits > LEAST_GAIN - 1e-6 or not self.holes[pair].isdisjoint(high)}
        out = []
        for read, written, kind, gains in self.readings_of(parts):
            if kind == "single":
                if single and (likelier is None or (read, written) in likelier) and more + sum([gains[c] for c in able if c in gains]) > LEAST_GAIN:
                    out.append((read, written))
            elif kind == "many":
                if many:
                    out.append((read, written))
            elif kind == "any":
                if apart is None and not beside:
                    apart = _pair_of("cp1252").findall(text)  # every character begins anew there
                if beside or more + sum(map(self.pairs[written].__getitem__, apart)) > LEAST_GAIN:
                    out.append((read, written))
            elif kind == "two":  # EUC-JP has no ASCII in its pairs
                if beside:
                    out.append((read, written))
            elif two and not any(x.isdisjoint(high) for x in _ends(read)) and (found := _sequence(read).findall(text)) and more + sum(map(self.sequences[read].__getitem__, found)) > LEAST_GAIN - 1e-6:
                out.append((read, written))
        return out

    def words(self, text: str, read: str, written: str, least: float = 0.0) -> tuple[int, int] | None:
        """The run of words that gains most bits if read anew, and more than ``least``."""
        gains, where = self.gains[read, written], None
        best = sum_ = 0.0
        start = 0
        for m in _WORD.finditer(text):
            high = () if m.group().isascii() else _high(m.group())
            if sum_ <= 0:
                sum_, start = 0.0, m.start()
            if high:
                sum_ += sum([gains.get(c, 0.0) for c in high]) + (12.0 * len(_RISE.findall(m.group())) if not _CAPITALS.isdisjoint(high) else 0.0)
            if sum_ > best:
                best, where = sum_, (start, m.end())
        return where if best > least else None

    def candidates(self, text: str) -> Iterator[tuple[str, str, int]]:
        """Whole-text candidates first; parts only where those leave rare characters, or by words where there are none."""
        high = _high(text)
        bits, solved = self.bits(text, high), False
        if bits <= LEAST_GAIN:
            return
        more = bits - sum([self.profiles.chars.get(c, RARE_BITS) for c in high])
        odd = self.is_odd(text, high) if more > 6.0 else not self.common.issuperset(high)  # rises and symbols in words cost more
        readings = self.open_readings(text, more, high, odd)
        for read, written in readings:
            gains = self.gains.get((read, written))
            if gains is not None and more + sum([gains.get(c, 0.0) for c in high]) <= LEAST_GAIN:
                continue  # read anew as a whole it is not likelier by enough
            back = _undo(text, read, written)
            if back is not None and back != text and self.plausible(back, bits) and (odd or written == "utf-8" or self.pays(text, back, STEP_COST)):
                solved |= not self.odd.search(back) and not _MIXED.search(back)
                yield back, f"{read}>{written}", STEP_COST
        back = _undo_thinned(text) if "\u00e2" in text else text
        if back != text and self.plausible(back, bits):
            yield back, "cp1252-thinned>utf-8", STEP_COST + 1
        if not odd:
            for read, written in readings:
                # a run that gains no more than this is not plausible when read anew, if all of it can be
                least = LEAST_GAIN - more - 1e-6 if (holes := self.holes.get((read, written))) is not None and holes.isdisjoint(high) else 0.0
                if holes is not None and (where := self.words(text, read, written, least)) and where != (0, len(text)):
                    a, b = where
                    whole = text[:a] + (_undo(text[a:b], read, written) or text[a:b]) + text[b:]
                    if whole != text and self.plausible(whole, bits) and self.pays(text, whole, STEP_COST + CUT_COST):
                        yield whole, f"{read}>{written}@{a}-{b}", STEP_COST + CUT_COST
            return
        if solved:
            return
        at = [(m.end() - 1 if len(m.group()) > 1 else m.start()) for m in self.odd.finditer(text)]
        near_starts = {0} | {max(0, at[0] - k) for k in range(4)}
        near_ends = {len(text)} | {min(len(text), at[-1] + 1 + k) for k in range(5)}
        words = [m.start() for m in _WORD_EDGE.finditer(text)]
        far_ends = near_ends | {x for x in words if x > at[-1]}
        places = [m.start() for m in _HIGH.finditer(text)]
        starts, ends = sorted(near_starts), {True: sorted(far_ends), False: sorted(near_ends)}
        for read, writings in READINGS.items():
            for written in writings:
                if written == "utf-8" and read not in MULTIBYTE:
                    continue  # valid sequences are found wherever they lie
                if read in MULTIBYTE and not any(_UTF8.search(x.encode(read, "replace")) for x in (text, _LOST_OR_PRIVATE.sub("", text))):
                    continue  # nor has any part a sequence
                gains = self.gains.get((read, written))
                up_to = None
                if gains is not None and self.holes[read, written].isdisjoint(high):
                    up_to = [0.0, *accumulate(gains.get(c, 0.0) for c in high)]
                done: dict[tuple[int, int, int], str | None] = {}
                for a in starts:
                    first = bisect_left(places, a)
                    for b in ends[read in _CYRILLIC]:
                        if a == 0 and b == len(text):
                            continue
                        last = bisect_left(places, b)
                        if first == last or up_to and more + up_to[last] - up_to[first] <= LEAST_GAIN - 1e-6:
                            continue  # nothing to undo, or not likelier by enough
                        # ASCII before and after stays as it is, but for what may end a character of several bytes
                        key = first, last, min(b - places[last - 1], 3) if written in MULTIBYTE else 0
                        if key not in done:
                            back = _undo(text[a:b], read, written)
                            whole = None if back is None or back == text[a:b] else text[:a] + back + text[b:]
                            done[key] = whole if whole is not None and self.plausible(whole, bits) else None
                        if done[key] is not None:
                            yield done[key], f"{read}>{written}@{a}-{b}", STEP_COST + CUT_COST

    def pays(self, text: str, back: str, price: int) -> bool:
        """Whether the words that differ pay on their own: one letter is less than the chance in the size of a whole frame."""
        old, new = text.split(), back.split()
        while old and new and old[0] == new[0]:
            del old[0], new[0]
        while old and new and old[-1] == new[-1]:
            del old[-1], new[-1]
        return self.pays_by(" ".join(old), " ".join(new), price)

    def _pays(self, old: str, new: str, price: int) -> bool:
        most = self.cost_of(old) - price
        return self.least(new) < most and self.cost(new) < most

    def plausible(self, text: str, bits: float) -> bool:
        high = _high(text)
        get = self.profiles.chars.get
        if sum([get(c, RARE_BITS) for c in high]) >= bits - LEAST_GAIN:
            return False
        return self.bits_of(text) < bits - LEAST_GAIN and len(_MIXED.findall(text)) <= 4

    def least(self, text: str) -> float:
        """What ``cost`` cannot fall below: all but the frame, of which only the least size is known."""
        text = text.replace("\xa0", " ")
        escapes = len(self.rare.findall(text)) + 4 * len(_MIXED.findall(text))
        return self.empty + escapes + self.bits_of(lowered(text)) * BIT_WEIGHT

    def cost(self, text: str) -> float:
        """Bytes under the best dictionary; whole bytes are too coarse for one character, so order-0 bits refine them."""
        least = self.least(text)
        text = text.replace("\xa0", " ")  # a fixed blank says no more than a blank
        size = self.profiles.cost(text)
        if lowered(text) is not text:  # dictionaries may hold capitals too
            data = text.encode("utf-8", "surrogatepass")
            size = min(size, *(self.profiles.size(x, data) for x in self.profiles.languages_of(text)))
        return size - self.empty + least

    def _is_garbled(self, text: str | None) -> bool:
        """What ``mend`` tells first, without the steps that only the restored text asks for."""
        if not text or text.isascii():
            return False
        now = unicodedata.normalize("NFC", text)
        found = {c: price for c, _, price in self.candidates(now)}
        if found:
            base = self.cost(now)
            for bound, c, price in sorted((self.least(c) + price, c, price) for c, price in found.items()):
                if bound >= base:
                    break
                if self.cost(c) + price < base:
                    return True
        return self.lost(now)

    def _mend(self, text: str | None) -> tuple[bool, str | None, str | None]:
        """(garbled, restored text or None, chain)."""
        if not text or text.isascii():
            return False, None, None
        now, chain = unicodedata.normalize("NFC", text), []
        start = now
        for _ in range(MAX_STEPS):
            found = {c: (how, price) for c, how, price in self.candidates(now)}
            ranked = sorted((self.least(c) + price, self.bits_of(c), c, how, price) for c, (how, price) in found.items())
            if not ranked:
                break
            base = self.cost(now)
            best = None
            for bound, _, text_, how, price in ranked:
                if bound >= (best[0] if best else base):
                    break  # no later one can cost less
                cost = self.cost(text_) + price
                if cost < base and (best is None or cost < best[0]):
                    best = (cost, text_, how)
            if best is None:
                break
            now = best[1]
            chain.append(best[2])
        if chain:
            return True, (now if LOST not in now else None), " ".join(chain)
        return self.lost(start), None, None

    def lost(self, text: str) -> bool:
        """Whether it pays to take characters for what is left of lost bytes."""
        if LOST in text:
            return self.cost(text.replace(LOST, "")) + LOST_COST < self.cost(text)
        orphans = _ORPHANS.search(text) and set(_ORPHAN.findall(text))
        if not orphans:
            return False
        here = self.cost(text)
        for orphan in orphans:
            fills = _THIN_MARKS if orphan in "âЂ" else self.fills
            for fill in fills:
                filled = _ORPHAN.sub(lambda m, o=orphan, f=fill: f if m.group() == o else m.group(), text)
                if self.least(filled) + LOST_COST < here and self.cost(filled) + LOST_COST < here:
                    return True
        return False


def fit(cues: DataFrame, lexicon: DataFrame, leads: bool = True) -> Profiles:
    """Profiles from all labelled cues, which first clean themselves of garbled texts and, for the dictionaries, of those that another language explains nearly as well.

    ``leads``: with the leads over rivals, which only classification asks for.
    """
    seeds = seeds_of(lexicon)
    texts = labelled(cues, seeds)
    strict, usual = build(texts, seeds, 0.006)

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mender = Mender(strict)
        for batch in batches:
            kept = batch.filter(pa.array([is_usual(text, usual.get(code, frozenset())) or not mender.is_garbled(text) for code, text, *_ in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.bool_()))
            clear = [own and strict.leads_by(code, text, 3) for code, text, own, _ in zip(*(c.to_pylist() for c in kept.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(clear, pa.bool_())], ["code", "text", "own", "n", "clear"])

    kept = cut(texts.mapInArrow(sound, "code string, text string, own boolean, n long, clear boolean"))
    made, _ = build(kept, seeds, 0.0002, "clear")
    return calibrate(made, kept) if leads else made


def garbled_keys(rows: DataFrame, profiles: Profiles, key: str = "row_id", text: str = "text") -> DataFrame:
    """The keys of ``find_garbled``, without the steps that only restored texts ask for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mender = Mender(profiles)
        for batch in batches:
            out = [k for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if mender.is_garbled(t)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["k"])

    return _not_ascii(rows, key, text).mapInArrow(work, "k long").withColumnRenamed("k", key)


def _not_ascii(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(key, text).where(f"`{text}` rlike '[^\\\\x00-\\\\x7f]'")


def find_garbled(rows: DataFrame, profiles: Profiles, key: str = "row_id", text: str = "text") -> DataFrame:
    """Garbled rows with the restored text.

    ``rows`` has a unique long key and a text; further columns are ignored, null and
    empty texts are never garbled, repeated rows each count, an empty table gives an
    empty result.  Result: key, ``restored`` (null where it cannot be restored whole),
    ``chain`` (the wrong readings undone, null if none).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mender = Mender(profiles)
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                garbled, restored, chain = mender.mend(t)
                if garbled:
                    out.append((k, restored, chain))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["k", "restored", "chain"])

    found = _not_ascii(rows, key, text).mapInArrow(work, "k long, restored string, chain string")
    return found.withColumnRenamed("k", key)
