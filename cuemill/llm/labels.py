"""Language labels in their many notations, and scripts."""

from __future__ import annotations

import re
from functools import lru_cache

# ISO 639-1 code, ISO 639-2/3 codes and English name of each language.
LANGUAGES = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish", "castilian"),
    "pt": ("por", "portuguese"),
    "ru": ("rus", "russian"),
    "zh": ("zho", "chi", "cmn", "chinese", "mandarin"),
    "ja": ("jpn", "japanese"),
    "hi": ("hin", "hindi"),
    "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch"),
    "pl": ("pol", "polish"),
    "sv": ("swe", "swedish"),
    "da": ("dan", "danish"),
    "fi": ("fin", "finnish"),
    "cs": ("ces", "cze", "czech"),
    "tr": ("tur", "turkish"),
    "uk": ("ukr", "ukrainian"),
    "ar": ("ara", "arabic"),
    "ko": ("kor", "korean"),
}
BY_NAME = {name: code for code, names in LANGUAGES.items() for name in (code, *names)}

# Unicode ranges of the scripts told apart.
SCRIPTS = {
    "latin": "A-Za-zªºÀ-ÖØ-öø-ɏ",
    "cyrillic": "Ѐ-ԯ",
    "devanagari": "ऀ-ॿ",
    "kana": "぀-ヿㇰ-ㇿｦ-ﾟ",
    "han": "㐀-䶿一-鿿豈-﫿",
    "hangul": "가-힯",
    "arabic": "؀-ۿ",
    "greek": "Ͱ-Ͽ",
}
_SCRIPT_PATTERNS = {name: re.compile(f"[{chars}]") for name, chars in SCRIPTS.items()}
_OTHER_SCRIPT = re.compile("[" + "".join(chars for name, chars in SCRIPTS.items() if name != "latin") + "]")


@lru_cache(maxsize=4096)
def code_of(label: str | None) -> str | None:
    """Two-letter code of a label such as ``en-GB``, ``fr_CA``, ``deu`` or ``French``; None where undetermined."""
    if not label:
        return None
    head = re.split(r"[-_\s(]", label.strip().lower(), maxsplit=1)[0]
    return BY_NAME.get(head)


@lru_cache(maxsize=20_000)
def _scripts_with(char: str) -> tuple[str, ...]:
    return tuple(name for name, p in _SCRIPT_PATTERNS.items() if p.match(char))


@lru_cache(maxsize=256)
def script_of(text: str) -> str | None:
    """The script with most letters; kana outweighs Han, as Japanese mixes them."""
    if text.isascii() or not _OTHER_SCRIPT.search(text):
        return "latin" if _SCRIPT_PATTERNS["latin"].search(text) else None
    held = {name for c in set(text) for name in _scripts_with(c)}
    if len(held) < 2:
        return held.pop() if held else None
    counts = {name: len(p.findall(text)) if name in held else 0 for name, p in _SCRIPT_PATTERNS.items()}
    best = max(counts, key=counts.__getitem__)
    if best == "han" and counts["kana"] * 20 >= counts["han"]:
        return "kana"
    return best
