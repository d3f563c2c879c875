"""Where texts and their translations may be cut: lines, chunks, slices.

Every function is lossless or says what it drops.  The plain functions work on one text;
the columns of the same name without underscore run them over Arrow batches.
"""

from __future__ import annotations

import regex

from cuemill.functions.vectorised import vectorised

# Marks at which lines break, in falling preference.
CJK_BREAKS = "，。、？！：；·…—～（）【】〔〕〖〗《》〈〉「」『』〘〙〚〛"
LATIN_BREAKS = ",.!?;:-–—«»‹›"
# Marks behind which a translation may be cut, by strength.
SENTENCE_CUTS = ".!?。！？"
CLAUSE_CUTS = ",;:、，；：—–)]」』》〉】〕〗）"
# Marks that correspond across languages, by class.
SENTENCE_MARKS = ".!?。！？．…।॥؟"
CLAUSE_MARKS = ",;:，、；：،؛"
DASH_MARKS = "—–―"
# What may stand between a mark and a cut; closing ones stay with the mark.
OPENING = "“‘([{「『《〈【〔〖（［｛«‹„‚"
CLOSING = "”’)]}」』》〉】〕〗）］｝»›\"'"
# Ideographs that count as a word each.
HAN = "一-鿿㐀-䶿\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002b81f\U0002b820-\U0002ceaf\U0002ceb0-\U0002ebef\U00030000-\U0003134f"

REACH = 20
MOST_SKEW = 2.0
LEAST_SHARE = 0.05

_WORD_CHAR = regex.compile("[A-Za-z0-9'’]")
_TOKEN = regex.compile(f"[{HAN}]|[A-Za-z0-9'’]+")
_RANK = {**dict.fromkeys(LATIN_BREAKS, 2), **dict.fromkeys(CJK_BREAKS, 1)}
_STRENGTH = {**dict.fromkeys(CLAUSE_CUTS, 3), **dict.fromkeys(SENTENCE_CUTS, 4)}
_MARKS = regex.compile("|".join(f"(?P<{name}>[{regex.escape(marks)}]+)" for name, marks in (("sentence", SENTENCE_MARKS), ("clause", CLAUSE_MARKS), ("dash", DASH_MARKS))))
_NEUTRAL = regex.compile(f"[\\s{regex.escape(OPENING + CLOSING)}]*")
_TAIL = regex.compile(f"[{regex.escape(CLOSING)}]*\\s*")


def squashed(text: str) -> str:
    return " ".join(text.split())


def split_point(text: str, most: int) -> int:
    """Where a text over ``most`` characters is cut: between 40 % and 110 % of it, behind a CJK mark, else another mark, else a blank."""
    best = None
    for i in range(int(most * 0.4), min(len(text), int(most * 1.1))):
        here, after = text[i], text[i + 1 : i + 2]
        if here.isspace():
            rank = _RANK.get(text[i - 1], 3) if i else 3
        elif after.isspace() and here in _RANK:
            rank = _RANK[here]
        else:
            continue
        if best is None or rank <= best[0]:  # the last of equals
            best = (rank, i + 1)
    return best[1] if best else most


def text_chunks(text: str | None, most: int) -> list[str]:
    """The squashed text cut again and again at the best point; blanks at the cuts are dropped."""
    rest, out = squashed(text or ""), []
    while len(rest) > most:
        at = split_point(rest, most)
        out.append(rest[:at].rstrip())
        rest = rest[at:].lstrip()
    return [c for c in [*out, rest.strip()] if c] or [""]


def smart_lines(text: str | None, most: int, lines: int) -> str:
    """At most ``lines`` lines; what does not fit stays on the last one.  A short text without breaks or double blanks is kept as it is."""
    text = text or ""
    if len(text) <= most and "\n" not in text and "  " not in text:
        return text
    rest, out = squashed(text), []
    while rest and len(out) < lines:
        at = len(rest) if len(rest) <= most else split_point(rest, most)
        out.append(rest[:at].rstrip())
        rest = rest[at:].lstrip()
    if rest and out:
        out[-1] = f"{out[-1]} {rest}".lstrip()
    return "\n".join(out)


def is_word_char(char: str) -> bool:
    return bool(_WORD_CHAR.fullmatch(char))


def tokens(text: str) -> int:
    """Ideographs and runs of Latin letters, digits and apostrophes."""
    return len(_TOKEN.findall(text))


def boundary_score(text: str, at: int) -> int:
    """How good a cut before ``at`` is: 4 behind a sentence, 3 behind a clause, 2 at a blank, 1 elsewhere, 0 inside a Latin word."""
    if not 0 < at < len(text):
        return 1
    before, after = text[at - 1], text[at]
    if is_word_char(before) and is_word_char(after):
        return 0
    return _STRENGTH.get(before) or (2 if before.isspace() or after.isspace() else 1)


def safe_split(text: str, target: int, low: int) -> int:
    """The best cut near ``target``, none before ``low``.

    Within ``REACH`` the nearest end of a sentence wins, then the best score; without a
    blank or better there the nearest one beyond is taken, then any cut outside words.
    A text that may be cut nowhere is not cut: its length comes back.
    """
    n = len(text)
    target = max(target, low)
    if target >= n:
        return n
    places = sorted(range(low, n), key=lambda p: (abs(p - target), p))
    scores = {p: boundary_score(text, p) for p in places}
    near = [p for p in places if abs(p - target) <= REACH]
    best = max(near, key=scores.__getitem__, default=None)  # the nearest of equals
    if best is not None and scores[best] >= 2:
        return best
    far = [p for p in places if scores[p] >= 2]
    if far:
        ring = [p for p in far if abs(p - target) == abs(far[0] - target)]
        return max(ring, key=scores.__getitem__)
    return next((p for p in places if scores[p] == 1), n)


def grapheme_boundary(text: str, at: int) -> int:
    """The first place from ``at`` on that lies between two characters as people see them."""
    if not 0 < at < len(text):
        return max(0, min(at, len(text)))
    return next(m.end() for m in regex.finditer(r"\X", text) if m.end() >= at)


def fold_short(slices: list[str | None], least: int = 2) -> list[str | None]:
    """Slices of fewer than ``least`` tokens join the slice before them, a short first one the slice behind; emptied places are None."""
    out = list(slices)
    held = [k for k, s in enumerate(out) if s is not None]
    kept = held[:1]
    for k in held[1:]:
        if tokens(out[k]) < least:
            out[kept[-1]] += out[k]
            out[k] = None
        else:
            kept.append(k)
    if len(kept) > 1 and kept[0] == 0 and tokens(out[0]) < least:
        out[kept[1]] = out[0] + out[kept[1]]
        out[0] = None
    return out


def proportional_slices(translation: str | None, chunks: list[str]) -> list[str | None]:
    """A translation by the chunks' shares of characters, cut at safe places only."""
    n, total = len(chunks), sum(map(len, chunks))
    if not n:
        return []
    if not translation or n == 1 or not total or len(translation) < 2 * n:
        return [translation, *[None] * (n - 1)]
    cuts = [0]
    for chunk in chunks[:-1]:
        target = cuts[-1] + max(1, round(len(translation) * len(chunk) / total))
        cuts.append(grapheme_boundary(translation, safe_split(translation, min(target, len(translation)), cuts[-1] + 1)))
    cuts.append(len(translation))
    return fold_short([translation[a:b] or None for a, b in zip(cuts, cuts[1:], strict=False)])


def _anchors(text: str) -> list[tuple[str, int]]:
    """Class and end of each run of marks, without the end of the whole."""
    found = [(m.lastgroup, m.end()) for m in _MARKS.finditer(text)]
    if found and found[-1][0] == "sentence" and _NEUTRAL.fullmatch(text, found[-1][1]):
        found.pop()
    return found


def balanced(chunks: list[str], slices: list[str], skew: float = MOST_SKEW) -> bool:
    """Whether each slice's share of all characters is within ``skew`` times its chunk's; small shares count as 5 %."""
    whole, other = sum(map(len, chunks)) or 1, sum(map(len, slices)) or 1
    shares = [sorted((len(c) / whole, len(s) / other)) for c, s in zip(chunks, slices, strict=False)]
    return all(high <= skew * max(low, LEAST_SHARE) for low, high in shares)


def mirrored_slices(text: str | None, translation: str | None, chunks: list[str]) -> list[str] | None:
    """A translation cut at the marks that mirror those at which the chunks end; None where the marks do not correspond.

    The classes of all marks inside both texts must agree, every chunk must end at a mark
    of its own, and no slice may be out of proportion.
    """
    if len(chunks) < 2 or not text or not translation:
        return None
    here, there = _anchors(text), _anchors(translation)
    if not here or [c for c, _ in here] != [c for c, _ in there]:
        return None
    used, at = [], 0
    for chunk in chunks[:-1]:
        at += len(chunk)
        last = max((k for k, (_, end) in enumerate(here) if end <= at), default=None)
        if last is None or not _NEUTRAL.fullmatch(text, here[last][1], at) or last in used:
            return None
        used.append(last)
    cuts = [0, *(_TAIL.match(translation, there[k][1]).end() for k in used), len(translation)]
    slices = [translation[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return slices if balanced(chunks, slices) else None


def translation_slices(text: str | None, translation: str | None, chunks: list[str] | None) -> list[str | None]:
    """Mirrored marks where they correspond, else shares."""
    chunks = chunks or []
    return mirrored_slices(text, translation, chunks) or proportional_slices(translation, chunks)


split_point_of = vectorised(lambda t, n: None if t is None else split_point(t, int(n)), "int")
chunks_of = vectorised(lambda t, n: text_chunks(t, int(n)), "array<string>")
smart_lines_of = vectorised(lambda t, n, k: smart_lines(t, int(n), int(k)), "string")
boundary_score_of = vectorised(lambda t, k: None if t is None else boundary_score(t, int(k)), "int")
safe_split_of = vectorised(lambda t, k, low: None if t is None else safe_split(t, int(k), int(low)), "int")
grapheme_boundary_of = vectorised(lambda t, k: None if t is None else grapheme_boundary(t, int(k)), "int")
proportional_of = vectorised(lambda t, c: proportional_slices(t, c or []), "array<string>")
mirrored_of = vectorised(lambda s, t, c: mirrored_slices(s, t, c or []), "array<string>")
balanced_of = vectorised(lambda c, s: balanced(c or [], s or []), "boolean")
translation_slices_of = vectorised(translation_slices, "array<string>")
