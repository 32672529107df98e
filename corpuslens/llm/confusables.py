"""Visually identical text with different characters: script sets, confusables, one consistent form.

Each token is resolved by scripts.  A character has a script set: its own script, all scripts for common characters.
The token's sets, with the sets of each character's look-alikes joined in, are intersected; if characters of several
scripts meet, the token is mixed-script, and it is spelled again in the script that can spell all of it and needs the
fewest changes; a token of one foreign script that the text's main script can spell wholly is a whole-script confusable.
What is left is normalised: canonical composition and order, compatibility and width forms, letter variants drawn like
the plain letter, other spaces, and characters that aren't shown.

Vowel marks, tatweel, a missing hamza, punctuation, and U+0660-0669 beside 0-9 can be seen and stay as they are.

NULL and empty texts are consistent as they are.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from . import vec
from .vec import ARABIC_LOOKALIKES, INVISIBLE, WHITE

# Letters of other scripts drawn like a Latin letter.
LATIN_LOOKALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝ", "ABESIJKMHOPCTYXaesijopcyxdhqw"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"),
    "Armenian": ("ՕՍԼոսհցզ", "OULnuhgq"),
}
# Letters of right-to-left scripts that are drawn alike.
RIGHT_TO_LEFT = ({"Arabic": "ا", "Nko": "ߊ", "Hebrew": "ן"}, {"Arabic": "ه", "Hebrew": "ס"})
_INVISIBLE = frozenset(INVISIBLE)
_SPACES = frozenset(c for c in WHITE.tolist() if c not in (0x20, 0x0A, 0x0D, 0x09))
_SCRIPT = {s: regex.compile(rf"\p{{Script={s}}}") for s in ("Arabic", "Latin", "Cyrillic", "Greek", "Armenian", "Hebrew", "Syriac", "Thaana", "Nko")}
_SHAPES = {c: shape for shape in RIGHT_TO_LEFT for c in shape.values()}
_TO_LATIN = {a: (b, s) for s, (x, y) in LATIN_LOOKALIKES.items() for a, b in zip(x, y)}
_FROM_LATIN = {s: {b: a for a, b in zip(x, y)} for s, (x, y) in LATIN_LOOKALIKES.items()}


@lru_cache(maxsize=65536)
def script(ch: str) -> str:
    """The script of a character; "" for those common to all."""
    return next((s for s, r in _SCRIPT.items() if r.match(ch)), "")


@lru_cache(maxsize=65536)
def spellings(ch: str) -> dict[str, str]:
    """Scripts that can show this character, with the character they use."""
    own = script(ch)
    if not own:
        return {}
    out = {own: ch} | _SHAPES.get(ch, {})
    if ch in _TO_LATIN:
        latin = _TO_LATIN[ch][0]
        out["Latin"] = latin
        out |= {s: m[latin] for s, m in _FROM_LATIN.items() if latin in m and s != own}
    elif own == "Latin":
        out |= {s: m[ch] for s, m in _FROM_LATIN.items() if ch in m}
    return out


def respell(token: str, main: str) -> str:
    """The token in the one script that can spell all of it, if it is mixed or a whole-script confusable of ``main``."""
    sets = [x for x in map(spellings, token) if x]
    if not sets:
        return token
    own = {script(c) for c in token} - {""}
    able = set.intersection(*(set(x) for x in sets))
    if len(own) == 1 and (main not in able or own == {main}):
        return token
    if not able:
        return token
    count = {s: sum(script(c) == s for c in token) for s in able}
    best = main if len(own) == 1 else max(able, key=lambda s: (count[s], s == main, s))
    return "".join(spellings(c).get(best, c) for c in token)


@lru_cache(maxsize=65536)
def _plain_char(ch: str) -> str:
    cp = ord(ch)
    if cp in _INVISIBLE:
        return ""
    if cp in _SPACES:
        return " "
    out = unicodedata.normalize("NFKC", chr(ARABIC_LOOKALIKES.get(cp, cp)))
    return "".join(chr(ARABIC_LOOKALIKES.get(ord(c), ord(c))) for c in out)


def consistent(text: str | None) -> str | None:
    """The text in one form."""
    if not text:
        return text
    out = unicodedata.normalize("NFC", "".join(map(_plain_char, text)))
    if regex.search(r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{Armenian}\p{Hebrew}\p{Nko}]", out):
        counts: dict[str, int] = {}
        for c in out:
            s = script(c)
            counts[s] = counts.get(s, 0) + bool(s)
        main = max(counts, key=lambda s: (counts[s], s))
        out = regex.sub(r"[^\s\p{P}\p{S}]+", lambda m: respell(m[0], main), out)
    return out


@lru_cache(maxsize=1)
def suspects() -> np.ndarray:
    """Code points whose presence means the text may not be in the consistent form (decided exactly afterwards)."""
    t = np.zeros(0x110000, bool)
    for a, b in ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x10000), (0x1D000, 0x1F300), (0x2F800, 0x2FA20), (0xE0000, 0xE1000)):
        for cp in range(a, b):
            ch = chr(cp)
            t[cp] = _plain_char.__wrapped__(ch) != ch or (unicodedata.combining(ch) and cp not in _SAFE_MARKS) or ch in _TO_LATIN or (ch in _SHAPES and script(ch) != "Arabic")
    return t


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Canonical combining class of each code point up to U+FFFF."""
    t = np.zeros(0x110000, np.uint8)
    t[:0xFFFF] = [unicodedata.combining(chr(cp)) for cp in range(0xFFFF)]
    return t


# Vowel marks compose with nothing that is in use alone; their order among themselves is checked below.
_SAFE_MARKS = {*range(0x064B, 0x0653), 0x0670}


def flags(batch_column) -> np.ndarray:
    """Which texts aren't in the consistent form."""
    codes, lens = vec.codes_of(batch_column)
    rows = len(lens)
    out = np.zeros(rows, bool)
    if not len(codes):
        return out
    doc = np.repeat(np.arange(rows), lens)
    maybe = np.zeros(rows, bool)
    maybe[doc[suspects()[codes]]] = True
    # marks out of canonical order; Latin letters beside others may be mixed
    order = _classes()[codes]
    wrong = (order[1:] > 0) & (order[:-1] > order[1:]) & (doc[1:] == doc[:-1])
    maybe[doc[1:][wrong]] = True
    latin = np.zeros(rows, bool)
    latin[doc[(codes < 0x250) & ((codes | 0x20) >= 0x61) & ((codes | 0x20) <= 0x7A)]] = True
    other = np.zeros(rows, bool)
    other[doc[(codes >= 0x370) & (codes < 0x590)]] = True
    maybe |= latin & other
    at = np.flatnonzero(maybe)
    texts = batch_column.take(pa.array(at)).to_pylist()
    out[at] = [t is not None and consistent(t) != t for t in texts]
    return out


def normalized(batch_column) -> pa.Array:
    """The texts in the consistent form."""
    return pa.array([consistent(t) for t in batch_column.to_pylist()], pa.string())
