"""Vectorised text kernels shared by the operators of this subpackage.

A whole Arrow batch of texts is decoded once into one array of code points and handled by table look-ups and
``reduceat``; nothing here loops over characters in Python.  All functions are pure and run inside ``mapInArrow``
workers.  NULL counts as the empty text everywhere.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)

# Characters that are not shown and vanish without splitting a word.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x200B, 0x2010),
             *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0,
             *range(0xFFF9, 0xFFFC), *range(0xE0000, 0xE1000), *range(0x1D173, 0x1D17B)]

# Arabic-script letters drawn like a letter of the plain Arabic alphabet, and digits of the same look.
ARABIC_LOOKALIKES = {
    0x06A9: 0x0643, 0x06AA: 0x0643, 0x06CC: 0x064A, 0x06BE: 0x0647, 0x06C1: 0x0647, 0x06D5: 0x0647,
    0x06F0: 0x0660, 0x06F1: 0x0661, 0x06F2: 0x0662, 0x06F3: 0x0663, 0x06F7: 0x0667, 0x06F8: 0x0668, 0x06F9: 0x0669,
}

# Letter folding of the common form.
FOLD = {0x0623: 0x0627, 0x0625: 0x0627, 0x0622: 0x0627, 0x0671: 0x0627, 0x0649: 0x064A, 0x0626: 0x064A,
        0x0624: 0x0648, 0x0629: 0x0647}
_MARKS = {*range(0x064B, 0x0660), 0x0670, 0x0640}


def _common_of(cp: int) -> str:
    """What one code point leaves in the common form: "", one character, or several."""
    if cp in _INVISIBLE_SET:
        return ""
    out = []
    try:
        plain = unicodedata.normalize("NFKC", chr(ARABIC_LOOKALIKES.get(cp, cp)))
    except ValueError:
        plain = " "
    for ch in plain:
        c = ord(ch)
        c = ARABIC_LOOKALIKES.get(c, c)
        if c in _INVISIBLE_SET or c in _MARKS:
            continue
        c = FOLD.get(c, c)
        out.append(chr(c) if 0x0621 <= c <= 0x064A or 0x30 <= c <= 0x39 else " ")
    return "".join(out)


_INVISIBLE_SET = frozenset(INVISIBLE)


@lru_cache(maxsize=1)
def common_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(single, count, several): single[cp] the character left, count[cp] how many, several[single[cp]] if count > 1."""
    single, count, several = np.full(0x110000, 32, np.uint32), np.ones(0x110000, np.int16), []
    ranges = [(0, 0x800), (0x1680, 0x1681), (0x180B, 0x1810), (0x1D173, 0x1D17B), (0x1EE00, 0x1EF00), (0x2000, 0x3400), (0xF900, 0xFFFF), (0xE0000, 0xE1000), (0x1D400, 0x1D800), (0x1F100, 0x1F200), (0x115F, 0x1161), (0x17B4, 0x17B6)]
    for a, b in ranges:
        for cp in range(a, b):
            s = _common_of(cp)
            if len(s) == 1:
                single[cp] = ord(s)
            else:
                count[cp] = len(s)
                if s:
                    single[cp] = len(several)
                    several.append(s)
    wide = max(map(len, several))
    table = np.full((len(several), wide), 32, np.uint32)
    for i, s in enumerate(several):
        table[i, : len(s)] = [ord(c) for c in s]
    return single, count, table


def codes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts one after another, length of each text)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    lens = pc.utf8_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = data.to_pybytes()[off[0] : off[-1]] if data is not None and len(col) else b""
    return np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), lens


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _P, U64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Words:
    """Words of a batch: ``doc`` (row), ``hash`` (uint64), ``start``/``size`` in the code array, ``first`` per row."""

    __slots__ = ("doc", "hash", "start", "size", "first", "count", "codes")

    def __init__(self, doc, hashes, start, size, rows, codes):
        self.doc, self.hash, self.start, self.size, self.codes = doc, hashes, start, size, codes
        self.count = np.bincount(doc, minlength=rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def text(self, i: int) -> str:
        return self.codes[self.start[i] : self.start[i] + self.size[i]].tobytes().decode("utf-32-le", "surrogatepass")


def _split(codes: np.ndarray, doc: np.ndarray, rows: int, gap: np.ndarray) -> Words:
    n = len(codes)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z.astype(U64), z, z, rows, codes)
    inside = ~gap
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = gap[:-1] | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new & inside)
    if not len(at):
        z = np.zeros(0, np.int64)
        return Words(z, z.astype(U64), z, z, rows, codes)
    word = np.cumsum(new & inside) - 1  # word that a character belongs to, if inside
    kept = np.flatnonzero(inside)
    w = word[kept]
    k = kept - at[w]
    h = (codes[kept].astype(U64) + U64(1)) * _powers(int(k.max()) + 1)[k]
    size = np.bincount(w, minlength=len(at)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    return Words(doc[at], mix(np.add.reduceat(h, first)), at, size, rows, codes)


def common_words(col: pa.Array) -> Words:
    """Words of the common form; ``nan`` and ``None`` and empty texts have none."""
    single, count, table = common_tables()
    codes, lens = codes_of(col)
    doc = np.repeat(np.arange(len(lens)), lens)
    n = count[codes]
    out = single[codes]
    if (n > 1).any():
        at = np.repeat(np.arange(len(codes)), n)
        within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        many = n[at] > 1
        res = out[at]
        res[many] = table[res[many], within[many]]
        out, doc = res, doc[at]
    else:
        keep = n == 1
        out, doc = out[keep], doc[keep]
    return _split(out, doc, len(lens), out == 32)


# Code points that separate words of a text as stored (Unicode white space).
WHITE = np.array([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


@lru_cache(maxsize=1)
def _white() -> np.ndarray:
    t = np.zeros(0x110000, bool)
    t[WHITE] = True
    return t


def stored_words(col: pa.Array) -> Words:
    """Words of the texts as stored, split at any Unicode white space; punctuation stays."""
    codes, lens = codes_of(col)
    return _split(codes, np.repeat(np.arange(len(lens)), lens), len(lens), _white()[codes])


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of k words within one row."""
    n = len(words.hash)
    if n < k:
        z = np.zeros(0, np.int64)
        return z, z.astype(U64)
    ok = np.flatnonzero(words.doc[: n - k + 1] == words.doc[k - 1 :])
    h = np.zeros(n - k + 1, U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * U64(0xD6E8FEB86659FD93) + words.hash[j : n - k + 1 + j]
    return ok, mix(h[ok])


def string_keys(col: pa.Array) -> np.ndarray:
    """64-bit keys of strings (ids)."""
    codes, lens = codes_of(col)
    n = len(lens)
    out = np.zeros(n, U64)
    if len(codes):
        k = np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)
        h = (codes.astype(U64) + U64(1)) * _powers(int(k.max()) + 1)[k]
        some = lens > 0
        out[some] = np.add.reduceat(h, (np.cumsum(lens) - lens)[some])
    return mix(out + lens.astype(U64))


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
