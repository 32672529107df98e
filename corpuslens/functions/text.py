"""Text functions as column expressions: all of it stays in the JVM and in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as L


def _folded(s: str) -> str:
    return s.translate(str.maketrans(L.LETTERS_FROM, L.LETTERS_TO))


HONORIFICS = sorted({_folded(h) for h in L.HONORIFICS}, key=lambda h: (-len(h), h))
STOPWORDS = sorted({_folded(w) for w in L.STOPWORDS.split()})


def strip_diacritics(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), L.DIACRITICS, ""), F.lit(L.TATWEEL), F.lit(""))


def fold(c: Column) -> Column:
    """Letters folded, everything but Arabic letters and 0-9 a single space."""
    return F.trim(F.regexp_replace(F.translate(strip_diacritics(c), L.LETTERS_FROM, L.LETTERS_TO), L.NOT_ARABIC, " "))


def normalize(c: Column, drop_honorifics: bool = True) -> Column:
    out = fold(c)
    if drop_honorifics:
        for h in HONORIFICS:
            out = F.replace(out, F.lit(h), F.lit(" "))
        out = F.trim(F.regexp_replace(out, " +", " "))
    return out


def words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def tokens(normalized: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.split(normalized, " "), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def char_ngrams(normalized: Column, n: int = 3) -> Column:
    """Character n-grams of each word with a space on either side, as a multiset."""
    padded = F.transform(words(normalized), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))))


def gram_containment(q: Column, d: Column) -> Column:
    """Share of a query's character 3-grams, with repetition, that a document has; 0 without any."""
    grams, have = char_ngrams(q), F.array_distinct(char_ngrams(d))
    return F.when(F.size(grams) > 0, F.size(F.filter(grams, lambda g: F.array_contains(have, g))) / F.size(grams)).otherwise(0.0)


def stem(w: Column) -> Column:
    return F.regexp_replace(w, "^(" + "|".join(L.STEM_PREFIXES) + ")(?=..)", "")


TOPIC = "^(?:" + "|".join(L.TOPIC_STARTS) + r")\s+(?:(?:" + "|".join(L.TOPIC_LINKS) + r")\s+)?"


def detect_mode(c: Column) -> Column:
    return F.when(normalize(c).rlike(TOPIC), "topic").otherwise("verify")


def topic_text(normalized: Column) -> Column:
    return F.trim(F.regexp_replace(normalized, TOPIC, ""))


def refers_back(normalized: Column) -> Column:
    return normalized.rlike("|".join(L.REFERS_BACK)) & (F.size(words(normalized)) < L.REFERS_BACK_WORDS)


def is_placeholder(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*L.EMPTY_WORDS), F.lit(False))


def cleaned(c: Column) -> Column:
    """NULL and placeholder words become the empty text."""
    return F.when(c.isNull() | is_placeholder(c), "").otherwise(c)


def first_number(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d+)", 1)


def plain_number(c: Column) -> Column:
    return F.regexp_replace(c, r"\.0$", "")


def first_words(normalized: Column, n: int) -> Column:
    return F.array_join(F.slice(words(normalized), 1, n), " ")


def canonical(name: Column) -> Column:
    """One spelling for "father of" and "son of", and nothing behind the name."""
    out = normalize(name, False)
    for pattern, instead in L.CANONICAL:
        out = F.regexp_replace(out, pattern, instead)
    return out


def sample_key(*parts: Column) -> Column:
    """Deterministic sampling order: hex of SHA-1, which sorts like the number."""
    return F.sha1(F.concat_ws(":", F.lit(L.SAMPLE_SEED), *parts))


def quote_words(text: Column, start: Column, end: Column) -> Column:
    """Words [start, end) of a text as stored."""
    return F.array_join(F.slice(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), start + 1, F.greatest(end - start, F.lit(0))), " ")


def search_url(base: str, q: Column) -> Column:
    return F.concat(F.lit(base), F.lit("?q="), F.url_encode(q))
