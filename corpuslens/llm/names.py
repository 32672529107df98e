"""Variant spellings of names typed by people: canonical rewritings, equi-joined, scored by rarity.

A name is [teknonym] own name - father - grandfather [origin] [epithet], in any of the orders and cuts people write.
Rules rewrite it: spelling of letters, forms of "father of" and "son of", joined compounds, order (origin first, teknonym
last), titles (the legal form of a person's name) left out, an initial for the own name or the father's, nicknames, and one
slip of the pen in a rare word, found by deletion neighbourhoods among all words: a string with one letter less is that of
at most (its length + 1) x (letters of the alphabet) words, so no neighbourhood is hot, whatever the table.  Whole names
give the entities; each entity is exploded into every form its name may be cut to, each written name into its rewritings,
and both are joined on the form.

A link is scored by rarity: 1 / number of entities that share the form, less for a costlier rewriting.  A name is linked
to an entity only if its cheapest rewritings lead to one.  Entities that are a slip away from a far more frequent one,
through a word that is rare itself, are spellings of that one; words that are common by themselves are never slips of
each other, so brothers and namesakes stay apart.

A name may have any number of forefathers and of words left over; those beyond the grandfather and the second count as
parts of these.  Spellings of a spelling are followed to the end.  Names that no whole name's forms explain are grouped by
their own canonical form.

Strings are counted once, before anything else (one string may hold a large part of the rows).  NULL names and bare
relatives are left out; names without letters link to nothing.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vec
from .base import cut, map_arrow

RARE = 20  # how much more frequent the right word is where a whole name is taken for a slip or nickname of another
NICK = 3  # the same for nicknames
# Words of the name grammar, letters folded.
SON, FATHER_OF, COMPOUND = {"بن", "ابن"}, {"ابو", "ابا", "ابي"}, {"عبد", "عبيد"}
# Titles before a name, letters folded.
TITLES = {"الشيخ", "الامام", "الحافظ", "السيد", "الاستاذ", "الدكتور", "القاضي", "سيدنا", "مولانا"}
# Nickname patterns on the letters of a name; "1", "2", "3" stand for its first consonants, long vowels apart.
NICKNAMES = ("12و3", "1و23", "12ي3", "1و2ي3", "123ه", "12ي3ه", "12و3ه", "12ا3", "12وش", "12ون", "123ون", "123و")
_LONG = set("اوي")


def _words(name: str) -> list[str]:
    return "".join(vec._common_of(ord(c)) for c in name).split()


def parse(name: str) -> dict | None:
    """Fields k, i, f, g (words of the chain) and t (words left over, origin or epithet), or None."""
    words, out = _words(name), []
    while len(words) > 1 and words[0] in TITLES and words[1] not in SON:
        words.pop(0)
    i = 0
    while i < len(words):  # compounds become one word
        w = words[i]
        if w in COMPOUND and i + 1 < len(words) and words[i + 1] not in SON:
            out.append(w + words[i + 1])
            i += 2
        else:
            out.append(w)
            i += 1
    k, chain, tail, head = None, [], [], []
    i = 0
    while i < len(out):
        w = out[i]
        if w in FATHER_OF and i + 1 < len(out):
            if chain and out[i - 1] in SON:
                chain.append(w + out[i + 1])
            else:
                k = out[i + 1]
            i += 2
        elif w in SON and i + 1 < len(out):
            if not chain:
                chain = [None]
            chain.append(out[i + 1])
            i += 2
        elif not chain and w.startswith("ال") and any(x in SON for x in out[i + 1 :]) and i + 1 < len(out) and out[i + 1] not in SON:
            head.append(w)
            i += 1
        elif not chain and not (w.startswith("ال") and i == len(out) - 1) and w not in SON and (k is None or i + 1 < len(out)):
            chain = [w]
            i += 1
        else:
            tail.append(w)
            i += 1
    tail = head + tail
    if not chain and not tail and k is None:
        return None
    more = lambda parts, at: [*parts[:at], " ".join(parts[at:])] if len(parts) > at + 1 else parts
    chain, tail = [*more(chain, 2), None, None, None], more(tail, 1)
    return {"k": k, "i": chain[0], "f": chain[1], "g": chain[2], "t": tail}


def nicknames(word: str) -> set[str]:
    """Nicknames of a name of three consonants (long vowels apart)."""
    c = [x for x in word.removesuffix("ه") if x not in _LONG]
    if len(c) != 3:
        c = [word[0], *(x for x in word[1:].removesuffix("ه") if x != "ا")]
        if len(c) != 3:
            return set()
    return {"".join(c[int(x) - 1] if x in "123" else x for x in p) for p in NICKNAMES} - {word}


def one_slip(a: str, b: str) -> bool:
    """Whether one letter was changed, lost, added or swapped with its neighbour."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    s, t = sorted((a, b), key=len)
    i = next((i for i in range(len(s)) if s[i] != t[i]), len(s))
    return s[i:] == t[i + 1 :]


FIELDS = ("k", "i", "f", "g", "t1", "t2")


def _parsed(batch):
    rows = []
    for name, n in zip(batch["name"].to_pylist(), batch["n"].to_pylist()):
        p = parse(name)
        if p:
            t = [*p["t"], None, None]
            rows.append((name, n, p["k"], p["i"], p["f"], p["g"], t[0], t[1]))
    cols = list(zip(*rows)) or [[]] * 8
    return {c: pa.array(list(v), pa.int64() if c == "n" else pa.string()) for c, v in zip(("name", "n", *FIELDS), cols)}


def _around(batch):
    """Deletion neighbourhood of each word."""
    rows = []
    for kind, w, n in zip(*(batch[c].to_pylist() for c in ("kind", "word", "rows"))):
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            rows.append((kind, v, w, n))
    cols = list(zip(*rows)) or [[]] * 4
    return {c: pa.array(list(v), pa.int64() if c == "rows" else pa.string()) for c, v in zip(("kind", "near", "word", "rows"), cols)}


def _nicks(batch):
    rows = [(v, w, n) for w, n in zip(batch["word"].to_pylist(), batch["rows"].to_pylist()) for v in nicknames(w)]
    cols = list(zip(*rows)) or [[]] * 3
    return {c: pa.array(list(v), pa.int64() if c == "rows" else pa.string()) for c, v in zip(("near", "word", "rows"), cols)}


def _check(batch):
    keep = pa.array([one_slip(a, b) for a, b in zip(batch["word"].to_pylist(), batch["right"].to_pylist())])
    return {c: batch[c].filter(keep) for c in ("kind", "word", "right", "ratio")}


def corrections(parsed: DataFrame) -> DataFrame:
    """(kind, word, right, cost, ratio, sure): words and what they may be a slip (2) or nickname (1) of."""
    of = lambda kind, *cols: parsed.select(F.lit(kind).alias("kind"), F.explode(F.array_compact(F.array(*cols))).alias("word"), "n")
    words = of("name", "k", "i", "f", "g").union(of("tail", "t1", "t2")).groupBy("kind", "word").agg(F.sum("n").alias("rows"))
    near = map_arrow(words, _around, "kind string, near string, word string, rows long")
    many = near.select("kind", "near", F.col("word").alias("right"), F.col("rows").alias("much"))
    slips = near.join(many.hint("merge"), ["kind", "near"]).where(F.col("word") != F.col("right")).select("kind", "word", "right", (F.col("much") / F.col("rows")).alias("ratio")).distinct()
    slips = map_arrow(slips, _check, "kind string, word string, right string, ratio double").withColumn("cost", F.lit(2))
    names = words.where("kind = 'name'")
    nick = map_arrow(names, _nicks, "near string, word string, rows long").select(F.col("near").alias("word"), F.col("word").alias("right"), F.col("rows").alias("much"))
    nick = names.join(nick.hint("merge"), "word").select("kind", "word", "right", (F.col("much") / F.col("rows")).alias("ratio"), F.lit(1).alias("cost")).where(F.col("ratio") >= NICK)
    both = slips.union(nick).groupBy("kind", "word", "right").agg(F.min("cost").alias("cost"), F.max("ratio").alias("ratio"))
    # a slip in an origin is told by the rest of the name; in a name, the word itself must be rare
    return both.withColumn("sure", F.expr(f"kind = 'tail' or ratio >= {RARE} or (cost = 1 and ratio >= {NICK})"))


def rewritings(parsed: DataFrame, right: DataFrame) -> DataFrame:
    """Each parsed name as it is (cost 0) and with one word put right."""
    parts = [parsed.select("name", "n", *FIELDS, F.lit(0).alias("cost"), F.lit(True).alias("sure"))]
    long = parsed.select("name", "n", *FIELDS, F.explode(F.array(*[F.struct(F.lit(c).alias("at"), F.lit("tail" if c[0] == "t" else "name").alias("kind"), F.col(c).alias("word")) for c in FIELDS])).alias("x")).select("*", "x.at", "x.kind", "x.word").drop("x").where("word is not null")
    fixed = long.join(right.hint("merge"), ["kind", "word"])
    parts.append(fixed.select("name", "n", *[F.when(F.col("at") == c, F.col("right")).otherwise(F.col(c)).alias(c) for c in FIELDS], "cost", "sure"))
    return parts[0].union(parts[1])


# Cuts of a whole name that people write, by fields (n = origin, l = epithet).
CUTS = ("ifg", "ifn", "ifl", "if", "in", "il", "n", "l", "kn", "kl", "fn", "kif", "kifg", "kifn", "kifl", "ifgl", "ifgn", "ki", "kin", "kil", "fl", "k")


# The cuts of which own name or father's may be an initial.
INITIALS = ("ifg", "ifn", "ifl", "if", "in")


def _initial(fields: str, get, at: str) -> F.Column:
    """A form with one field as its first letter."""
    return _form(fields, lambda c: F.substring(get(c), 1, 1) if c == at else get(c))


def _form(fields: str, get) -> F.Column:
    parts = [get(c) for c in fields]
    present = parts[0].isNotNull()
    for p in parts[1:]:
        present = present & p.isNotNull()
    return F.when(present, F.concat_ws("|", F.lit(fields), *parts))


def _written_forms() -> F.Column:
    """The forms a written name may be, from the fields it has; a lone last word may be origin or epithet."""
    name = [c for c in "kifg"]
    have = F.concat_ws("", *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in name])
    values = F.array_compact(F.array(*[F.col(c) for c in name]))
    one = lambda suffix: F.concat_ws("|", F.concat(have, F.lit(suffix)), F.concat_ws("|", values), F.col("t1"))
    plain = F.concat_ws("|", have, F.concat_ws("|", values))
    lone = lambda suffix: F.concat_ws("|", F.lit(suffix), F.col("t1"))
    none = F.size(values) == 0
    return (
        F.when(F.col("t2").isNotNull(), F.when(none, F.array(lone("n"))).otherwise(F.array(one("n"))))
        .when(F.col("t1").isNotNull(), F.when(none, F.array(lone("n"), lone("l"))).otherwise(F.array(one("n"), one("l"))))
        .otherwise(F.array(plain))
    )


def _followed(weak: DataFrame) -> DataFrame:
    """(was, into) followed to the end: ``into`` always has more rows, or as many and a smaller key, so there is one.

    Each round doubles the steps taken; the driver sees one number a round.
    """
    while True:
        weak = cut(weak)
        again = weak.select(F.col("was").alias("into"), F.col("into").alias("further"))
        stepped = weak.join(again.hint("merge"), "into", "left")
        if stepped.where("further is not null").limit(1).count() == 0:
            return weak
        weak = stepped.select("was", F.coalesce("further", "into").alias("into"))


def entities(names: DataFrame) -> DataFrame:
    """(name, entity, score): the entity each written name (name; rows) is linked to."""
    counted = names.where("name is not null").groupBy("name").agg(F.count("*").alias("n"))
    parsed = cut(map_arrow(counted, _parsed, "name string, n long, " + ", ".join(f"{c} string" for c in FIELDS)))
    written = cut(rewritings(parsed, corrections(parsed)))
    whole = F.expr("i is not null and f is not null and g is not null and t1 is not null")
    core = F.concat_ws("|", "i", "f", "g", "t1")
    people = parsed.where(whole).groupBy(core.alias("entity")).agg(F.sum("n").alias("rows"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("n", "name"))).alias(c) for c in FIELDS])
    people = cut(people)
    # whole names one slip or nickname away from a far more frequent entity are spellings of it
    moved = written.where(whole & (F.col("cost") > 0) & F.col("sure")).select("name", "cost", core.alias("entity")).join(people.select("entity", F.col("rows").alias("much")), "entity")
    own = parsed.where(whole).select("name", core.alias("was")).join(people.select(F.col("entity").alias("was"), "rows"), "was")
    moved = moved.join(own.hint("merge"), "name").where((F.col("entity") != F.col("was")) & ((F.col("much") > F.col("rows")) | ((F.col("much") == F.col("rows")) & (F.col("entity") < F.col("was")))))
    weak = moved.groupBy("was").agg(F.min_by("entity", F.struct("cost", -F.col("much"), "entity")).alias("into"))
    weak = _followed(weak)
    people = cut(people.join(weak.hint("merge"), F.col("entity") == F.col("was"), "left").drop("was"))
    solid = people.where("into is null")
    # what a whole name says itself
    direct = own.join(people.select(F.col("entity").alias("was"), F.coalesce("into", "entity").alias("entity")), "was").select("name", "entity", F.lit(1.0).alias("score"))
    get = {"k": F.col("k"), "i": F.col("i"), "f": F.col("f"), "g": F.col("g"), "n": F.col("t1"), "l": F.col("t2")}
    written_as = [_form(c, get.__getitem__) for c in CUTS] + [_initial(c, get.__getitem__, at) for c in INITIALS for at in c if at in "if"]
    forms = solid.select("entity", F.explode(F.array_distinct(F.array_compact(F.array(*written_as)))).alias("form"))
    shared = forms.groupBy("form").agg(F.count("*").alias("entities"), F.min("entity").alias("entity"))
    part = written.where(~F.coalesce(whole, F.lit(False))).select("name", "cost", F.explode(_written_forms()).alias("form"))
    met = part.join(shared.hint("merge"), "form")
    best = met.withColumn("least", F.min("cost").over(Window.partitionBy("name"))).where("cost = least")
    linked = best.groupBy("name").agg(F.sum("entities").alias("all"), F.max("entities").alias("most"), F.min("entity").alias("a"), F.max("entity").alias("b"), F.min("cost").alias("cost"))
    linked = linked.where("most = 1 and a = b").select("name", F.col("a").alias("entity"), (1 / F.col("all") / (1 + F.col("cost") * 0.25)).alias("score"))
    rest = parsed.join(met.select("name").distinct(), "name", "left_anti").where(~F.coalesce(whole, F.lit(False)))
    alike = rest.select("name", F.concat_ws("|", *[F.concat(F.lit(f"{c}:"), c) for c in FIELDS]).alias("entity"), F.lit(0.5).alias("score"))
    return direct.union(linked).union(alike)


def pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b) of different strings of one entity, name_a < name_b by code point."""
    a = linked.select("entity", F.col("name").alias("name_a")).distinct()
    b = linked.select("entity", F.col("name").alias("name_b")).distinct()
    return a.join(b.hint("merge"), "entity").where("name_a < name_b").select("name_a", "name_b").distinct()
