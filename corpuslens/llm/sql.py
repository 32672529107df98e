"""DuckDB counterparts of the queries of this subpackage that SQL can express, written from the definitions and not from the plans."""

import re
import unicodedata

from .vec import ARABIC_LOOKALIKES, INVISIBLE


def _forms() -> tuple[str, str]:
    """Characters whose plain form has an Arabic letter or a digit but is another one, and those forms, as two SQL lists."""
    kept = lambda c: "\u0621" <= c <= "\u064a" or c in "0123456789 "
    gone = {chr(c) for c in INVISIBLE} | {"\u0640", "\u0670", *map(chr, range(0x064B, 0x0660))}
    chars, forms = [], []
    for a, b in ((0xA0, 0x3400), (0xF900, 0xFFFF), (0x1D400, 0x1D800), (0x1EE00, 0x1EF00), (0x1F100, 0x1F200)):
        for cp in range(a, b):
            c = chr(cp)
            if c in gone or "\u0621" <= c <= "\u064a":
                continue
            plain = unicodedata.normalize("NFKC", chr(ARABIC_LOOKALIKES.get(cp, cp)))
            plain = "".join(chr(ARABIC_LOOKALIKES.get(ord(x), ord(x))) for x in plain)
            form = "".join(x if kept(x) else " " for x in plain if x not in gone)
            if form.strip() or not form:
                chars.append(c)
                forms.append(form)
    sql = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    return sql(chars), sql(forms)


_CHARS, _PLAIN = _forms()
_HIDDEN = "[" + "".join(f"\\x{{{c:X}}}" for c in INVISIBLE) + "]"
_ODD = "[" + re.sub("[\\[\\]', ]", "", _CHARS) + "]"
COMMON = f"""cmap AS (SELECT map_from_entries(list_zip({_CHARS}, {_PLAIN})) AS plain_of)"""


def _words(x: str) -> str:
    """Words of the common form of a text column; needs ``cmap`` beside its table."""
    seen = f"regexp_replace(coalesce({x}, ''), '{_HIDDEN}', '', 'g')"
    plain = f"CASE WHEN regexp_matches({seen}, '{_ODD}') THEN array_to_string(list_transform(regexp_extract_all({seen}, '(?s).'), lambda c: coalesce(plain_of[c], c)), '') ELSE {seen} END"
    folded = f"translate(regexp_replace({plain}, '[\\x{{64B}}-\\x{{65F}}\\x{{670}}\\x{{640}}]', '', 'g'), 'أإآٱىئؤة', 'ااااييوه')"
    return f"list_filter(string_split(regexp_replace({folded}, '[^\\x{{621}}-\\x{{64A}}0-9]', ' ', 'g'), ' '), lambda w: w <> '')"


def _seen_alike() -> str:
    """A class of the characters that look like or hide beside another: invisible, other spaces, compatibility and width forms, letters and digits of the same look."""
    cps = set(INVISIBLE) | set(ARABIC_LOOKALIKES)
    for a, b in ((0xA0, 0x3400), (0xF900, 0xFFFF), (0x1D400, 0x1D800), (0x1EE00, 0x1EF00), (0x1F100, 0x1F200)):
        cps |= {cp for cp in range(a, b) if unicodedata.category(chr(cp)) == "Zs" or unicodedata.normalize("NFKC", chr(cp)) != unicodedata.normalize("NFC", chr(cp))}
    return "[" + "".join(f"\\x{{{c:X}}}" for c in sorted(cps)) + "]"


NEAR = f"""{COMMON}, t AS (SELECT DISTINCT id, {_words('matn')} AS ws FROM hadiths, cmap WHERE id IS NOT NULL AND matn IS NOT NULL), l AS (SELECT id, ws, len(ws) AS n FROM t WHERE len(ws) >= 15),
x AS (SELECT id, n, word, row_number() OVER (PARTITION BY id, word) AS k FROM (SELECT id, n, unnest(ws) AS word FROM l)),
near AS (SELECT a.id AS id_a, b.id AS id_b FROM x a JOIN x b ON b.word = a.word AND b.k = a.k AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.75 * greatest(a.n, b.n))"""

# n of two texts: a row of the usual table for each word of the first
_LCS = """list_last(list_reduce(a, lambda held, w: list_reduce(range(1, len(b) + 1), lambda made, j: list_append(made, CASE WHEN b[j] = w THEN held[j] + 1 ELSE greatest(held[j + 1], list_last(made)) END), [0::BIGINT]),
  list_transform(range(0, len(b) + 1), lambda z: 0::BIGINT)))"""
CROSS = f"""{COMMON}, c0 AS (SELECT * FROM cases WHERE id IS NOT NULL AND query IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY saved_at) = 1),
c AS (SELECT id, split, coalesce(relevant, []) AS relevant, {_words('query')} AS ws FROM c0, cmap WHERE split IN ('dev', 'test')),
x AS (SELECT id, split, word, row_number() OVER (PARTITION BY id, word) AS k FROM (SELECT id, split, unnest(ws) AS word FROM c WHERE len(ws) >= 6)),
o AS (SELECT a.id AS dev, b.id AS test, count(*) AS n FROM x a JOIN x b ON b.word = a.word AND b.k = a.k WHERE a.split = 'dev' AND b.split = 'test' GROUP BY ALL),
p AS (SELECT dev, test, a.ws AS a, b.ws AS b, greatest(len(a.ws), len(b.ws)) AS longer, least(len(a.ws), len(b.ws)) AS shorter,
  len(list_filter(list_intersect(a.relevant, b.relevant), lambda r: r IS NOT NULL)) > 0 AS related FROM o JOIN c a ON a.id = dev JOIN c b ON b.id = test WHERE n >= 0.8 * greatest(len(a.ws), len(b.ws)) OR n >= 0.9 * least(len(a.ws), len(b.ws))),
m AS (SELECT dev, test, longer, shorter, related, {_LCS} AS n FROM p),
cross_pairs AS (SELECT dev, test FROM m WHERE (shorter >= 8 AND n * 10 >= 8 * longer) OR (related AND n * 10 >= 9 * shorter))"""

_WHITE = r"[\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_RUNS = f"""r AS (SELECT DISTINCT 'hadiths' AS table_name, id AS rec_id, matn AS t FROM hadiths UNION ALL SELECT DISTINCT 'cases', id, query FROM cases),
w AS (SELECT table_name, rec_id, list_filter(string_split_regex(coalesce(t, ''), '{_WHITE}'), lambda x: x <> '') AS ws FROM r WHERE rec_id IS NOT NULL),
g AS (SELECT table_name, rec_id, i, array_to_string(ws[i:i + 11], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - 10)) AS i FROM w)),
s AS (SELECT gram FROM (SELECT DISTINCT gram, table_name, rec_id FROM g) GROUP BY gram HAVING count(*) > 1),
h AS (SELECT table_name, rec_id, i - 1 AS a FROM g WHERE gram IN (SELECT gram FROM s)),
k AS (SELECT *, CASE WHEN a > lag(a) OVER (PARTITION BY table_name, rec_id ORDER BY a) + 12 THEN 1 ELSE 0 END AS new FROM h),
j AS (SELECT *, sum(new) OVER (PARTITION BY table_name, rec_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS no FROM k),
f AS (SELECT table_name, rec_id, min(a) AS first_word, max(a) + 11 AS last_word FROM j GROUP BY table_name, rec_id, no)"""

SQL: dict[str, str] = {
    "p3_found": f"WITH {_RUNS} SELECT table_name, rec_id, first_word, last_word FROM f",
    "p3_coverage": f"""WITH {_RUNS}, c AS (SELECT table_name, rec_id, sum(last_word - first_word + 1) AS n FROM f GROUP BY ALL)
SELECT w.table_name, w.rec_id, len(ws) AS n_words, coalesce(c.n, 0) AS shared_words, round(CASE WHEN len(ws) > 0 THEN coalesce(c.n, 0) / len(ws) ELSE 0 END, 4) AS shared_share
FROM w LEFT JOIN c ON c.table_name = w.table_name AND c.rec_id = w.rec_id""",
    "p4_found": f"WITH {NEAR} SELECT id_a, id_b FROM near",
    "p4_groups": f"""WITH RECURSIVE {NEAR}, e AS (SELECT id_a AS u, id_b AS v FROM near UNION ALL SELECT id_b, id_a FROM near),
reach AS (SELECT id AS u, id AS v FROM l UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v)
SELECT u AS rec_id, min(v) AS group_id, (SELECT count(*) FROM e WHERE e.u = reach.u) AS links FROM reach GROUP BY u""",
    "p2_found": f"WITH {CROSS} SELECT least(dev, test) AS case_a, greatest(dev, test) AS case_b FROM cross_pairs",
    "p2_report": f"""WITH {CROSS}, lk AS (SELECT dev AS id FROM cross_pairs UNION ALL SELECT test FROM cross_pairs), k AS (SELECT id, count(*) AS links FROM lk GROUP BY id),
z AS (SELECT * FROM cases WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY saved_at) = 1)
SELECT split, origin.kind AS origin_kind, count(*) AS n_cases, count(links) AS n_overlapping, coalesce(sum(links), 0) AS n_links FROM z LEFT JOIN k ON k.id = z.id GROUP BY 1, 2""",
    "p8_found": f"""WITH {COMMON}, q AS (SELECT DISTINCT id AS case_id, {_words('query')} AS ws FROM cases, cmap WHERE id IS NOT NULL AND query IS NOT NULL AND split = 'test'),
d AS (SELECT doc_id, {_words('text')} AS ws FROM documents, cmap WHERE doc_id IS NOT NULL AND text IS NOT NULL),
qg AS (SELECT DISTINCT case_id, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - 6)) AS i FROM q)),
dg AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - 6)) AS i FROM d))
SELECT DISTINCT doc_id, case_id FROM dg JOIN qg USING (gram)""",
    # words of several scripts, which these tables don't have, are told apart by the operator only
    "p6_found": " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS table_name, '{c}' AS field_name, id AS rec_id FROM {t} WHERE id IS NOT NULL AND (regexp_matches({c}, '{_seen_alike()}') OR nfc_normalize({c}) <> {c})"
                            for t, c in (("hadiths", "matn"), ("hadiths", "isnad"), ("cases", "query"))),
}
