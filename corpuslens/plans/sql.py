"""DuckDB counterparts of the core's queries, written independently of the plans they check."""

from __future__ import annotations

from .. import lexicon as L
from ..functions.text import HONORIFICS, STOPWORDS
from ..operators.provenance import METHODS, MISSING


def _norm(x: str, drop: bool = True) -> str:
    out = f"translate(replace(regexp_replace(coalesce({x}, ''), '{L.DIACRITICS}', '', 'g'), '{L.TATWEEL}', ''), '{L.LETTERS_FROM}', '{L.LETTERS_TO}')"
    out = f"trim(regexp_replace({out}, '{L.NOT_ARABIC}', ' ', 'g'))"
    if drop:
        for h in HONORIFICS:
            out = f"replace({out}, '{h}', ' ')"
        out = f"trim(regexp_replace({out}, ' +', ' ', 'g'))"
    return out


_EMPTY = ", ".join(f"'{w}'" for w in L.EMPTY_WORDS)
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _clean(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR lower(trim({x})) IN ({_EMPTY}) THEN '' ELSE {x} END"


_STEM = "|".join(L.STEM_PREFIXES)
_TOPIC = "^(?:" + "|".join(L.TOPIC_STARTS) + r")\s+(?:(?:" + "|".join(L.TOPIC_LINKS) + r")\s+)?"

RECS = f"""recs0 AS (SELECT * FROM hadiths WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1),
recs AS (SELECT *, {_norm(_clean('matn'))} AS nm FROM recs0)"""
CASES = f"""cs0 AS (SELECT * FROM cases WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY saved_at) = 1),
cs AS (SELECT *, {_norm(f'left(query, {L.MAX_QUERY_CHARS})')} AS qn FROM cs0)"""
# whole queries, where nothing says that they are cut
WHOLE = f"""cs0 AS (SELECT * FROM cases WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY saved_at) = 1),
cs AS (SELECT *, {_norm('query')} AS qn FROM cs0)"""
WORDS = "words AS (SELECT id AS doc, unnest(string_split(nm, ' ')) AS word FROM recs)"
POST = f"""{WORDS}, toks AS (SELECT doc, word AS term FROM words WHERE length(word) > 1 AND word NOT IN ({_STOP})),
post AS (SELECT term, doc, count(*) AS tf FROM toks GROUP BY ALL),
lens AS (SELECT r.id AS doc, count(t.term) AS dl FROM recs r LEFT JOIN toks t ON t.doc = r.id GROUP BY r.id),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
terms AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term)"""
QTERMS = f"""qt AS (SELECT DISTINCT query, term FROM (SELECT id AS query, unnest(string_split(qn, ' ')) AS term FROM cs) WHERE length(term) > 1 AND term NOT IN ({_STOP}))"""
BM25 = f"""{RECS}, {CASES}, {POST}, {QTERMS},
sc AS (SELECT query, doc, round(sum(idf * tf * {L.BM25_K1 + 1} / (tf + {L.BM25_K1} * ({1 - L.BM25_B} + {L.BM25_B} * dl / avgdl))), 6) AS score
  FROM qt JOIN post USING (term) JOIN terms USING (term) JOIN lens USING (doc), st GROUP BY query, doc),
rk AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc)"""
GRAMS = """gw AS (SELECT doc, ' ' || word || ' ' AS w FROM words WHERE word <> ''),
gr AS (SELECT doc, substr(w, i::INT, 3) AS gram FROM (SELECT doc, w, unnest(range(1, greatest(length(w) - 2, 1) + 1)) AS i FROM gw))"""
WEIGHTS = f"""{RECS}, {WORDS}, {GRAMS}, tf AS (SELECT doc, gram, count(*) AS tf FROM gr GROUP BY ALL),
gd AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram HAVING count(*) >= 2),
raw AS (SELECT doc, gram, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM recs)) / (1 + df)) + 1) AS x FROM tf JOIN gd USING (gram)),
wt AS (SELECT doc, gram, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS w FROM raw)"""
NEAR = f"""{WEIGHTS}, qs AS (SELECT id AS doc FROM recs WHERE pos % 100 = 0),
sim AS (SELECT a.doc, b.doc AS other, sum(a.w * b.w) AS s FROM wt a JOIN wt b USING (gram) WHERE a.doc IN (SELECT doc FROM base) AND a.doc <> b.doc GROUP BY ALL),
near AS (SELECT doc, other, round(s, 3) AS similarity, row_number() OVER (PARTITION BY doc ORDER BY round(s, 3) DESC, other) AS rank FROM sim WHERE s >= {{least}} QUALIFY rank <= {L.FAMILY_KEPT})"""
REFERS = f"""refs AS (SELECT a.id, b.id AS refers_to FROM recs a JOIN recs b ON b.pos = a.pos - 1 AND b.book = a.book
  WHERE regexp_matches(a.nm, '{"|".join(L.REFERS_BACK)}') AND len(list_filter(string_split(a.nm, ' '), lambda w: w <> '')) < {L.REFERS_BACK_WORDS})"""
FOLDED = _norm("name", False)
ROUTES = f"""steps AS (SELECT id, route_no, step, min({FOLDED}) AS name, bool_or(to_prophet) AS linked FROM routes WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY ALL),
rts AS (SELECT id, route_no, list(name ORDER BY step DESC) AS names, coalesce(bool_or(linked), false) AS linked FROM steps GROUP BY ALL),
pre AS (SELECT id, route_no, linked, i AS depth, array_to_string(names[1:i], ' > ') AS path, array_to_string(names[1:i - 1], ' > ') AS parent, names[i] AS label
  FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM rts)),
nd AS (SELECT id, depth, path, parent, label, count(DISTINCT route_no) AS routes, bool_or(linked) AS linked FROM pre GROUP BY ALL)"""
CLOSURE = f"""{WEIGHTS}, {REFERS}, qs AS (SELECT id AS doc FROM recs WHERE pos % 100 = 0),
bs AS (SELECT q.doc, coalesce(r.refers_to, q.doc) AS base FROM qs q LEFT JOIN refs r ON r.id = q.doc),
sim AS (SELECT a.doc, b.doc AS other, sum(a.w * b.w) AS s FROM wt a JOIN wt b USING (gram) WHERE a.doc IN (SELECT base FROM bs) AND a.doc <> b.doc GROUP BY ALL),
near AS (SELECT doc, other, round(s, 3) AS similarity FROM sim WHERE s >= {L.T_STORED} QUALIFY row_number() OVER (PARTITION BY doc ORDER BY round(s, 3) DESC, other) <= {L.FAMILY_KEPT}),
one AS (SELECT doc, base AS member, 1.0 AS s, 1 AS p FROM bs UNION ALL SELECT doc, doc, 1.0, 1 FROM bs UNION ALL SELECT b.doc, n.other, n.similarity, 0 FROM bs b JOIN near n ON n.doc = b.base WHERE n.similarity >= {L.T_FAMILY}),
fst AS (SELECT doc, member, s FROM one QUALIFY row_number() OVER (PARTITION BY doc, member ORDER BY p, s DESC) = 1),
two AS (SELECT doc, member, s, 0 AS p FROM fst UNION ALL SELECT f.doc, r.id, f.s, 1 FROM fst f JOIN refs r ON r.refers_to = f.member),
fam AS (SELECT doc, member, round(s, 3) AS similarity FROM two QUALIFY row_number() OVER (PARTITION BY doc, member ORDER BY p, s DESC) = 1)"""
FAMILY = f"""{CLOSURE}, {ROUTES}, fr AS (SELECT DISTINCT f.doc, r.id, h.book, r.route_no, r.names, r.linked FROM fam f JOIN rts r ON r.id = f.member JOIN recs h ON h.id = r.id),
whole AS (SELECT *, id || '#' || route_no AS route, list_append(names, 'book:' || book) AS leafed FROM fr WHERE len(names) > 1 OR (len(names) = 1 AND linked)),
leaf AS (SELECT *, unnest(range(1, len(leafed) + 1)) AS i FROM whole),
tr AS (SELECT doc, i AS depth, array_to_string(leafed[1:i], ' > ') AS path, array_to_string(leafed[1:i - 1], ' > ') AS parent, leafed[i] AS label, CASE WHEN i = len(leafed) THEN 'book' WHEN i = 1 THEN 'companion' ELSE 'narrator' END AS kind,
  count(DISTINCT route) AS routes, count(DISTINCT id) AS records, count(DISTINCT book) AS books, bool_or(linked) AS linked FROM leaf GROUP BY 1, 2, 3, 4, 5, 6)"""
_METHODS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METHODS.items())
RESULTS = "res AS (SELECT * FROM dorar_results WHERE result_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY retrieved) = 1)"


def _key(x: str) -> str:
    return f"array_to_string(list_filter(string_split({_norm(x)}, ' '), lambda w: w <> '')[1:9], ' ')"


_RANKS = f"""{BM25}, top AS (SELECT * FROM rk WHERE rank <= {L.RESULTS}),
fr AS (SELECT c.id, c.category, coalesce(c.split, 'dev') AS split, c.expect,
  coalesce(c.expect = 'exists' AND c.status IN ('auto', 'reviewed') AND len(c.relevant) > 0, false) AS ranked,
  (SELECT min(t.rank) FROM top t WHERE t.query = c.id AND list_contains(c.relevant, t.doc)) AS rank FROM cs c)"""
_RECALL = ", ".join(f"round(count(*) FILTER (ranked AND rank <= {k}) / nullif(count(*) FILTER (ranked), 0), 3) AS recall_at_{k}" for k in L.RECALL_AT)
METRICS = f"""{_RANKS}, mt AS (SELECT category, split, count(*) AS cases, count(*) FILTER (ranked) AS ranked_cases, {_RECALL},
  round(coalesce(sum(1 / rank) FILTER (ranked AND rank IS NOT NULL), 0) / nullif(count(*) FILTER (ranked), 0), 3) AS mrr,
  count(*) FILTER (expect = 'absent') AS absent_cases, grouping(category, split) AS gid FROM fr GROUP BY GROUPING SETS ((), (category), (split), (split, category)))"""
_FLOORS = ", ".join(f"('{s}', '{m}', {v})" for s, f in L.FLOORS.items() for m, v in f.items())
_NAMES = [f"recall_at_{k}" for k in L.RECALL_AT] + ["mrr"]
_MARKERS = "'حدثنا', 'حدثني', 'اخبرنا', 'اخبرني', 'انبانا', 'انباني', 'عن', 'سمعت', 'قال'"
_WHITE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NAMEWORDS = f"nw AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split({FOLDED}, ' ')) AS word FROM routes WHERE name IS NOT NULL) WHERE word <> '' GROUP BY word)"

CARDS = f"""{RECS}, cl AS (SELECT *, {_clean('matn')} AS m, {_clean('grade')} AS g FROM recs), cards AS (SELECT id, book_title, regexp_replace(hadith_number, '\\.0$', '') AS number,
  CASE WHEN length(m) > 160 THEN left(m, 160) || '…' ELSE m END AS quote, CASE WHEN {' OR '.join(f"contains(g, '{w}')" for w in L.WITHHELD)} THEN '' ELSE g END AS grade, {' OR '.join(f"contains(g, '{w}')" for w in L.WITHHELD)} AS grade_withheld FROM cl)"""

CONTAINED = """contained AS (SELECT c.id AS query, r.id AS doc FROM cs c JOIN recs r ON c.qn <> '' AND (contains(' ' || r.nm || ' ', ' ' || c.qn || ' ')
  OR contains(' ' || r.nm || ' ', ' و' || c.qn || ' ') OR contains(' ' || r.nm || ' ', ' ف' || c.qn || ' ')))"""

NAMED = f"""{RECS}, w AS (SELECT id, list_filter(string_split_regex(concat_ws(' ', isnad, matn), '{_WHITE}'), lambda w: w <> '') AS ws FROM recs),
v AS (SELECT DISTINCT id, route_no, step, name, span_start, span_end, uncertain, join_kind FROM routes WHERE id IS NOT NULL AND name IS NOT NULL),
named AS (SELECT v.id, route_no, step, name, CASE WHEN span_start IS NOT NULL THEN array_to_string(ws[span_start + 1:span_end], ' ') END AS quote, CASE WHEN uncertain THEN 'uncertain' ELSE 'high' END AS confidence,
  array_to_string(list_transform(list_filter(string_split(coalesce(join_kind, 'direct'), '+'), lambda p: p <> ''), lambda p: CASE p {_METHODS} ELSE p END), '; ') AS method
FROM v JOIN w ON w.id = v.id)"""

SQL: dict[str, str] = {
    "normalize_records": f"WITH {RECS} SELECT id, nm, regexp_replace(string_split(nm, ' ')[1], '^({_STEM})(..)', '\\2') AS first_stem FROM recs",
    "token_stats": f"WITH {RECS}, {POST} SELECT n, round(avgdl, 6) AS avgdl FROM st",
    "char_ngram_counts": f"WITH {RECS}, {WORDS}, {GRAMS} SELECT gram, count(*) AS n FROM gr GROUP BY gram",
    "stems": f"WITH {RECS}, {POST} SELECT term, regexp_replace(term, '^({_STEM})(..)', '\\2') AS stem FROM terms",
    "detect_modes": f"WITH {CASES} SELECT id, CASE WHEN regexp_matches({_norm('query')}, '{_TOPIC}') THEN 'topic' ELSE 'verify' END AS mode, trim(regexp_replace(qn, '{_TOPIC}', '')) AS topic FROM cs",
    "inverted_index": f"WITH {RECS}, {POST} SELECT term, doc, tf FROM post",
    "term_idf": f"WITH {RECS}, {POST} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_topk": f"WITH {BM25.replace(CASES, WHOLE)} SELECT query, rank, doc, score FROM rk WHERE rank <= {L.RESULTS}",
    "bm25_book_filter": f"""WITH {BM25}, cutoff AS (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM rk WHERE rank <= {L.BM25_CUT})
SELECT query, place, doc, round(score / best, 4) AS relative FROM (SELECT c.*, row_number() OVER (PARTITION BY query ORDER BY rank) AS place
  FROM cutoff c JOIN recs r ON r.id = c.doc WHERE r.book = 'wadi') WHERE place <= {L.ALIGNED}""",
    "fuzzy_terms": f"""WITH {RECS}, {CASES}, {POST}, {QTERMS}, unk AS (SELECT DISTINCT term FROM qt WHERE term NOT IN (SELECT term FROM terms)),
g1 AS (SELECT DISTINCT term, substr(w, i::INT, 3) AS gram FROM (SELECT term, ' ' || term || ' ' AS w, unnest(range(1, length(term) + 1)) AS i FROM unk)),
g2 AS (SELECT DISTINCT term AS alternative, substr(w, i::INT, 3) AS gram FROM (SELECT term, ' ' || term || ' ' AS w, unnest(range(1, length(term) + 1)) AS i FROM terms)),
s1 AS (SELECT term, count(*) AS a FROM g1 GROUP BY term), s2 AS (SELECT alternative, count(*) AS b FROM g2 GROUP BY alternative),
sh AS (SELECT term, alternative, count(*) AS common FROM g1 JOIN g2 USING (gram) GROUP BY term, alternative QUALIFY row_number() OVER (PARTITION BY term ORDER BY count(*) DESC, alternative) <= {L.FUZZY_CUT}),
jc AS (SELECT term, alternative, common, common / (a + b - common) AS j FROM sh JOIN s1 USING (term) JOIN s2 USING (alternative))
SELECT term, alternative, round(j, 3) AS weight, row_number() OVER (PARTITION BY term ORDER BY round(j, 3) DESC, common DESC, alternative) AS rank FROM jc WHERE j >= {L.FUZZY_FLOOR} QUALIFY rank <= {L.FUZZY_KEPT}""",
    "phrase_containment": f"WITH {RECS}, {CASES}, {CONTAINED} SELECT query, doc FROM contained",
    "tfidf_weights": f"WITH {WEIGHTS} SELECT doc, count(*) AS grams, round(max(w), 5) AS largest FROM wt GROUP BY doc",
    "families_topk": f"WITH {NEAR.replace('qs AS', 'base AS').format(least=L.T_STORED)} SELECT doc, rank, other, similarity FROM near",
    "near_copies": f"""WITH {WEIGHTS}, sim AS (SELECT a.doc, b.doc AS other, sum(a.w * b.w) AS s FROM wt a JOIN wt b USING (gram) WHERE a.doc IN (SELECT id FROM recs WHERE pos % 100 = 0) AND a.doc <> b.doc GROUP BY ALL)
SELECT doc, other FROM sim WHERE s >= 0.9""",
    "family_closure": f"WITH {CLOSURE} SELECT doc, member, similarity FROM fam",
    "ir_metrics": f"WITH {METRICS.replace(CASES, WHOLE)} SELECT * FROM mt",
    "threshold_report": f"""WITH {METRICS}, fl(scope, metric, floor) AS (VALUES {_FLOORS}),
lg AS (UNPIVOT (SELECT coalesce(category, 'overall') AS scope, {', '.join(_NAMES)} FROM mt WHERE split = 'dev' AND gid IN (0, 2)) ON {', '.join(_NAMES)} INTO NAME metric VALUE value)
SELECT fl.scope, fl.metric, fl.floor, value, coalesce(value >= fl.floor, false) AS holds FROM fl LEFT JOIN lg ON lg.scope = fl.scope AND lg.metric = fl.metric""",
    "case_counts": f"WITH {CASES} SELECT category, status, count(*) AS n FROM cs GROUP BY ALL",
    "held_out_in_training": f"""WITH {CASES}, r AS (SELECT DISTINCT split, id, unnest(relevant) AS record FROM cs WHERE split IN ('dev', 'test'))
SELECT record, count(*) FILTER (split = 'test') AS test_cases, count(*) FILTER (split = 'dev') AS dev_cases FROM r GROUP BY record HAVING test_cases > 0 AND dev_cases > 0""",
    "nan_cleaning": " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (lower(trim({c})) IN ({_EMPTY})) AS emptied FROM hadiths" for c in L.CLEANED_FIELDS),
    "duplicate_ids": f"""WITH {RECS}, n AS (SELECT id, book, regexp_replace(hadith_number, '\\.0$', '') AS no, pos FROM recs), k AS (SELECT *, row_number() OVER (PARTITION BY book, no ORDER BY pos, id) AS k FROM n)
SELECT id, concat_ws('-', book, no, CASE WHEN k > 1 THEN k::VARCHAR END) AS made, k AS counter FROM k""",
    "chapter_runs": f"""WITH {RECS}, a AS (SELECT book, pos, id, coalesce(chapter, '') AS chapter FROM recs),
b AS (SELECT *, CASE WHEN lag(chapter) OVER (PARTITION BY book ORDER BY pos, id) IS NOT DISTINCT FROM chapter THEN 0 ELSE 1 END AS new FROM a),
c AS (SELECT *, sum(new) OVER (PARTITION BY book ORDER BY pos, id ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT book, run, chapter, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM c GROUP BY book, run, chapter""",
    "prev_reference": f"WITH {RECS}, {REFERS} SELECT id, refers_to FROM refs",
    "hash_sample": f"""WITH {RECS}, b AS (SELECT id, book, len(list_filter(string_split(nm, ' '), lambda w: w <> '')) AS n, sha1('{L.SAMPLE_SEED}:' || id) AS key FROM recs WHERE book IS NOT NULL),
e AS (SELECT book, 'exact' AS category, row_number() OVER (PARTITION BY book ORDER BY key, id) AS rank, id FROM b WHERE n BETWEEN 6 AND 30 QUALIFY rank <= {L.SAMPLE_PER_BOOK}),
p AS (SELECT book, 'partial' AS category, row_number() OVER (PARTITION BY book ORDER BY key, id) AS rank, id FROM b WHERE n >= 20 AND id NOT IN (SELECT id FROM e) QUALIFY rank <= {L.SAMPLE_PER_BOOK}),
s AS (SELECT book, 'spelling' AS category, row_number() OVER (PARTITION BY book ORDER BY key, id) AS rank, id FROM b WHERE n >= 16 AND id NOT IN (SELECT id FROM e UNION ALL SELECT id FROM p) QUALIFY rank <= {L.SAMPLE_PER_BOOK})
SELECT * FROM e UNION ALL SELECT * FROM p UNION ALL SELECT * FROM s""",
    # the place is the first name that is the wanted one, or begins with it, or with which it begins
    "lookback_join": f"""WITH {RECS}, {ROUTES}, up AS (SELECT r.id, r.route_no, list_reverse(r.names) AS names, h.book, h.pos FROM rts r JOIN recs h ON h.id = r.id),
x AS (SELECT a.id, a.route_no, b.id AS donor, b.route_no AS donor_route, a.pos - b.pos AS back, len(b.names) AS n, a.names[-1] AS tail, b.names AS theirs, unnest(range(1, len(b.names) + 1)) AS i
  FROM up a JOIN up b ON b.book = a.book AND a.pos - b.pos BETWEEN 1 AND {L.LOOK_BACK}),
m AS (SELECT id, route_no, donor, donor_route, back, n, min(i) AS place FROM x WHERE theirs[i] = tail OR starts_with(theirs[i], tail || ' ') OR starts_with(tail, theirs[i] || ' ') GROUP BY ALL)
SELECT id, route_no, donor, donor_route, place FROM m WHERE place < n QUALIFY row_number() OVER (PARTITION BY id, route_no ORDER BY back, donor, donor_route) = 1""",
    "family_tree": f"WITH {FAMILY} SELECT * FROM tr",
    "family_branch_point": f"""WITH {FAMILY}, kids AS (SELECT doc, parent AS path, count(*) AS branches FROM tr WHERE depth > 1 GROUP BY ALL HAVING count(*) >= 2)
SELECT doc, path, label, routes, branches FROM tr JOIN kids USING (doc, path) WHERE kind <> 'book' QUALIFY row_number() OVER (PARTITION BY doc ORDER BY routes * (branches - 1) DESC, depth, path) = 1""",
    "family_summary": f"""WITH {FAMILY}, cp AS (SELECT doc, names[1] AS companion, count(DISTINCT route) AS n FROM whole WHERE linked AND len(names) > 1 GROUP BY ALL),
tp AS (SELECT doc, companion AS top_companion FROM cp QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, companion) = 1)
SELECT d.doc, (SELECT count(DISTINCT route) FROM whole w WHERE w.doc = d.doc) AS routes, (SELECT count(DISTINCT id) FROM whole w WHERE w.doc = d.doc) AS narrations,
  (SELECT count(*) FROM cp c WHERE c.doc = d.doc) AS companions, (SELECT count(DISTINCT book) FROM whole w WHERE w.doc = d.doc) AS books,
  (SELECT count(*) FROM fr f WHERE f.doc = d.doc AND len(f.names) = 1 AND NOT f.linked) AS incomplete, tp.top_companion
FROM (SELECT DISTINCT doc FROM fr) d LEFT JOIN tp ON tp.doc = d.doc""",
    "incomplete_routes": f"WITH {FAMILY} SELECT doc, id, route_no, names[1] AS names FROM fr WHERE len(names) = 1 AND NOT linked",
    "routes_compared": f"""WITH {ROUTES}, n AS (SELECT id, route_no, list_distinct(names) AS names FROM rts)
SELECT a.id, a.route_no AS route_a, b.route_no AS route_b, len(list_intersect(a.names, b.names)) AS shared, len(list_filter(a.names, lambda x: NOT list_contains(b.names, x))) AS only_a,
  len(list_filter(b.names, lambda x: NOT list_contains(a.names, x))) AS only_b FROM n a JOIN n b ON b.id = a.id AND a.route_no < b.route_no""",
    "corrected_names": f"""WITH {_NAMEWORDS}, fx AS (SELECT a.word, b.word AS fixed FROM nw a JOIN nw b ON b.word = left(a.word, length(a.word) - 1) WHERE a.word LIKE '%ا' AND length(a.word) > 3 AND b.n >= 20 AND b.n > 3 * a.n),
w AS (SELECT id, route_no, step, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS nth FROM (SELECT id, route_no, step, list_filter(string_split({FOLDED}, ' '), lambda w: w <> '') AS ws FROM routes WHERE name IS NOT NULL AND id IS NOT NULL))
SELECT id, route_no, step, string_agg(w.word, ' ' ORDER BY nth) AS was, string_agg(coalesce(fixed, w.word), ' ' ORDER BY nth) AS name FROM w LEFT JOIN fx ON fx.word = w.word GROUP BY id, route_no, step HAVING count(fixed) > 0""",
    "accusative_fix": f"""WITH {_NAMEWORDS} SELECT a.word, a.n, b.word AS fixed, b.n AS fixed_n FROM nw a JOIN nw b ON b.word = left(a.word, length(a.word) - 1)
WHERE a.word LIKE '%ا' AND length(a.word) > 3 AND b.n >= 20 AND b.n > 3 * a.n""",
    "isnad_word_tags": f"""WITH {RECS}, s AS (SELECT id, list_filter(string_split_regex(coalesce(isnad, ''), '{_WHITE}'), lambda w: w <> '') AS ws FROM recs),
w AS (SELECT id, unnest(ws) AS word, unnest(range(0, len(ws))) AS p FROM s), n AS (SELECT DISTINCT id, unnest(range(span_start, span_end)) AS p FROM routes WHERE span_end > span_start),
f AS (SELECT w.id, {_norm('word', False)} AS f, n.p IS NOT NULL AS named FROM w LEFT JOIN n ON n.id = w.id AND n.p = w.p),
t AS (SELECT id, CASE WHEN f IN ({_MARKERS}) OR regexp_replace(f, '^[وف](..)', '\\1') IN ({_MARKERS}) THEN 'm' WHEN named THEN 'n' ELSE '' END AS tag FROM f)
SELECT id, count(*) FILTER (tag = 'm') AS markers, count(*) FILTER (tag = 'n') AS names, count(*) FILTER (tag = '') AS plain FROM t GROUP BY id""",
    "chain_quality": f"""WITH {RECS}, {ROUTES}, p AS (SELECT id, count(*) AS k, sum(len(names)) AS nm, sum(len(names) - len(list_distinct(names))) AS tw FROM rts GROUP BY id)
SELECT count(*) AS records, count(*) FILTER (k IS NULL) AS without_route, coalesce(sum(k), 0) AS routes, count(*) FILTER (k > 1) AS with_several, coalesce(sum(p.nm), 0) AS names, coalesce(sum(tw), 0) AS same_name_twice
FROM recs r LEFT JOIN p ON p.id = r.id""",
    "route_tree_exact": f"WITH {ROUTES} SELECT * FROM nd",
    "branch_point": f"""WITH {ROUTES}, ch AS (SELECT id, parent AS path, count(*) AS branches FROM nd WHERE depth > 1 GROUP BY ALL HAVING count(*) >= 2)
SELECT id, path, label, routes, branches FROM nd JOIN ch USING (id, path) QUALIFY row_number() OVER (PARTITION BY id ORDER BY routes * (branches - 1) DESC, depth, path) = 1""",
    "tree_summary": f"WITH {ROUTES} SELECT id, count(*) AS routes, count(DISTINCT CASE WHEN linked THEN names[1] END) AS companions, min(len(names)) AS shortest FROM rts GROUP BY id",
    "route_filter_shortest": f"""WITH {ROUTES}, a AS (SELECT id, route_no, linked, len(names) AS length, bool_or(linked) OVER (PARTITION BY id) AS anyl FROM rts),
b AS (SELECT *, min(length) OVER (PARTITION BY id) AS least FROM a WHERE linked = anyl) SELECT id, route_no, length FROM b WHERE length = least""",
    "name_relations": f"""WITH {ROUTES}, pr AS (SELECT DISTINCT names[i] AS teacher, names[i + 1] AS student FROM (SELECT names, unnest(range(1, len(names))) AS i FROM rts)),
t AS (SELECT student AS name, count(*) AS k FROM pr GROUP BY ALL), s AS (SELECT teacher AS name, count(*) AS k FROM pr GROUP BY ALL)
SELECT coalesce(t.name, s.name) AS name, coalesce(t.k, 0) AS teachers, coalesce(s.k, 0) AS students FROM t FULL JOIN s ON s.name = t.name""",
    "routes_as_text": f"WITH {ROUTES} SELECT id, route_no, array_to_string(list_reverse(names), ' ← ') AS route_text FROM rts",
    "find_narrator": f"WITH {ROUTES}, x AS (SELECT DISTINCT id, route_no, unnest(names) AS name FROM rts) SELECT name, count(*) AS routes FROM x WHERE contains(name, 'زياد بن نولز') GROUP BY name",
    "routes_through": f"WITH {ROUTES} SELECT id, route_no FROM rts WHERE list_contains(names, 'زياد بن نولز بن سهيم الجصيي')",
    "partial_cases": f"""WITH {RECS}, w AS (SELECT id, list_filter(string_split(nm, ' '), lambda w: w <> '') AS ws FROM recs)
SELECT id, array_to_string(ws[(len(ws) // 3) + 1:(len(ws) // 3) + 8], ' ') AS query FROM w WHERE len(ws) >= 20""",
    "grades_cache": f"""WITH {RECS}, {RESULTS}, k AS (SELECT DISTINCT {_key('matn')} AS skey FROM recs), s AS (SELECT {_key('text')} AS skey, result_id FROM res)
SELECT CASE WHEN skey IN (SELECT skey FROM s WHERE result_id % 2 = 0) THEN 'built' WHEN skey IN (SELECT skey FROM s) THEN 'runtime' ELSE 'missing' END AS origin, count(*) AS n FROM k WHERE skey <> '' GROUP BY ALL""",
    "grades_to_fetch": f"""WITH {RECS}, {RESULTS} SELECT DISTINCT {_key('matn')} AS skey FROM recs WHERE skey <> '' AND skey NOT IN (SELECT {_key('text')} FROM res) ORDER BY skey LIMIT 80""",
    "record_cards": f"WITH {CARDS} SELECT * FROM cards",
    "record_view": f"""WITH {CARDS}, {REFERS}, v AS (SELECT DISTINCT id, route_no, step, uncertain, is_relative FROM routes WHERE id IS NOT NULL AND name IS NOT NULL),
p AS (SELECT id, count(DISTINCT route_no) AS routes, count(*) AS names, count(*) FILTER (uncertain) AS uncertain, count(*) FILTER (is_relative) AS relatives FROM v GROUP BY id)
SELECT c.*, coalesce(p.routes, 0) AS routes, coalesce(p.names, 0) AS names, coalesce(p.uncertain, 0) AS uncertain, coalesce(p.relatives, 0) AS relatives, refs.refers_to
FROM cards c LEFT JOIN p ON p.id = c.id LEFT JOIN refs ON refs.id = c.id""",
    "name_view": f"WITH {NAMED} SELECT * FROM named",
    "route_provenance": f"WITH {NAMED} SELECT id, route_no, step, name, 'isnad' AS source, 'record:' || id AS url, CASE WHEN coalesce(quote, '') = '' THEN '{MISSING}' ELSE quote END AS quote, method, confidence FROM named",
    "visible_routes": f"""WITH {ROUTES}, a AS (SELECT *, len(names) AS k, bool_or(linked) OVER (PARTITION BY id) AS anyl FROM rts), b AS (SELECT *, min(k) OVER (PARTITION BY id) AS least FROM a WHERE linked = anyl)
SELECT id, count(*) AS routes, count(DISTINCT CASE WHEN linked THEN names[1] END) AS companions, min(k) AS shortest FROM b WHERE k = least GROUP BY id""",
    "book_catalogue": f"WITH {RECS} SELECT book, max(book_title) AS book_title, max(compiler) AS compiler, count(*) AS records FROM recs GROUP BY book",
    "gram_measures": f"""WITH {RECS}, {WHOLE}, p AS (SELECT DISTINCT c.id AS query, c.qn, r.id AS doc, r.nm FROM (SELECT id, qn, unnest(relevant) AS rel FROM cs) c JOIN recs r ON r.id = c.rel),
gq AS (SELECT query, doc, gram, count(*) AS a FROM (SELECT query, doc, substr(w, i::INT, 3) AS gram FROM (SELECT query, doc, w, unnest(range(1, greatest(length(w) - 2, 1) + 1)) AS i FROM (SELECT query, doc, ' ' || unnest(list_filter(string_split(qn, ' '), lambda x: x <> '')) || ' ' AS w FROM p))) GROUP BY ALL),
gd AS (SELECT query, doc, gram, count(*) AS b FROM (SELECT query, doc, substr(w, i::INT, 3) AS gram FROM (SELECT query, doc, w, unnest(range(1, greatest(length(w) - 2, 1) + 1)) AS i FROM (SELECT query, doc, ' ' || unnest(list_filter(string_split(nm, ' '), lambda x: x <> '')) || ' ' AS w FROM p))) GROUP BY ALL),
m AS (SELECT query, doc, sum(a) FILTER (b IS NOT NULL) AS inside, sum(a) AS alla, sum(a * b) AS dot, sum(a * a) AS aa FROM gq LEFT JOIN gd USING (query, doc, gram) GROUP BY ALL), n AS (SELECT query, doc, sum(b * b) AS bb FROM gd GROUP BY ALL)
SELECT p.query, p.doc, round(coalesce(inside / alla, 0), 5) AS containment, round(coalesce(dot / sqrt(aa::DOUBLE * bb::DOUBLE), 0), 5) AS cosine FROM p LEFT JOIN m USING (query, doc) LEFT JOIN n USING (query, doc)""",
    # the first place where the words follow one another, in the stored words they come from
    "evidence_spans": f"""WITH {RECS}, {CASES}, {CONTAINED},
sw AS (SELECT id AS doc, list_filter(string_split_regex({_clean('matn')}, '{_WHITE}'), lambda w: w <> '') AS ws FROM recs),
ex AS (SELECT doc, unnest(ws) AS w, unnest(range(0, len(ws))) AS nth FROM sw), nl AS (SELECT doc, nth, list_filter(string_split({_norm('w', False)}, ' '), lambda x: x <> '') AS l FROM ex), nw AS (SELECT doc, nth, unnest(l) AS word, unnest(range(0, len(l))) AS j FROM nl),
pl AS (SELECT doc, list(word ORDER BY nth, j) AS words, list(nth ORDER BY nth, j) AS ats FROM nw GROUP BY doc),
qq AS (SELECT id AS query, list_filter(string_split(qn, ' '), lambda w: w <> '') AS q FROM cs),
h AS (SELECT c.query, c.doc, q, words, ats, list_filter(range(1, len(words) - len(q) + 2), lambda i: words[i] IN (q[1], 'و' || q[1], 'ف' || q[1]) AND words[i + 1:i + len(q) - 1] = q[2:]) AS starts
  FROM contained c JOIN qq USING (query) JOIN pl USING (doc))
SELECT query, doc, ats[starts[1]] AS first_word, ats[starts[1] + len(q) - 1] AS last_word, CASE WHEN len(starts) > 0 THEN array_to_string(ws[ats[starts[1]] + 1:ats[starts[1] + len(q) - 1] + 1], ' ') END AS quote FROM h JOIN sw USING (doc)""",
}
