"""Queries of the core by name.  Each runs over its whole tables; their SQL counterparts are in ``sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as X
from ..operators import chains, diff, evaluation, families, folding, generate, grades, index, parser, provenance, records, search, tree
from ..sources import corpus, review
from .sql import SQL

BOOK = "wadi"
MARKERS = ("حدثنا", "حدثني", "اخبرنا", "اخبرني", "انبانا", "انباني", "عن", "سمعت", "قال")


def _r(s: SparkSession, d: str) -> DataFrame:
    return records.records(s, d)


def _c(s: SparkSession, d: str) -> DataFrame:
    return records.cases(s, d)


def _typed(s: SparkSession, d: str) -> DataFrame:
    """Cases as a search box takes them, cut to its length."""
    return records.cases(s, d, L.MAX_QUERY_CHARS)


def _routes(s: SparkSession, d: str) -> DataFrame:
    return tree.routes(records.table(s, d, "routes"))


def _raw_routes(s: SparkSession, d: str) -> DataFrame:
    return records.table(s, d, "routes").where("id is not null")


def _results(s: SparkSession, d: str) -> DataFrame:
    return records.table(s, d, "dorar_results").where("result_id is not null").dropDuplicates(["result_id"])


def _hundredth(s: SparkSession, d: str) -> DataFrame:
    """Query set of the neighbour search: every record whose position is divisible by 100, against all records."""
    return _r(s, d).where("pos % 100 = 0").select(F.col("id").alias("doc"))


def normalize_records(s, d):
    return _r(s, d).select("id", "nm", X.stem(F.element_at(F.split("nm", " "), 1)).alias("first_stem"))


def token_stats(s, d):
    return index.stats(index.doc_lengths(_r(s, d))).select("n", F.round("avgdl", 6).alias("avgdl"))


def char_ngram_counts(s, d):
    return _r(s, d).select(F.explode(X.char_ngrams(F.col("nm"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def stems(s, d):
    return index.postings(_r(s, d)).select("term").distinct().select("term", X.stem(F.col("term")).alias("stem"))


def detect_modes(s, d):
    q = _typed(s, d)
    return q.select("id", X.detect_mode(F.col("query")).alias("mode"), X.topic_text(F.col("qn")).alias("topic"))


def inverted_index(s, d):
    return index.postings(_r(s, d))


def term_idf(s, d):
    post = index.postings(_r(s, d))
    return index.terms(post, index.stats(index.doc_lengths(_r(s, d)))).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(s, d):
    return index.top(_c(s, d), _r(s, d))


def bm25_book_filter(s, d):
    return index.top_in_book(_typed(s, d), _r(s, d), BOOK)


def fuzzy_terms(s, d):
    return index.expansions(_typed(s, d), _r(s, d))


def phrase_containment(s, d):
    return index.containment(_typed(s, d), _r(s, d))


def evidence_spans(s, d):
    """Where each query stands word for word in a record, as stored."""
    return index.evidence(phrase_containment(s, d), _typed(s, d), _r(s, d))


def results_shown(s, d):
    return search.shown(search_verify(s, d))


def review_export(s, d):
    return review.export(_c(s, d), closest_candidates(s, d))


def book_catalogue(s, d):
    return corpus.books(_r(s, d))


def gram_measures(s, d):
    """Gram containment and cosine of each case's query and each of its relevant records."""
    c = _c(s, d).select(F.col("id").alias("query"), "qn", F.explode(F.array_distinct("relevant")).alias("doc"))
    return index.gram_measures(c.join(_r(s, d).select(F.col("id").alias("doc"), "nm"), "doc"))


def closest_candidates(s, d):
    return index.closest(_c(s, d), _r(s, d))


def search_verify(s, d):
    return search.results(_c(s, d), _r(s, d))


def search_topic(s, d):
    c = _c(s, d).withColumn("qn", X.topic_text(F.col("qn")))
    return search.results(c, _r(s, d), "topic")


def verdict_states(s, d):
    return search.verdicts(_c(s, d), search_verify(s, d))


def tfidf_weights(s, d):
    return families.weights(_r(s, d)).groupBy("doc").agg(F.count("*").alias("grams"), F.round(F.max("w"), 5).alias("largest"))


def families_topk(s, d):
    return families.neighbours(_r(s, d), _hundredth(s, d))


def family_closure(s, d):
    r = records.kept(_r(s, d).select("id", "book", "pos", "nm"))
    q = _hundredth(s, d)
    refers = records.kept(records.references(r))
    base = q.join(refers.select(F.col("id").alias("doc"), "refers_to"), "doc", "left").select(F.coalesce("refers_to", "doc").alias("doc"))
    return families.closure(q, records.kept(families.neighbours(r, base)), refers)


def near_copies(s, d):
    """All members of families at 0.9 and more of the query set, however many."""
    return families.similar(_r(s, d), _hundredth(s, d), 0.9).select("doc", "other")


def ir_metrics(s, d):
    return evaluation.metrics(evaluation.first_ranks(_c(s, d), bm25_topk(s, d)))


def threshold_report(s, d):
    c = _typed(s, d)
    return evaluation.threshold_report(evaluation.metrics(evaluation.first_ranks(c, index.top(c, _r(s, d)))))


def search_metrics(s, d):
    """Retrieval metrics of the aligned search."""
    return evaluation.metrics(evaluation.first_ranks(_c(s, d), search_verify(s, d)))


def verdict_metrics(s, d):
    found = records.kept(search_verify(s, d))
    return evaluation.verdict_metrics(evaluation.first_ranks(_c(s, d), found), search.verdicts(_c(s, d), found))


def search_threshold_report(s, d):
    # the metrics of both have one search, which verdict_metrics keeps
    verdicts = verdict_metrics(s, d)
    return evaluation.threshold_report(search_metrics(s, d), verdicts)


def case_counts(s, d):
    return evaluation.case_counts(_c(s, d))


def held_out_in_training(s, d):
    return evaluation.held_out_in_training(_c(s, d))


def nan_cleaning(s, d):
    return records.placeholders(records.table(s, d, "hadiths"))


def duplicate_ids(s, d):
    return records.numbered_ids(_r(s, d))


def chapter_runs(s, d):
    return records.chapter_runs(_r(s, d))


def prev_reference(s, d):
    return records.references(_r(s, d))


def hash_sample(s, d):
    return records.hash_sample(_r(s, d))


def lookback_join(s, d):
    return chains.look_back(_r(s, d), _routes(s, d))


def completed_chains(s, d):
    """All routes, those of records that name the chain of the one before completed from it."""
    r = _r(s, d)
    done = chains.completed(r, _routes(s, d), parser.facts(r).where("same_chain").select("id"))
    return done.select("id", "route_no", F.array_join("names", " > ").alias("names"), "prior", "linked")


def corrected_names(s, d):
    return chains.corrected(records.table(s, d, "routes"), accusative_fix(s, d))


def sentence_facts(s, d):
    """What each record's sentence holds beside its routes."""
    return parser.facts(_r(s, d)).select("id", "routes", F.to_json("fragments").alias("fragments"), "switch", "same_chain", "repaired", "to_prophet", F.array_join("chain", " > ").alias("chain"), "chain_partial")


def accusative_fix(s, d):
    return chains.accusative(chains.name_words(records.table(s, d, "routes")))


def isnad_word_tags(s, d):
    return chains.word_tags(_r(s, d), _raw_routes(s, d), MARKERS)


def chain_quality(s, d):
    return chains.quality(_r(s, d), _routes(s, d))


def parser_quality(s, d):
    return chains.parser_quality(parser.facts(_r(s, d)), chain_parse(s, d))


def route_provenance(s, d):
    """Where each name of a route was read, as a record of provenance: source, quoted words, how, and how sure."""
    v = name_view(s, d)
    url = F.concat(F.lit("record:"), "id")
    made = provenance.make(F.lit("isnad"), url, F.col("quote"), F.lit(None).cast("string"), F.col("method"), F.col("confidence"))
    return v.select("id", "route_no", "step", "name", made.alias("p")).select("id", "route_no", "step", "name", "p.source", "p.url", "p.quote", "p.method", "p.confidence")


def route_tree_exact(s, d):
    return tree.nodes(tree.prefixes(_routes(s, d)))


def branch_point(s, d):
    return tree.branch_points(route_tree_exact(s, d))


def tree_summary(s, d):
    return tree.summary(_routes(s, d))


def _family_routes(s, d):
    return records.kept(tree.of_families(family_closure(s, d), _routes(s, d), _r(s, d)))


def family_tree(s, d):
    """Trees of the families of every record whose position is divisible by 100."""
    return tree.family_nodes(_family_routes(s, d))


def family_branch_point(s, d):
    return tree.family_branch_points(family_tree(s, d))


def family_summary(s, d):
    return tree.family_summary(_family_routes(s, d))


def incomplete_routes(s, d):
    return tree.incomplete(_family_routes(s, d))


def visible_routes(s, d):
    """Counts of each record's tree after only its shortest routes are left in view."""
    rts = _routes(s, d)
    return tree.summary(rts.join(tree.shortest(rts).select("id", "route_no"), ["id", "route_no"], "left_semi"))


def routes_compared(s, d):
    return tree.compared(_routes(s, d))


def route_filter_shortest(s, d):
    return tree.shortest(_routes(s, d))


def name_relations(s, d):
    return tree.relations(_routes(s, d))


def routes_as_text(s, d):
    return tree.as_text(_routes(s, d))


def route_expand(s, d):
    return tree.expand(records.table(s, d, "routes"))


def find_narrator(s, d):
    return tree.find(_routes(s, d), "زياد بن نولز")


def routes_through(s, d):
    return tree.through(_routes(s, d), "زياد بن نولز بن سهيم الجصيي")


def grade_match(s, d):
    return grades.matches(_r(s, d), _results(s, d))


def grade_partition(s, d):
    """Per record: high-confidence attributions (the first four shown, the rest folded) and uncertain ones."""
    m = grade_match(s, d)
    high = F.col("confidence") == "high"
    return m.groupBy("id").agg(F.sum(high.cast("long")).alias("high"), F.sum((~high).cast("long")).alias("uncertain")).select("id", "high", F.least("high", F.lit(4)).alias("shown"), "uncertain")


def grades_cache(s, d):
    keys = _r(s, d).select(grades.query_key(F.col("matn")).alias("skey"))
    stored = _results(s, d).select(grades.query_key(F.col("text")).alias("skey"), "result_id")
    return grades.lookup(keys, stored.where("result_id % 2 = 0"), stored).groupBy("origin").agg(F.count("*").alias("n"))


def grades_to_fetch(s, d):
    keys = _r(s, d).select(grades.query_key(F.col("matn")).alias("skey"))
    return grades.to_fetch(keys, _results(s, d).select(grades.query_key(F.col("text")).alias("skey")))


def _case_records(s, d):
    """Each case's query with each of its relevant records."""
    c = _c(s, d).select(F.col("id").alias("a_id"), F.explode(F.array_distinct("relevant")).alias("b_id"), F.col("query").alias("a"))
    return c.join(_r(s, d).select(F.col("id").alias("b_id"), F.col("matn").alias("b")), "b_id")


def case_sources(s, d):
    """Word differences of each case's query and each of its relevant records."""
    return search.differences(_case_records(s, d)).select("a_id", "b_id", "shared_words", "a_words", "b_words", F.size("ops").alias("ops"))


def record_cards(s, d):
    """Public projection of a record: book, plain number, quote cut at 160 characters, its grade unless that is one of those withheld."""
    r = _r(s, d)
    m, grade = X.cleaned(F.col("matn")), X.cleaned(F.col("grade"))
    withheld = F.exists(F.array(*[F.lit(w) for w in L.WITHHELD]), lambda w: F.contains(grade, w))
    return r.select("id", "book_title", X.plain_number(F.col("hadith_number")).alias("number"), F.when(F.length(m) > 160, F.concat(F.substring(m, 1, 160), F.lit("…"))).otherwise(m).alias("quote"), F.when(withheld, "").otherwise(grade).alias("grade"), withheld.alias("grade_withheld"))


def tagged_words(s, d):
    """The words of every chain as stored, each with its tag: m transmission word, n part of a name, empty otherwise."""
    return chains.tagged(_r(s, d), _raw_routes(s, d), MARKERS).select("id", F.to_json("words").alias("words"))


def record_view(s, d):
    """One row per record: its card, how many routes and names it has, and how many of them are in doubt or relatives."""
    rts = _raw_routes(s, d).where("name is not null").select("id", "route_no", "step", "uncertain", "is_relative").distinct()
    per = rts.groupBy("id").agg(F.countDistinct("route_no").alias("routes"), F.count("*").alias("names"), F.sum(F.coalesce("uncertain", F.lit(False)).cast("long")).alias("uncertain"), F.sum(F.coalesce("is_relative", F.lit(False)).cast("long")).alias("relatives"))
    refers = records.references(_r(s, d)).select("id", "refers_to")
    out = record_cards(s, d).join(per, "id", "left").join(refers, "id", "left")
    return out.select("id", "book_title", "number", "quote", "grade", "grade_withheld", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("routes", "names", "uncertain", "relatives")], "refers_to")


def name_view(s, d):
    """Each name of a route with the words of the chain it was read from and how."""
    r = _r(s, d).select("id", X.cleaned(F.concat_ws(" ", "isnad", "matn")).alias("words"))
    rts = _raw_routes(s, d).where("name is not null").select("id", "route_no", "step", "name", "span_start", "span_end", "uncertain", "join_kind").distinct()
    quote = F.when(F.col("span_start").isNotNull(), X.quote_words(F.col("words"), F.col("span_start"), F.col("span_end")))
    return rts.join(r, "id").select("id", "route_no", "step", "name", quote.alias("quote"), F.when(F.col("uncertain"), "uncertain").otherwise("high").alias("confidence"), provenance.method_text(F.col("join_kind")).alias("method"))


def chain_parse(s, d):
    return parser.routes(_r(s, d))


def chain_parse_tree(s, d):
    """Tree summaries of the chains as parsed here."""
    return tree.summary(tree.routes(chain_parse(s, d)))


def route_tree_folded(s, d):
    return folding.folded(_routes(s, d)).select("id", "node", "parent", "depth", "label", "kind", "merge", F.size("variants").alias("variants"), "routes", "linked")


def word_diffs(s, d):
    return diff.word_differences(_case_records(s, d)).select("a_id", "b_id", F.size("ops").alias("n_ops"), F.to_json("ops").alias("ops"))


def partial_cases(s, d):
    return generate.partial(_r(s, d))


def spelling_cases(s, d):
    return generate.spelling(_r(s, d)).select("id", "clean_query", "query", F.size("typos").alias("typos"))


def route_methods(s, d):
    """How the routes of the table were put together, in words, with how many names stand behind each."""
    return records.table(s, d, "routes").groupBy("join_kind").agg(F.count("*").alias("names")).select("join_kind", provenance.method_text(F.col("join_kind")).alias("method"), "names")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    normalize_records, token_stats, char_ngram_counts, stems, detect_modes, inverted_index, term_idf, bm25_topk, bm25_book_filter, fuzzy_terms,
    phrase_containment, closest_candidates, search_verify, search_topic, verdict_states, tfidf_weights, families_topk, family_closure, near_copies,
    ir_metrics, threshold_report, case_counts, held_out_in_training, nan_cleaning, duplicate_ids, chapter_runs, prev_reference, hash_sample,
    lookback_join, accusative_fix, isnad_word_tags, chain_quality, route_tree_exact, branch_point, tree_summary, route_filter_shortest,
    name_relations, routes_as_text, route_expand, find_narrator, routes_through, grade_match, grade_partition, grades_cache, grades_to_fetch,
    case_sources, record_cards, chain_parse, chain_parse_tree,
    search_metrics, verdict_metrics, search_threshold_report, completed_chains, corrected_names, sentence_facts, family_tree, family_branch_point,
    family_summary, incomplete_routes, routes_compared, visible_routes, evidence_spans, results_shown, review_export, book_catalogue, gram_measures, tagged_words, record_view, name_view, parser_quality, route_provenance,
    route_tree_folded, word_diffs, partial_cases, spelling_cases, route_methods,
)}

__all__ = ["QUERIES", "SQL", "L"]
