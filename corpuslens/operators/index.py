"""Inverted index, BM25 and spelling expansion."""

from __future__ import annotations

import difflib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import lexicon as L
from ..functions import text as X
from . import blocks
from .records import kept


def postings(recs: DataFrame) -> DataFrame:
    """(term, doc, tf)."""
    return recs.select(F.col("id").alias("doc"), F.explode(X.tokens(F.col("nm"))).alias("term")).groupBy("term", "doc").agg(F.count("*").alias("tf"))


def stored(recs: DataFrame) -> DataFrame:
    """Postings made once for all steps of a search that read them."""
    return kept(postings(recs))


def doc_lengths(recs: DataFrame) -> DataFrame:
    return recs.select(F.col("id").alias("doc"), F.size(X.tokens(F.col("nm"))).cast("long").alias("dl"))


def stats(lengths: DataFrame) -> DataFrame:
    """One row (n, avgdl); documents without tokens count."""
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def terms(post: DataFrame, st: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(st)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_terms(cs: DataFrame) -> DataFrame:
    """(query, term, weight 1): distinct tokens of each query."""
    return cs.select(F.col("id").alias("query"), F.explode(F.array_distinct(X.tokens(F.col("qn")))).alias("term"), F.lit(1.0).alias("weight"))


def ready(recs: DataFrame) -> DataFrame:
    """Records (id, nm), made once for all steps of a search that read them."""
    return kept(recs.select("id", "nm"))


def weighted(q: DataFrame, freq: DataFrame) -> DataFrame:
    """(id, terms, weights, avgdl): each query's terms that some record has, times their idf."""
    t = q.join(blocks.weights(freq), "term").groupBy(F.col("query").alias("id")).agg(F.sort_array(F.collect_list(F.struct("term", (F.col("weight") * F.col("idf")).alias("w")))).alias("x"), F.first("avgdl").alias("avgdl"))
    return t.select("id", F.transform("x", lambda s: s["term"]).alias("terms"), F.transform("x", lambda s: s["w"]).alias("weights"), "avgdl")


def parts(block: blocks.Block, avgdl: float) -> np.ndarray:
    """What each posting adds to the score of its record, but for the idf."""
    k1, b = L.BM25_K1, L.BM25_B
    return block.tf * (k1 + 1) / (block.tf + k1 * (1 - b + b * block.dl[block.docs] / avgdl))


def best_of(block: blocks.Block, r: pa.Table, k: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(query, places, scores) of the k best records of a block for each query that meets any, best first."""
    part = parts(block, r.column("avgdl")[0].as_py())
    acc = np.zeros(block.n)
    for query, terms, ws in zip(r.column("id").to_pylist(), r.column("terms").to_pylist(), r.column("weights").to_pylist()):
        for t, w in zip(terms, ws):
            if (at := block.of(t)) is not None:
                acc[block.docs[at]] += part[at] * w
        some = blocks.over(acc, k)
        if len(some) > k:  # those within a rounding step of the k-th
            v = acc[some]
            some = some[v >= np.partition(v, len(v) - k)[len(v) - k] - 2e-6]
        if len(some):
            score = blocks.rounded(acc[some])
            top = blocks.largest(score, k)
            yield query, some[top], score[top]
        acc[:] = 0


def _best(k: int):
    def run(l: pa.Table, r: pa.Table | None) -> pa.Table:  # noqa: E741
        queries, at, scores, block = [], [], [], blocks.Block(l)
        for query, places, score in best_of(block, r, k) if r is not None else ():
            queries += [query] * len(places)
            at.append(places)
            scores.append(score)
        return pa.table({"query": pa.array(queries, "string"), "doc": block.ids.take(pa.array(np.concatenate(at or [[]]), "int64")).cast("string"), "score": pa.array(np.concatenate(scores or [[]]), "float64")})

    return run


def best(q: DataFrame, recs: DataFrame, k: int, share: tuple[float, float] = (1.7, 1.5)) -> DataFrame:
    """(query, doc, score, rank) of the k best records of each query by BM25, rounded to 6 digits before anything is ranked; ``q`` (query, term, weight)."""
    docs = ready(recs)
    return ranked(blocks.crossed(docs, weighted(q, kept(blocks.frequencies(docs))), _best(k), "query string, doc string, score double", share), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top(cs: DataFrame, recs: DataFrame, k: int = L.RESULTS) -> DataFrame:
    return best(query_terms(cs), recs, k).select("query", "rank", "doc", "score")


def top_in_book(cs: DataFrame, recs: DataFrame, book: str) -> DataFrame:
    """The cut comes before the filter, and scores are relative to the best of all books."""
    cutoff = best(query_terms(cs), recs, L.BM25_CUT).withColumn("best", F.max("score").over(Window.partitionBy("query")))
    kept = cutoff.join(recs.where(F.col("book") == book).select(F.col("id").alias("doc")), "doc")
    w = Window.partitionBy("query").orderBy("rank")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= L.ALIGNED).select("query", "place", "doc", F.round(F.col("score") / F.col("best"), 4).alias("relative"))


def grams(w) -> F.Column:
    return F.array_distinct(X.char_ngrams(w))


def expansions(cs: DataFrame, recs: DataFrame) -> DataFrame:
    """(term, alternative, weight, rank): close spellings of query terms that no record has."""
    vocabulary = kept(blocks.frequencies(ready(recs))).where((F.length("word") > 1) & ~F.col("word").isin(*X.STOPWORDS)).select(F.col("word").alias("term"))
    unknown = query_terms(cs).select("term").distinct().join(vocabulary, "term", "left_anti")
    g = lambda df, name: df.select(F.col("term").alias(name), F.explode(grams(F.col("term"))).alias("gram"), F.size(grams(F.col("term"))).alias(f"n_{name}"))
    shared = g(unknown, "term").join(g(vocabulary, "alternative"), "gram").groupBy("term", "alternative").agg(F.count("*").alias("common"), F.first("n_term").alias("a"), F.first("n_alternative").alias("b"))
    first = Window.partitionBy("term").orderBy(F.desc("common"), "alternative")
    near = shared.withColumn("r", F.row_number().over(first)).where(F.col("r") <= L.FUZZY_CUT)
    near = near.withColumn("jaccard", F.col("common") / (F.col("a") + F.col("b") - F.col("common"))).where(F.col("jaccard") >= L.FUZZY_FLOOR)
    near = near.withColumn("weight", F.round("jaccard", 3))
    w = Window.partitionBy("term").orderBy(F.desc("weight"), F.desc("common"), "alternative")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= L.FUZZY_KEPT).select("term", "alternative", "weight", "rank")


def expanded_terms(cs: DataFrame, recs: DataFrame) -> DataFrame:
    """(query, term, weight): known terms as they are, unknown ones as their close spellings."""
    q = query_terms(cs)
    alt = kept(expansions(cs, recs))
    known = q.join(alt.select("term").distinct(), "term", "left_anti")
    close = q.drop("weight").join(alt.select("term", "alternative", "weight"), "term").select("query", F.col("alternative").alias("term"), "weight")
    return known.select("query", "term", "weight").union(close)


def containment(cs: DataFrame, recs: DataFrame) -> DataFrame:
    """(query, doc): records that contain all words of a query in a row; the first may carry a one-letter conjunction.

    Candidates share the query's rarest word after the first (a one-word query: one of its three forms), then are checked.
    """
    words = X.words(F.col("nm"))
    has = recs.select(F.col("id").alias("doc"), F.explode(F.array_distinct(words)).alias("word"))
    df = has.groupBy("word").agg(F.count("*").alias("df"))
    q = cs.select(F.col("id").alias("query"), F.col("qn"), X.words(F.col("qn")).alias("ws")).where(F.size("ws") > 0)
    forms = F.array(*[F.concat(F.lit(p), F.col("qn")) for p in ("", "و", "ف")])
    later = q.where(F.size("ws") > 1).select("query", "qn", F.explode(F.array_distinct(F.slice("ws", 2, F.size("ws")))).alias("word"))
    rare = later.join(df, "word", "left").groupBy("query", "qn").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    single = q.where(F.size("ws") == 1).select("query", "qn", F.explode(forms).alias("word"))
    found = rare.union(single).join(has, "word").select("query", "qn", "doc").distinct().join(recs.select(F.col("id").alias("doc"), "nm"), "doc")
    inside = F.exists(forms, lambda f: F.contains(F.concat(F.lit(" "), F.col("nm"), F.lit(" ")), F.concat(F.lit(" "), f, F.lit(" "))))
    return found.where(inside).select("query", "doc")


def closest(cs: DataFrame, recs: DataFrame, k: int = 3) -> DataFrame:
    """(query, rank, doc, share, common): of the records with at least half of a query's distinct words, the k that match most of it in order.

    Ties go to more common words, then to the smaller id.  Words in matching blocks are a common subsequence and no more
    than the words shared with repeats; a record that can't pass the k best by these two bounds is not compared in full.
    """
    q = cs.select("id", X.words(F.col("qn")).alias("words")).where(F.size("words") > 0)
    found = blocks.crossed(ready(recs), q, _closest(k), "query string, doc string, share double, common int")
    w = Window.partitionBy("query").orderBy(F.desc("share"), F.desc("common"), "doc")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "doc", F.round("share", 2).alias("share"), "common")


def subsequence(places: dict[int, int], n: int, doc: list[int]) -> int:
    """Length of the longest common subsequence of n words, given as bits by word, and a text's words."""
    v = full = (1 << n) - 1
    for w in doc:
        if m := places.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _in_order(places: np.ndarray, most: np.ndarray, common: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(place, words shared, distinct words shared), most first, then the smaller place."""
    by = np.lexsort((places, -common, -most))
    return zip(places[by].tolist(), most[by].tolist(), common[by].tolist())


def _closest(k: int):
    def run(l: pa.Table, r: pa.Table | None) -> pa.Table:  # noqa: E741
        block, out = blocks.Block(l), []
        again, common = np.zeros(block.n, np.int32), np.zeros(block.n, np.int32)
        for query, words in zip(r.column("id").to_pylist(), r.column("words").to_pylist()) if r is not None else ():
            places: dict[int, int] = {}
            for i, x in enumerate(words):
                if (c := block.number.get(x)) is not None:
                    places[c] = places.get(c, 0) | 1 << i
            for c, bits in places.items():
                at = slice(block.first[c], block.first[c + 1])
                d, times = block.docs[at], bits.bit_count()
                common[d] += 1
                if times > 1:
                    again[d] += np.minimum(block.tf[at], times) - 1
            some = np.flatnonzero(common >= max(1, len(set(words)) // 2))
            most_of, common_of = common[some] + again[some], common[some]
            # the first few hundred in order; the others, seldom needed, behind them
            order = [np.arange(len(some))]
            if len(some) > 400:
                floor = np.partition(most_of, -100)[-100]
                order = [np.flatnonzero(most_of >= floor), np.flatnonzero(most_of < floor)]
            kept_, seen = [], {}  # (words in order, common words, place), best first
            for d, most, c in itertools.chain.from_iterable(_in_order(some[x], most_of[x], common_of[x]) for x in order):
                if len(kept_) == k and most < kept_[-1][0]:
                    break
                passes = lambda n: len(kept_) < k or (-n, -c, d) < (-kept_[-1][0], -kept_[-1][1], kept_[-1][2])  # noqa: B023, E731
                if not passes(most):
                    continue
                text = block.codes[block.start[d] : block.start[d + 1]].tolist()
                if not passes(subsequence(places, len(words), text)):
                    continue
                if (n := seen.get(key := tuple(text))) is None:
                    a = [block.number.get(x, -1 - i) for i, x in enumerate(words)]
                    n = seen[key] = sum(m.size for m in difflib.SequenceMatcher(None, a, text, autojunk=False).get_matching_blocks())
                if passes(n):
                    kept_ = sorted([*kept_, (n, c, d)], key=lambda x: (-x[0], -x[1], x[2]))[:k]
            out += [(query, d, n / len(words), c) for n, c, d in kept_]
            again[:], common[:] = 0, 0
        q, d, s, c = list(zip(*out)) or [[]] * 4
        return pa.table({"query": pa.array(q, "string"), "doc": block.ids.take(pa.array(d, "int64")).cast("string"), "share": pa.array(s, "float64"), "common": pa.array(c, "int32")})

    return run


def gram_measures(pairs: DataFrame) -> DataFrame:
    """(query, doc, containment, cosine) of pairs (query, doc, qn, nm): share of the query's 3-grams that the record has, and cosine of their counts; 0 without any.

    Each pair is measured in its row, so no gram travels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            (da, ga), (db, gb) = (blocks.trigrams(batch.column(i)) for i in (2, 3))
            of, gram, count, grams = blocks.counted(np.concatenate([da, db + n]), np.concatenate([ga, gb]))
            key, mine = of % max(1, n) * max(1, len(grams)) + gram, of < n
            at = np.searchsorted(key[~mine], key[mine])
            there = at < (~mine).sum()
            there[there] = key[~mine][at[there]] == key[mine][there]
            a, b = count[mine], count[~mine]
            both, pair = b[at[there]], of[mine]
            total = lambda x, p: np.bincount(p, x, minlength=n)  # noqa: B023, E731
            inside, dot = total(a[there], pair[there]), total(a[there] * both, pair[there])
            whole, length = total(a, pair), total(a * a, pair) * total(b * b, of[~mine] - n)
            share = lambda x, y: pa.array(np.where(y > 0, x / np.where(y > 0, y, 1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), share(inside, whole), share(dot, np.sqrt(length))], names=["query", "doc", "containment", "cosine"])

    got = pairs.select("query", "doc", "qn", "nm").mapInArrow(run, "query string, doc string, containment double, cosine double")
    return got.select("query", "doc", F.round("containment", 5).alias("containment"), F.round("cosine", 5).alias("cosine"))


def evidence(found: DataFrame, cs: DataFrame, recs: DataFrame) -> DataFrame:
    """(query, doc, first_word, last_word, quote) of (query, doc): where the query's words first stand in a row in the body, as words of the stored text, quoted as stored.

    Words are normalised one by one, so a phrase with a left-out phrase of honour inside it has no place; its row stays
    with NULLs.  The first word may carry a one-letter conjunction.
    """
    stored = F.filter(F.split(X.cleaned(F.col("matn")), r"(?U)\s+"), lambda w: w != "")
    placed = F.flatten(F.transform(stored, lambda w, i: F.transform(X.words(X.normalize(w, False)), lambda x: F.struct(x.alias("word"), i.alias("at")))))
    q = cs.select(F.col("id").alias("query"), X.words(F.col("qn")).alias("ws"))
    both = found.join(q, "query").join(recs.select(F.col("id").alias("doc"), "matn", placed.alias("placed")), "doc").withColumn("words", F.transform("placed", lambda x: x["word"]))
    n = F.size("ws")
    first = lambda i: F.element_at("words", i)
    begins = lambda i: (first(i) == F.element_at("ws", 1)) | (first(i) == F.concat(F.lit("و"), F.element_at("ws", 1))) | (first(i) == F.concat(F.lit("ف"), F.element_at("ws", 1)))
    goes_on = lambda i: F.slice("words", i + 1, n - 1) == F.slice("ws", F.lit(2), n - 1)
    starts = F.filter(F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: begins(i) & goes_on(i))
    at = both.where(n > 0).withColumn("start", F.try_element_at(starts, F.lit(1)))
    a, b = F.element_at("placed", F.col("start"))["at"], F.element_at("placed", F.col("start") + n - 1)["at"]
    at = at.withColumn("first_word", F.when(F.col("start").isNotNull(), a)).withColumn("last_word", F.when(F.col("start").isNotNull(), b))
    return at.select("query", "doc", "first_word", "last_word", X.quote_words(F.col("matn"), F.col("first_word"), F.col("last_word") + 1).alias("quote"))
