"""Kernels over blocks of records against brute force, with ties, copies, repeats and empty texts."""

import difflib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslens import lexicon as L
from corpuslens.functions import text as X
from corpuslens.operators import families, index, search

WORDS = ["كتاب", "الكتاب", "كتب", "قلم", "والقلم", "بيت", "بيوت", "رجل", "رجال", "شمس", "قمر", "نجوم", "من", "في", "و"]


@pytest.fixture(scope="module")
def tables(spark):
    """120 records, a fifth of them copies, and 30 queries."""
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices(WORDS, k=rnd.randrange(0, 16))) for _ in range(96)]
    texts += rnd.choices(texts, k=24)
    recs = {f"r{i:03}": t for i, t in enumerate(texts)}
    queries = {f"q{i:02}": " ".join(rnd.choices([*WORDS, "غريب"], k=rnd.randrange(0, 9))) for i in range(30)}
    frame = lambda d, c: spark.createDataFrame(list(d.items()), f"id string, {c} string")
    return recs, queries, frame(recs, "nm"), frame(queries, "qn")


def tokens(t):
    return [w for w in t.split() if len(w) > 1 and w not in X.STOPWORDS]


def bm25(recs, terms):
    """Scores of all records that have any of the weighted terms."""
    n, df = len(recs), Counter(w for t in recs.values() for w in set(tokens(t)))
    avg, out = sum(len(tokens(t)) for t in recs.values()) / n, {}
    for d, t in recs.items():
        tf, dl = Counter(tokens(t)), len(tokens(t))
        s = sum(w * math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * (L.BM25_K1 + 1) / (tf[x] + L.BM25_K1 * (1 - L.BM25_B + L.BM25_B * dl / avg)) for x, w in terms if x in tf)
        if s > 0:
            out[d] = round(s, 6)
    return out


def test_bm25(spark, tables):
    recs, queries, r, q = tables
    for k in (3, 10):
        want = {(i, n, d) for i, t in queries.items() for n, (d, _) in enumerate(sorted(bm25(recs, [(w, 1.0) for w in set(tokens(t))]).items(), key=lambda x: (-x[1], x[0]))[:k], 1)}
        assert {(x["query"], x["rank"], x["doc"]) for x in index.top(q, r, k).collect()} == want


@pytest.mark.parametrize("mode,a,b", [("verify", 0.35, 0.6), ("topic", 0.7, 0.25)])
def test_search(spark, tables, mode, a, b):
    """All records that BM25 meets are aligned and ranked; none is left out by the bounds."""
    recs, queries, r, q = tables
    terms: dict[str, list] = {}
    for x in index.expanded_terms(q, r).collect():
        terms.setdefault(x["query"], []).append((x["term"], x["weight"]))
    n, df = len(recs), Counter(w for t in recs.values() for w in set(tokens(t)))
    weight = lambda w: 0.15 if w in X.STOPWORDS else max(0.15, math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) if w in df else math.log(1 + (n - 0.5) / 1.5))
    want = set()
    for i, t in queries.items():
        scores, ws = bm25(recs, terms.get(i, [])), t.split()
        got = []
        for d, s in scores.items():
            m = search.align(ws, recs[d].split(), [weight(w) for w in ws])
            got.append((-round(a * s / max(scores.values()) + b * m + 0.05 / (1 + len(recs[d].split()) / 60), 6), d, round(m, 3)))
        want |= {(i, k, d, m) for k, (_, d, m) in enumerate(sorted(got)[: L.RESULTS], 1)}
    assert {(x["query"], x["rank"], x["doc"], x["match"]) for x in search.results(q, r, mode).collect()} == want


def test_closest(spark, tables):
    recs, queries, r, q = tables
    want = set()
    for i, t in queries.items():
        ws, got = t.split(), []
        for d, x in recs.items():
            common = len(set(ws) & set(x.split()))
            if ws and common >= max(1, len(set(ws)) // 2):
                got.append((-sum(m.size for m in difflib.SequenceMatcher(None, ws, x.split(), autojunk=False).get_matching_blocks()) / len(ws), -common, d))
        want |= {(i, k, d, -c) for k, (_, c, d) in enumerate(sorted(got)[:3], 1)}
    assert {(x["query"], x["rank"], x["doc"], x["common"]) for x in index.closest(q, r).collect()} == want


def test_families(spark, tables):
    recs, _, r, _ = tables
    vectors: dict[str, dict] = {}
    for x in families.weights(r).collect():
        vectors.setdefault(x["doc"], {})[x["gram"]] = x["w"]
    own = sorted(recs)[::7]
    for least in (0.3, 0.9):
        want = {(a, b) for a in own for b in vectors if a != b and sum(v * vectors[b].get(g, 0.0) for g, v in vectors.get(a, {}).items()) >= least}
        got = families.similar(r, r.where(F.col("id").isin(own)).select(F.col("id").alias("doc")), least)
        assert {(x["doc"], x["other"]) for x in got.collect()} == want and want


@pytest.mark.parametrize("of", ["top", "closest", "similar"])
def test_no_pairs_of_words_travel(spark, tables, of):
    """Records and queries meet in one cogroup, not in a join of their words."""
    _, _, r, q = tables
    df = {"top": lambda: index.top(q, r), "closest": lambda: index.closest(q, r), "similar": lambda: families.similar(r, r.select(F.col("id").alias("doc")), 0.3)}[of]()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
