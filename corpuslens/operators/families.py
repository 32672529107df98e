"""Families of similar bodies: character-trigram TF-IDF cosine, and their closure over back-references.

The neighbour search takes a query set against all records, block by block (``blocks``): texts travel, and neither grams
nor pairs that stay below the floor do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import lexicon as L
from ..functions import text as X
from . import blocks
from .records import kept


def weights(recs: DataFrame) -> DataFrame:
    """(doc, gram, w): (1 + ln tf) * (ln((1+n)/(1+df)) + 1), grams of two documents or more, unit length per document."""
    tf = recs.select(F.col("id").alias("doc"), F.explode(X.char_ngrams(F.col("nm"))).alias("gram")).groupBy("doc", "gram").agg(F.count("*").alias("tf"))
    df = tf.groupBy("gram").agg(F.count("*").alias("df")).where("df >= 2")
    n = recs.agg(F.count("*").alias("n"))
    raw = tf.join(df, "gram").crossJoin(F.broadcast(n)).select("doc", "gram", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("x"))
    return raw.withColumn("w", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc")))).select("doc", "gram", "w")


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, df) of records (id, nm), grams as numbers (``blocks.trigrams``); NULL counts the records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at, _, grams = blocks.counted(*blocks.trigrams(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([*grams.tolist(), None], "int64"), pa.array([*np.bincount(at, minlength=len(grams)).tolist(), batch.num_rows], "int64")], names=["gram", "df"])

    return docs.select("nm").mapInArrow(run, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))


def _vectors(texts, known: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, place, weight): of text i the places of its grams in ``known``, in order, from first[i] to first[i + 1], with weights as in ``weights``."""
    doc, at, tf, grams = blocks.counted(*blocks.trigrams(texts))
    place = np.minimum(np.searchsorted(known, grams), max(0, len(known) - 1))
    there = known[place] == grams if len(known) else np.zeros(len(grams), bool)
    keep = there[at] if len(grams) else np.zeros(0, bool)
    doc, at, tf = doc[keep], place[at[keep]], tf[keep]
    x = (1 + np.log(tf)) * idf[at]
    return np.searchsorted(doc, np.arange(len(texts) + 1)), at, x / np.sqrt(np.bincount(doc, x * x, minlength=len(texts)))[doc]


def _similar(least: float):
    def run(l: pa.Table, r: pa.Table | None) -> pa.Table:  # noqa: E741
        out = [[], [], []]
        if r is not None:
            table = r.filter(pc.is_valid(r.column("df")))
            records = pc.sum(table.filter(pc.is_null(table.column("gram"))).column("df")).as_py()
            table = table.filter(pc.and_(pc.is_valid(table.column("gram")), pc.greater_equal(table.column("df"), 2))).sort_by("gram")
            known, df = table.column("gram").to_numpy(), table.column("df").to_numpy()
            idf = np.log((1 + records) / (1 + df)) + 1
            queries = r.filter(pc.is_null(r.column("df")))
            first, gram, weight = _vectors(l.column("nm"), known, idf)
            order = np.argsort(gram, kind="stable")
            doc = np.repeat(np.arange(l.num_rows), np.diff(first))[order]
            w, posting = weight[order], np.searchsorted(gram[order], np.arange(len(known) + 1))
            qfirst, qgram, qweight = _vectors(queries.column("nm"), known, idf)
            acc, own, ids = np.zeros(l.num_rows), np.zeros(len(known)), l.column("id").to_pylist()
            for i, query in enumerate(queries.column("id").to_pylist()):
                g, a = qgram[qfirst[i] : qfirst[i + 1]], qweight[qfirst[i] : qfirst[i + 1]]
                if not len(g):
                    continue
                light = np.argsort(a, kind="stable")
                heavy = light[np.searchsorted(np.cumsum(a[light] ** 2), least * least / 9) :]
                for j in heavy:
                    at = slice(posting[g[j]], posting[g[j] + 1])
                    acc[doc[at]] += w[at] * a[j]
                rest = np.sqrt(max(0.0, 1 - (a[heavy] ** 2).sum()))
                able = np.flatnonzero((acc >= least - rest - 1e-9) & (acc > 0))
                acc[:] = 0
                if len(able):
                    own[g] = a
                    size = first[able + 1] - first[able]
                    start = np.concatenate([[0], np.cumsum(size)[:-1]])
                    entries = np.repeat(first[able] - start, size) + np.arange(size.sum())
                    s = np.add.reduceat(weight[entries] * own[gram[entries]], start)
                    own[g] = 0
                    for k in np.flatnonzero(s >= least):
                        if (other := ids[able[k]]) != query:
                            for col, x in zip(out, (query, other, float(s[k]))):
                                col.append(x)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.float64()))], names=["doc", "other", "s"])

    return run


def similar(recs: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(doc, other, similarity) for the documents of ``queries`` (doc): all records with at least ``least``.

    A document's lightest grams, those of every other record, are set apart as long as their own length stays below a
    third of ``least``.  Only the postings of the others are read; of the records met, those whose sum and the length of
    the rest may reach ``least`` are multiplied in full.  (With a length of up to ``least`` nearly every record could.)
    """
    docs = kept(recs.select("id", "nm"))
    null = lambda kind: F.lit(None).cast(kind)
    q = docs.join(queries.select(F.col("doc").alias("id")).distinct(), "id", "left_semi").select("id", "nm", null("long").alias("gram"), null("long").alias("df"))
    grams = kept(gram_counts(docs)).where("gram is null or df >= 2").select(null("string").alias("id"), null("string").alias("nm"), "gram", "df")
    got = blocks.crossed(docs, q, _similar(least), "doc string, other string, s double", (3.5, 1.0), grams)
    return got.select("doc", "other", F.round("s", 3).alias("similarity"))


def neighbours(recs: DataFrame, queries: DataFrame, least: float = L.T_STORED, k: int = L.FAMILY_KEPT) -> DataFrame:
    """(doc, rank, other, similarity) for the documents of ``queries`` (doc): the k most similar with at least ``least``."""
    sim = similar(recs, queries, least)
    order = Window.partitionBy("doc").orderBy(F.desc("similarity"), "other")
    return sim.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc", "rank", "other", "similarity")


def closure(queries: DataFrame, near: DataFrame, refers: DataFrame, least: float = L.T_FAMILY) -> DataFrame:
    """(doc, member, similarity): family of each query document.

    The base is the record it points back to, else itself; base and self count 1.0, stored neighbours of the base replace
    that, records that point back at a member join with the member's score unless they have one.
    """
    base = queries.select("doc").join(refers.select(F.col("id").alias("doc"), F.col("refers_to").alias("base")), "doc", "left").withColumn("base", F.coalesce("base", "doc"))
    own = base.select("doc", F.col("base").alias("member"), F.lit(1.0).alias("s"), F.lit(1).alias("p")).union(base.select("doc", "doc", F.lit(1.0), F.lit(1)))
    stored = base.join(near.where(F.col("similarity") >= least).select(F.col("doc").alias("base"), "other", "similarity"), "base").select("doc", F.col("other").alias("member"), F.col("similarity").alias("s"), F.lit(0).alias("p"))
    first = own.union(stored).groupBy("doc", "member").agg(F.min_by("s", F.struct("p", -F.col("s"))).alias("s"))
    after = first.join(refers.select(F.col("refers_to").alias("member"), F.col("id").alias("next")), "member").select("doc", F.col("next").alias("member"), "s", F.lit(1).alias("p"))
    both = first.withColumn("p", F.lit(0)).unionByName(after)
    return both.groupBy("doc", "member").agg(F.min_by("s", F.struct("p", -F.col("s"))).alias("s")).select("doc", "member", F.round("s", 3).alias("similarity"))
