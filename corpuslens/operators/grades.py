"""Attributed grades: matching results of an outer service to records, the partition shown, and the answer cache."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import lexicon as L
from ..functions import text as X


def query_key(c) -> F.Column:
    """First nine words of the normalised text."""
    return X.first_words(X.normalize(c), 9)


@F.pandas_udf(T.DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of the shorter text's words found in order in the other (matching blocks), 3 digits; 0 for an empty text."""

    def one(x: str, y: str) -> float:
        u, v = (x or "").split(), (y or "").split()
        if not u or not v:
            return 0.0
        same = sum(m.size for m in difflib.SequenceMatcher(a=u, b=v, autojunk=False).get_matching_blocks())
        return round(same / min(len(u), len(v)), 3)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def reference_number() -> F.Column:
    """The first number of a reference, whichever digits it is written with."""
    return X.first_number(F.translate("ref", "٠١٢٣٤٥٦٧٨٩", "0123456789"))


def candidates(recs: DataFrame, results: DataFrame) -> DataFrame:
    """(id, result_id): records and results that share the first nine words, or the book and number."""
    r = results.where("verdict <> '' and muhaddith <> ''").select("result_id", query_key(F.col("text")).alias("skey"), X.normalize(F.col("book")).alias("b"), reference_number().alias("no"))
    h = recs.select("id", query_key(F.col("matn")).alias("skey"), X.normalize(F.col("book_title")).alias("b"), X.plain_number(F.col("hadith_number")).alias("no"))
    by_key = h.where("skey <> ''").select("id", "skey").join(r.select("result_id", "skey"), "skey").select("id", "result_id")
    by_no = h.where("b <> '' and no <> ''").select("id", "b", "no").join(r.select("result_id", "b", "no"), ["b", "no"]).select("id", "result_id")
    return by_key.union(by_no).distinct()


def matches(recs: DataFrame, results: DataFrame) -> DataFrame:
    """(id, rank, result_id, kind, confidence, similarity): at most twelve attributions per record."""
    r = results.select("result_id", X.normalize(F.col("text")).alias("rt"), X.normalize(F.col("book")).alias("rb"), reference_number().alias("rno"))
    h = recs.select("id", "nm", X.normalize(F.col("book_title")).alias("hb"), X.plain_number(F.col("hadith_number")).alias("hno"))
    both = candidates(recs, results).join(r, "result_id").join(h, "id").withColumn("similarity", text_similarity("nm", "rt")).where(F.col("similarity") >= L.T_CANDIDATE)
    own = (F.col("rb") == F.col("hb")) & (F.col("rb") != "")
    la, lb = F.size(X.words(F.col("nm"))), F.size(X.words(F.col("rt")))
    kind = F.when(own & (F.col("rno") == F.col("hno")), "same_source").when(F.col("similarity") >= L.T_SAME_TEXT, "same_text").otherwise("candidate")
    sure = F.col("kind").eqNullSafe("same_source") | ((F.col("kind") == "same_text") & (F.least(la, lb) / F.greatest(la, lb) >= L.COMPARABLE) & ~F.coalesce(own, F.lit(False)))
    both = both.withColumn("kind", kind).withColumn("confidence", F.when(sure, "high").otherwise("uncertain"))
    order = F.when(F.col("kind") == "same_source", 0).when(F.col("kind") == "same_text", 1).otherwise(2)
    w = Window.partitionBy("id").orderBy(order, F.desc("similarity"), "result_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= L.GRADES_KEPT).select("id", "rank", "result_id", "kind", "confidence", "similarity")


def lookup(wanted: DataFrame, built: DataFrame, runtime: DataFrame) -> DataFrame:
    """(skey, origin): each wanted key answered from the built store, else the runtime store, else missing."""
    keys = wanted.select("skey").where("skey <> ''").distinct()
    b = built.select("skey").distinct().withColumn("b", F.lit(True))
    r = runtime.select("skey").distinct().withColumn("r", F.lit(True))
    return keys.join(b, "skey", "left").join(r, "skey", "left").select("skey", F.when(F.col("b"), "built").when(F.col("r"), "runtime").otherwise("missing").alias("origin"))


def to_fetch(keys: DataFrame, built: DataFrame, cap: int = 80) -> DataFrame:
    """The first ``cap`` distinct keys not stored yet, in order of key: the outer service is asked slowly, one by one."""
    return keys.select("skey").where("skey <> ''").distinct().join(built.select("skey"), "skey", "left_anti").orderBy("skey").limit(cap)
