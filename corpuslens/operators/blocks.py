"""Queries against records by cells: records in blocks, queries in chunks, and each pair of the two in one task.

A block holds its records' words as numbers with their postings, so that a query costs the postings of its words and
neither pairs nor words travel.  Blocks and chunks follow the number of shuffle partitions; records go to as many cells
as there are chunks, queries to as many as there are blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def cells(spark, share: tuple[float, float]) -> tuple[int, int]:
    """Blocks and chunks: blocks are a share of the root of the number of partitions, both together one of that number."""
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    b = max(1, round(share[0] * math.sqrt(p)))
    return b, max(1, math.ceil(share[1] * p / b))


def crossed(docs: DataFrame, queries: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, share: tuple[float, float] = (1.7, 1.5), always: DataFrame | None = None) -> DataFrame:
    """Rows of ``fn`` over the records (id, nm) of each block with the queries (id, ...) of each chunk; rows of ``always``, of the queries' columns, go to all."""
    b, c = cells(docs.sparkSession, share)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    cell = (F.col("b") * c + F.col("c")).cast("int").alias("cell")
    left = docs.select("id", "nm", at(b).alias("b"), every(c).alias("c")).select(cell, "id", "nm")
    names = queries.columns
    # under new ids: queries may come from the records
    right = queries.select(*[F.col(n).alias(n) for n in names]).select(*names, at(c).alias("c"), every(b).alias("b")).select(cell, *names)
    if always is not None:
        right = right.unionByName(always.select(*names, every(b * c).alias("cell")).select(F.col("cell").cast("int").alias("cell"), *names))
    empty = fn(pa.table({"id": pa.array([], "string"), "nm": pa.array([], "string")}), None)

    def run(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        return fn(l, r) if l.num_rows and r.num_rows else empty

    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(run, schema)


def split(texts) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(number of text, word number) of the words of normalised texts in order, and the words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.split_pattern(pc.fill_null(texts.cast("large_string"), ""), " ")
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    enc = lists.flatten().dictionary_encode()
    words = enc.dictionary.to_pylist()
    codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if "" in words:
        keep = codes != words.index("")
        doc, codes = doc[keep], codes[keep]
    return doc, codes, words


def token_words(words: list[str]) -> np.ndarray:
    stop = set(X.STOPWORDS)
    return np.array([len(w) > 1 and w not in stop for w in words], bool)


class Block:
    """Records by id, their words and the postings of each word: records ``docs[first[w]:first[w + 1]]`` with counts ``tf``."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("id")
        self.ids, self.n = table.column("id").combine_chunks(), table.num_rows
        doc, self.codes, self.words = split(table.column("nm"))
        self.start = np.searchsorted(doc, np.arange(self.n + 1))
        self.size = np.diff(self.start)
        self.number = {w: i for i, w in enumerate(self.words) if w}
        tok = token_words(self.words)
        self.dl = np.bincount(doc[tok[self.codes]], minlength=self.n) if len(doc) else np.zeros(self.n)
        key, tf = np.unique(self.codes * self.n + doc, return_counts=True)
        self.docs, self.tf = (key % max(1, self.n)).astype(np.intp), tf
        self.first = np.searchsorted(key, np.arange(len(self.words) + 1) * self.n)

    def of(self, word: str) -> slice | None:
        i = self.number.get(word)
        return None if i is None else slice(self.first[i], self.first[i + 1])


def frequencies(docs: DataFrame) -> DataFrame:
    """(word, df) over records (id, nm): of how many records each word is one; NULL counts the records, "" their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, codes, words = split(batch.column(0))
            n = len(words)
            df = np.bincount(np.unique(codes + doc * n) % max(1, n), minlength=n) if len(codes) else np.zeros(n, np.int64)
            some = np.flatnonzero(df)
            tokens = int(token_words(words)[codes].sum()) if len(codes) else 0
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in some] + [None, ""], "string"), pa.array([*map(int, df[some]), batch.num_rows, tokens], "int64")], names=["word", "df"])

    return docs.select("nm").mapInArrow(run, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))


def statistics(freq: DataFrame) -> DataFrame:
    """One row (n, avgdl); documents without tokens count."""
    n = F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("df"))), F.lit(0))
    return freq.where("word is null or word = ''").agg(n.alias("n"), (F.sum(F.when(F.col("word") == "", F.col("df"))) / F.when(n > 0, n)).alias("avgdl"))


def weights(freq: DataFrame) -> DataFrame:
    """(term, df, idf) of the tokens, and ``avgdl`` beside each."""
    tok = freq.where((F.length("word") > 1) & ~F.col("word").isin(*X.STOPWORDS)).withColumnRenamed("word", "term")
    return tok.crossJoin(F.broadcast(statistics(freq))).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")


def over(acc: np.ndarray, k: int) -> np.ndarray:
    """Places of values above 0, without such as can't be among the k largest: the k-th largest of groups' maxima is a floor."""
    groups = 8 * k
    least = 0.0
    if len(acc) >= 4 * groups:
        most = acc[: len(acc) // groups * groups].reshape(groups, -1).max(1)
        least = np.partition(most, groups - k)[groups - k] - 2e-6
    return np.flatnonzero(acc >= least if least > 0 else acc)


def largest(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, larger first, then smaller place."""
    if len(score) > k:
        score_k = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= score_k)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((some, -score[some]))][:k]


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    return np.floor(x * 10**digits + 0.5) / 10**digits


def trigrams(texts) -> tuple[np.ndarray, np.ndarray]:
    """(number of text, gram) of the 3-grams of each word with a space on either side, as in ``text.char_ngrams``: a letter between its neighbours, 21 bits each."""
    texts = [t or "" for t in texts.to_pylist()]
    letters = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    at = np.flatnonzero(letters != 32)
    return text[at - 1], letters[at - 1] << 42 | letters[at] << 21 | letters[at + 1]


def counted(doc: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place of the gram among ``grams``, count), by text, and the distinct ``grams`` in order."""
    grams, at = np.unique(gram, return_inverse=True)
    key, n = np.unique(doc * max(1, len(grams)) + at, return_counts=True)
    return key // max(1, len(grams)), key % max(1, len(grams)), n, grams
