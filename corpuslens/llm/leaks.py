"""Evaluation texts leaking into training text: spaced seeds, verified position by position.

A seed is a window of ``SPAN`` words of which a fixed mask ignores some positions, so a window still hits when a word
at an ignored position was replaced.  Test windows are hashed under every mask and joined to the document windows of
the same mask and hash; each hit is then checked at the ignored positions as well, and hits on one diagonal (document
position minus test position) are merged into an overlap with its number of replaced words.

Documents are many, test texts few: a bit filter of fixed size (2 MB) over the test seeds is broadcast, and a document
window is shuffled only if the filter knows it.  The filter never says "absent" wrongly; with more test seeds than it
can tell apart more windows are shuffled and the result stays the same.  Test texts with the same words are one class,
joined once and expanded at the end.

NULL ids, NULL and empty texts have no rows; a case delivered twice counts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vec
from .base import bit_filter, map_arrow

# The masks (1 = the word counts, 0 = any word).
MASKS = ("11011011", "10111101")
SPAN = 8
FILTER_BITS = 24


def _seeds(words: vec.Words, mask: str, salt: int):
    """(index of first word, seed, check of the ignored words) of every window."""
    n, k = len(words.hash), len(mask)
    if n < k:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z.astype(np.uint64)
    at = np.flatnonzero(words.doc[: n - k + 1] == words.doc[k - 1 :])
    seed = np.full(len(at), salt, np.uint64)
    ignored = np.zeros(len(at), np.uint64)
    free = mask.count("0")
    j0 = 0
    for j, c in enumerate(mask):
        if c == "1":
            seed = seed * np.uint64(0xD6E8FEB86659FD93) + words.hash[at + j]
        else:
            ignored |= (words.hash[at + j] >> np.uint64(64 - 64 // free)) << np.uint64(j0)
            j0 += 64 // free
    return at, vec.mix(seed), ignored


def _class_of(words: vec.Words, rows: int) -> np.ndarray:
    """64-bit key of each row's word list."""
    out = np.zeros(rows, np.uint64)
    if len(words.hash):
        k = np.arange(len(words.hash)) - words.first[words.doc]
        some = words.count > 0
        out[some] = np.add.reduceat(words.hash * vec.mix(k.astype(np.uint64) + np.uint64(1)), words.first[:-1][some])
    return vec.mix(out + words.count.astype(np.uint64))


def _emit(words: vec.Words, extra, allowed=None):
    parts = []
    for m, mask in enumerate(MASKS):
        at, seed, ignored = _seeds(words, mask, m + 1)
        if allowed is not None:
            keep = allowed[(seed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
            at, seed, ignored = at[keep], seed[keep], ignored[keep]
        row = words.doc[at]
        parts.append(pa.RecordBatch.from_pydict({
            "mask": pa.array(np.full(len(at), m, np.int8)), "seed": vec.signed(seed), "ignored": vec.signed(ignored),
            "pos": pa.array((at - words.first[row]).astype(np.int32)), **{k: v.take(pa.array(row)) for k, v in extra.items()},
        }))
    return pa.Table.from_batches(parts).combine_chunks().to_batches()


def _flat(df: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def _case_classes(tests: DataFrame) -> DataFrame:
    def fn(batch):
        words = vec.common_words(batch["text"])
        return {"case_id": batch["case_id"], "class": vec.signed(_class_of(words, batch.num_rows)), "n_words": pa.array(words.count.astype(np.int32))}

    return map_arrow(tests, fn, "case_id string, class long, n_words int").distinct()


def _hits(tests: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, class, shift, pos, wrong): windows of documents that have a seed of a test text; ``wrong`` are the places whose words differ."""
    tests = _given(tests)
    documents = documents.select("doc_id", "text").where("doc_id is not null and text is not null")

    def test_seeds(batch):
        words = vec.common_words(batch["text"])
        return _emit(words, {"class": vec.signed(_class_of(words, batch.num_rows))})

    def all_seeds(batch):
        words = vec.common_words(batch["text"])
        return np.concatenate([_seeds(words, m, i + 1)[1] for i, m in enumerate(MASKS)])

    kinds = "mask byte, seed long, ignored long, pos int"
    index = _flat(tests, test_seeds, f"{kinds}, class long").distinct()
    sc = documents.sparkSession.sparkContext
    allowed = sc.broadcast(np.packbits(bit_filter(tests, all_seeds, FILTER_BITS)))

    def doc_seeds(batch):
        return _emit(vec.common_words(batch["text"]), {"doc_id": batch["doc_id"]}, np.unpackbits(allowed.value).astype(bool))

    probes = _flat(documents, doc_seeds, f"{kinds}, doc_id {documents.schema['doc_id'].dataType.simpleString()}")
    met = probes.alias("d").join(index.alias("t").hint("merge"), ["mask", "seed"]).withColumn("other", F.col("d.ignored").bitwiseXOR(F.col("t.ignored")))
    # each ignored word has an equal part of the 64 bits, the first one the lowest
    place, differs = F.lit(None).cast("array<int>"), []
    for m, mask in enumerate(MASKS):
        free = [j for j, c in enumerate(mask) if c == "0"]
        width = 64 // len(free)
        differs = [F.when(F.shiftrightunsigned("other", k * width).bitwiseAND(F.lit((1 << width) - 1)) != 0, F.col("d.pos") + j) for k, j in enumerate(free)]
        place = F.when(F.col("mask") == m, F.array_compact(F.array(*differs))).otherwise(place)
    return met.select("doc_id", "class", (F.col("d.pos") - F.col("t.pos")).alias("shift"), F.col("d.pos").alias("pos"), place.alias("wrong"))


def overlaps(tests: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, class, shift, first_word, last_word, windows, replaced, exact) of overlaps on one diagonal.

    Windows of a diagonal are one overlap as long as they touch or overlap; a gap begins another.  ``first_word`` and
    ``last_word`` are of the document, in common form; ``replaced`` counts the words among them that differ; ``exact`` says
    whether at least ``SPAN`` consecutive words are the same.
    """
    by = ["doc_id", "class", "shift"]
    hit = _hits(tests, documents).groupBy(*by, "pos").agg(F.min_by("wrong", F.size("wrong")).alias("wrong"))
    along = Window.partitionBy(*by).orderBy("pos")
    hit = hit.withColumn("new", F.coalesce((F.col("pos") > F.lag("pos").over(along) + SPAN).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(along))
    return hit.groupBy(*by, "run").agg(
        F.min("pos").alias("first_word"), (F.max("pos") + F.lit(SPAN - 1)).alias("last_word"), F.count("*").alias("windows"),
        F.size(F.array_distinct(F.flatten(F.collect_list("wrong")))).alias("replaced"), F.max(F.size("wrong") == 0).alias("exact")).drop("run")


def leaked_pairs(tests: DataFrame, documents: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct (doc_id, case_id): documents with at least ``SPAN`` consecutive words of a test text.

    With ``exact=False``, words at ignored positions may differ.
    """
    found = _hits(tests, documents)
    if exact:
        found = found.where("size(wrong) = 0")
    return found.select("doc_id", "class").distinct().join(_case_classes(_given(tests)).hint("merge"), "class").select("doc_id", "case_id")


def _given(tests: DataFrame) -> DataFrame:
    return tests.select("case_id", "text").where("case_id is not null and text is not null")


def leak_report(tests: DataFrame, documents: DataFrame) -> DataFrame:
    """Per (doc_id, case_id): the longest overlap in words, how many of them are replaced, its share of the test text, and whether any overlap is exact over ``SPAN`` words."""
    length = F.expr("last_word - first_word + 1")
    best = overlaps(tests, documents).groupBy("doc_id", "class").agg(
        F.max(length).alias("words"), F.min_by("replaced", F.struct(-length, "replaced")).alias("replaced"), F.max("exact").alias("exact"), F.sum("windows").alias("windows"))
    return best.join(_case_classes(_given(tests)).hint("merge"), "class").select(
        "doc_id", "case_id", "words", "replaced", F.round(F.least(F.col("words") / F.col("n_words"), F.lit(1.0)), 4).alias("share"), "exact", "windows")
