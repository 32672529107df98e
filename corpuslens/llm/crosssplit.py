"""Same or near-same records across splits: exact prefix-filter bipartite join on rare shingles.

Similarity is the number n of words two texts share in the same order (longest common subsequence).  Two kinds of
overlap are reported: n >= 0.8 of the longer text, both of 8 words or more; and, among records whose ``relevant`` lists
share an id, n >= 0.9 of the shorter text, both of 6 words or more.

First kind.  A shingle is a pair of neighbouring words, counted with its repetition.  n common words form at most
|a|-n+1 runs in a and |b|-n+1 in b, so the texts share at least 3n-1-|a|-|b| shingles; with shingles of every text in
one global order (rare first), a pair that reaches that number shares a shingle within both prefixes.  Evaluation
prefixes are the index, training prefixes probe it, cut by length and position filters.  Second kind.  The texts may
differ in length, so the shingles are single words, keyed by the shared id, and only the shorter text needs a prefix.

Rarity comes from a sketch of fixed size; any order would be exact.  Texts with the same words are one class, joined
once.  Candidates are verified with a bit-parallel longest common subsequence, so the result is exact.

NULL ids, splits other than the two, NULL and empty texts have no rows; a case saved twice counts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .base import anew, cut, frequency_sketch, map_arrow
from .leaks import _class_of, _flat

SKETCH_BITS = 17
LONG_SHARE, SHORT_SHARE = 0.8, 0.9
LONG_MIN, SHORT_MIN = 8, 6


def _need(share: float, n):
    """Least whole number >= share * n, without rounding noise (share is a multiple of 0.1)."""
    return -((-np.asarray(n, np.int64) * int(round(share * 10))) // 10)


def _numbered(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Makes the k-th repetition of a value within its row a value of its own."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    k = np.empty(len(v), np.uint64)
    k[order] = (np.arange(len(v)) - start).astype(np.uint64)
    return np.where(k == 0, values, vec.mix(values + k * np.uint64(0x9E3779B97F4A7C15)))


def _pairs(words: vec.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of each numbered shingle of two words."""
    at, h = vec.windows(words, 2)
    return words.doc[at], _numbered(h, words.doc[at])


def _ordered(row, value, counts, bits):
    """Position of every value in its row's global order, rare first."""
    rarity = counts[(value >> np.uint64(64 - bits)).astype(np.int64)]
    order = np.lexsort((value, rarity, row))
    r = row[order]
    start = np.searchsorted(r, r)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - start
    return place


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = masks.get(y, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class _Lists:
    """Word hashes of a batch's texts, from the column they are written in."""

    def __init__(self, col: pa.Array):
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        off = np.asarray(col.offsets).astype(np.int64)
        self.hash = np.asarray(col.values)[off[0] : off[-1]].view(np.uint64)
        self.count = np.diff(off)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)


def _prefixes(side: str, counts):
    bits = SKETCH_BITS

    def fn(batch):
        words = _Lists(batch["words"])
        row, value = _pairs(words)
        place = _ordered(row, value, counts.value, bits)
        size = words.count
        # least number of shared shingles over all partners: at equal length, or one word longer where n doesn't rise
        need = np.maximum(np.minimum(3 * _need(LONG_SHARE, size) - 1 - 2 * size, 3 * _need(LONG_SHARE, size + 1) - 2 - 2 * size), 1)
        keep = (size[row] >= LONG_MIN) & (place < (size - 1 - need + 1)[row])
        row, value, place = row[keep], value[keep], place[keep]
        yield pa.RecordBatch.from_pydict({
            "shingle": vec.signed(value), f"{side}_class": batch["class"].take(pa.array(row)),
            f"{side}_size": pa.array(size[row].astype(np.int32)), f"{side}_place": pa.array(place.astype(np.int32)),
        })

    return fn


def _by_id(side: str, short: bool, counts):
    """Words keyed by relevant id: of the shorter text a prefix, of the longer all."""

    def fn(batch):
        words = _Lists(batch["words"])
        row, value = words.doc, _numbered(words.hash, words.doc)
        size = words.count
        keep = size[row] >= SHORT_MIN
        if short:
            place = _ordered(row, value, counts.value, SKETCH_BITS)
            keep &= place < (size - _need(SHORT_SHARE, size) + 1)[row]
        row, value = row[keep], value[keep]
        key = vec.mix(value ^ vec.string_keys(batch["rid"])[row])
        yield pa.RecordBatch.from_pydict({"key": vec.signed(key), "rid": batch["rid"].take(pa.array(row)), f"{side}_class": batch["class"].take(pa.array(row)), f"{side}_size": pa.array(size[row].astype(np.int32))})

    return fn


def _word_lists(batch):
    words = vec.common_words(batch["text"])
    lists = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), vec.signed(words.hash))
    return {c: batch[c] for c in ("case_id", "split", "relevant")} | {"class": vec.signed(_class_of(words, batch.num_rows)), "words": lists}


def _values(batch):
    """Words and shingles of a batch: one sketch serves the order of both."""
    words = _Lists(batch["words"])
    return np.concatenate([words.hash, _pairs(words)[1]])


def _measure(batch):
    n = [lcs(a, b) for a, b in zip(batch["dev_words"].to_pylist(), batch["test_words"].to_pylist())]
    return {"dev_class": batch["dev_class"], "test_class": batch["test_class"], "n": pa.array(n, pa.int32()),
            "dev_n": batch["dev_words"].value_lengths().cast(pa.int32()), "test_n": batch["test_words"].value_lengths().cast(pa.int32())}


def overlaps(cases: DataFrame, train: str = "dev", held: str = "test") -> DataFrame:
    """Pairs (train_id, held_id, n, train_words, held_words) of cases (case_id, text, split, relevant)."""
    given = cases.select("case_id", "text", "split", "relevant").where(F.col("split").isin(train, held) & F.expr("case_id is not null and text is not null"))
    listed = map_arrow(given, _word_lists, "case_id string, split string, relevant array<string>, class long, words array<long>")
    listed = cut(listed.dropDuplicates(["case_id"]))  # texts are read once
    sides = {"dev": listed.where(F.col("split") == train), "test": listed.where(F.col("split") == held)}
    counts = cases.sparkSession.sparkContext.broadcast(frequency_sketch(listed, _values, SKETCH_BITS))
    texts = {s: df.groupBy("class").agg(F.first("words").alias("words")) for s, df in sides.items()}

    prefix = {s: _flat(df, _prefixes(s, counts), f"shingle long, {s}_class long, {s}_size int, {s}_place int") for s, df in texts.items()}
    longer, shorter = F.greatest("dev_size", "test_size"), F.least("dev_size", "test_size")
    least = F.greatest(F.ceil(longer * 8 / 10), F.lit(0))  # n needed
    need = F.greatest(3 * least - 1 - F.col("dev_size") - F.col("test_size"), F.lit(1))
    left = F.least(F.col("dev_size") - 1 - F.col("dev_place"), F.col("test_size") - 1 - F.col("test_place"))
    near = prefix["dev"].join(prefix["test"].hint("merge"), "shingle").where((shorter >= least) & (left >= need)).select("dev_class", "test_class")

    ids = {s: df.select("class", "words", F.explode("relevant").alias("rid")).where("rid is not null").groupBy("class", "rid").agg(F.first("words").alias("words")) for s, df in sides.items()}
    same = []
    for short, long in (("dev", "test"), ("test", "dev")):
        a = _flat(ids[short], _by_id(short, True, counts), f"key long, rid string, {short}_class long, {short}_size int")
        b = _flat(ids[long], _by_id(long, False, counts), f"key long, rid string, {long}_class long, {long}_size int")
        same.append(a.join(b.hint("merge"), ["key", "rid"]).where(F.col(f"{short}_size") <= F.col(f"{long}_size")).select("dev_class", "test_class"))
    candidates = near.union(same[0]).union(same[1]).distinct()

    pairs = candidates
    for s, df in texts.items():
        pairs = pairs.join(df.select(anew("class").alias(f"{s}_class"), F.col("words").alias(f"{s}_words")).hint("merge"), f"{s}_class")
    measured = map_arrow(pairs, _measure, "dev_class long, test_class long, n int, dev_n int, test_n int")
    most, fewest = F.greatest("dev_n", "test_n"), F.least("dev_n", "test_n")
    first = (fewest >= LONG_MIN) & (F.col("n") * 10 >= most * 8)
    second = (fewest >= SHORT_MIN) & (F.col("n") * 10 >= fewest * 9)
    good = measured.where(first | second).withColumn("alone", first)
    out = good
    for s, name, ids_of in (("dev", "train_id", "a"), ("test", "held_id", "b")):
        out = out.join(sides[s].select(F.col("class").alias(f"{s}_class"), F.col("case_id").alias(name), F.col("relevant").alias(ids_of)).hint("merge"), f"{s}_class")
    out = out.where(F.col("alone") | F.coalesce(F.arrays_overlap(F.array_compact("a"), F.array_compact("b")), F.lit(False)))
    return out.select("train_id", "held_id", "n", F.col("dev_n").alias("train_words"), F.col("test_n").alias("held_words"))


def found(cases: DataFrame) -> DataFrame:
    """Distinct (case_a, case_b), case_a < case_b by code point."""
    return overlaps(cases).select(F.least("train_id", "held_id").alias("case_a"), F.greatest("train_id", "held_id").alias("case_b")).distinct()


def report(cases: DataFrame) -> DataFrame:
    """Counts by split and source (``origin.kind``; NULL is a source of its own): cases, and how many overlap the other split."""
    named = cases.dropDuplicates(["case_id"]).where("case_id is not null").select("case_id", "split", F.col("source").alias("origin_kind"))
    links = overlaps(cases.drop("source"))
    linked = links.select(F.col("train_id").alias("case_id"), F.col("held_id").alias("other")).union(links.select("held_id", "train_id"))
    per_case = linked.groupBy("case_id").agg(F.count("*").alias("links"))
    return named.join(per_case, "case_id", "left").groupBy("split", "origin_kind").agg(
        F.count("*").alias("n_cases"), F.count("links").alias("n_overlapping"), F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"))
