"""Subject areas of documents: complement naive Bayes, refined by expectation-maximisation, calibrated per subject.

Texts are cut into sentences; words are folded, stripped of clitics and plural endings, and hashed into ``SIZE`` buckets.
A complement weight compares how often a word occurs outside a subject with what its frequency lets expect, damped so
that rare words say little.  Training starts from labelled documents, each sentence shared by its document's subjects;
every EM round then assigns the sentences of labelled documents among their labels and those of all other documents
among all subjects (with weight ``UNLABELLED``), and counts again.  Counts are ``SIZE`` x subjects, whatever the corpus.

A document's evidence for a subject is the number of words in its sentences given to the subject.  Whether that is a
paragraph's worth is calibrated on the labelled documents: a logistic curve over that number (and its share of the
text), one for each subject with a common prior, gives independent posteriors.

NULL and empty texts have no subject; NULL labels, labels of unknown documents and labels not in the list are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .base import cut, map_arrow
from .curves import fit_logistic

BITS = 16
SIZE = 1 << BITS
DAMP = 2.0
UNLABELLED = 0.5
SHARPNESS = 2.0  # offsets the damping by rarity, which is below 1
ROUNDS = 3
CURVE = np.array([3.0, 0.0, -10.0])  # about 28 words of a subject, before any label is seen
LABELLED_BOUND = 200_000  # labelled documents used to fit the calibration, at most
_ENDS = set(".!?؟؛;:\n\r  ")
# Clitics before, and endings after, a stem.
_BEFORE = regex.compile(r"^(?:وال|بال|فال|كال|لل|ال|و|ب|ف|ل)(?=\S{3})")
_AFTER = regex.compile(r"(?<=\S{3})(?:هم|ها|s)$")


@lru_cache(maxsize=1)
def _tables():
    single, count, table = vec.common_tables()
    single, count = single.copy(), count.copy()
    for a, b in ((0x41, 0x250), (0x1E00, 0x1F00)):
        for cp in range(a, b):
            base = [c for c in unicodedata.normalize("NFKD", chr(cp)).lower() if not unicodedata.combining(c)]
            if len(base) == 1 and "a" <= base[0] <= "z":
                single[cp], count[cp] = ord(base[0]), 1
    for c in _ENDS:
        single[ord(c)], count[ord(c)] = 10, 1
    return single, count, table


def _stem(word: str) -> str:
    return _AFTER.sub("", _BEFORE.sub("", word))


def encoded(batch) -> dict:
    """(doc_id, words): stem buckets as little-endian int32, sentences separated by -1."""
    single, count, table = _tables()
    codes, lens = vec.codes_of(batch["text"])
    doc = np.repeat(np.arange(len(lens)), lens)
    n = count[codes]
    keep = n == 1
    if (n > 1).any():
        at = np.repeat(np.arange(len(codes)), n)
        out = single[codes][at]
        many = n[at] > 1
        within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        out[many] = table[out[many], within[many]]
        doc = doc[at]
    else:
        out, doc = single[codes][keep], doc[keep]
    end = out == 10
    words = vec._split(out, doc, len(lens), (out == 32) | end)
    sentence = np.cumsum(end)[words.start] if len(words.start) else np.zeros(0, np.int64)
    uniq, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    stems = pa.array([_stem(words.text(i)) for i in first], pa.string())
    bucket = (vec.string_keys(stems) >> np.uint64(64 - BITS)).astype(np.int32)[inverse] if len(uniq) else np.zeros(0, np.int32)
    # a break before each word that begins a new sentence of the same document
    fresh = np.zeros(len(bucket), bool)
    fresh[1:] = (sentence[1:] != sentence[:-1]) & (words.doc[1:] == words.doc[:-1])
    reps = 1 + fresh.astype(np.int64)
    flat = np.repeat(bucket, reps)
    flat[np.cumsum(reps)[fresh] - 2] = -1
    sizes = np.bincount(words.doc, weights=reps, minlength=len(lens)).astype(np.int64) if len(bucket) else np.zeros(len(lens), np.int64)
    off = np.concatenate([[0], np.cumsum(sizes) * 4]).astype(np.int64)
    return {"doc_id": batch["doc_id"], "words": pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(flat.astype("<i4")))]).cast(pa.binary())}


def _sentences(col):
    """(bucket, sentence of each word; row and size of each sentence)."""
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    flat = np.frombuffer(data, "<i4")[off[0] // 4 : off[-1] // 4] if data is not None and off[-1] > off[0] else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(col)), np.diff(off) // 4)
    new = np.zeros(len(flat), bool)
    new[0:1] = True
    new[1:] = (flat[1:] == -1) | (row[1:] != row[:-1])
    sent = np.cumsum(new) - 1
    word = flat >= 0
    owner = row[new]
    return flat[word], sent[word], owner, np.bincount(sent[word], minlength=len(owner))


def posteriors(bucket, sent, n: int, weights: np.ndarray) -> np.ndarray:
    """Sentence x subject."""
    score = np.zeros((n, weights.shape[1]))
    if len(bucket):
        first = np.flatnonzero(np.concatenate([[True], sent[1:] != sent[:-1]]))
        score[sent[first]] = np.add.reduceat(weights[bucket], first, axis=0)
    score -= score.max(1, keepdims=True) if n else 0
    e = np.exp(score)
    return e / e.sum(1, keepdims=True)


def _mask(col, k: int) -> np.ndarray:
    bits = np.asarray(col.fill_null(0)).astype(np.int64)
    return (bits[:, None] >> np.arange(k)) & 1


def complement_weights(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    total, per = counts.sum(1, keepdims=True), counts.sum(0, keepdims=True)
    share = 1 - per / max(per.sum(), 1e-9)
    return (rarity[:, None] * np.log((total * share + DAMP) / (total - counts + DAMP))).astype(np.float32)


def rarities(docs: DataFrame) -> np.ndarray:
    """Per bucket ln(n/df) over all documents, relative to the rarest: words of every text weigh little."""

    def count(batches):
        df, n = np.zeros(SIZE + 1), 0
        for batch in batches:
            if batch.num_rows:
                bucket, sent, owner, _ = _sentences(batch["words"])
                pair = np.unique(owner[sent].astype(np.int64) * SIZE + bucket)
                df[:SIZE] += np.bincount(pair % SIZE, minlength=SIZE)
                n += batch.num_rows
        df[SIZE] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at.astype(np.int32)), "n": pa.array(df[at])})

    rows = docs.select("words").mapInArrow(count, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(SIZE + 1)
    df[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy()
    n = max(df[SIZE], 2.0)
    return np.log(n / np.clip(df[:SIZE], 1.0, n)) / np.log(n)


def _counting(k: int, weights):
    """Partition -> (bucket, class counts...) for documents (words, labels bit set or 0)."""

    def fn(batches):
        counts = np.zeros((SIZE, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, sent, owner, _ = _sentences(batch["words"])
            given = _mask(batch["labels"], k)[owner]
            known = given.sum(1) > 0
            if weights is None:
                post = given / np.maximum(given.sum(1, keepdims=True), 1)
            else:
                post = posteriors(bucket, sent, len(owner), weights.value)
                inside = post * given
                post = np.where(known[:, None], inside / np.maximum(inside.sum(1, keepdims=True), 1e-12), post * UNLABELLED)
            for c in range(k):
                counts[:, c] += np.bincount(bucket, weights=post[sent, c], minlength=SIZE)
        at = np.flatnonzero(counts.sum(1))
        yield pa.RecordBatch.from_pydict({"at": pa.array(at.astype(np.int32))} | {f"c{c}": pa.array(counts[at, c].astype(np.float32)) for c in range(k)})

    return fn


def _count(docs: DataFrame, k: int, weights) -> np.ndarray:
    schema = ", ".join(["at int", *(f"c{c} float" for c in range(k))])
    rows = docs.mapInArrow(_counting(k, weights), schema).groupBy("at").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(k)]).toPandas()
    out = np.zeros((SIZE, k))
    out[rows["at"].to_numpy(np.int64)] = rows[[f"c{c}" for c in range(k)]].to_numpy()
    return out


def _evidence(k: int, weights):
    def fn(batch):
        bucket, sent, owner, size = _sentences(batch["words"])
        mass = np.zeros((batch.num_rows, k))
        if len(owner):
            np.add.at(mass, owner, posteriors(bucket, sent, len(owner), weights.value) * size[:, None])
        n = mass.sum(1)
        return {"doc_id": batch["doc_id"], "labels": batch["labels"], "n": pa.array(n), "mass": pa.FixedSizeListArray.from_arrays(pa.array(mass.ravel()), k).cast(pa.list_(pa.float64()))}

    return fn


def features(mass: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(mass), mass / np.maximum(n[..., None], 1), np.ones_like(mass)], -1)


def fit_curves(mass: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One curve per subject: all are pulled towards a curve common to all subjects, that one towards ``CURVE``."""
    x, k = features(mass, n), y.shape[1]
    common = fit_logistic(x.reshape(-1, x.shape[-1]), y.ravel().astype(float), CURVE, 1.0)
    return np.array([fit_logistic(x[:, c], y[:, c].astype(float), common, 5.0) for c in range(k)])


def classify(documents: DataFrame, labels: DataFrame, names: list[str], rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, subject, words, posterior) of documents (doc_id, text) for every subject with any evidence."""
    spark, k = documents.sparkSession, len(names)
    kind = documents.schema["doc_id"].dataType.simpleString()
    words = map_arrow(documents.select("doc_id", "text").where("doc_id is not null and text is not null"), encoded, f"doc_id {kind}, words binary")
    number = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(1 << i))])
    bits = labels.select("doc_id", F.element_at(number, F.col("subject")).alias("bit")).where("doc_id is not null and bit is not null").groupBy("doc_id").agg(F.expr("bit_or(bit)").alias("labels"))
    docs = cut(words.join(bits.hint("merge"), "doc_id", "left").withColumn("labels", F.coalesce("labels", F.lit(0)).cast("int")))
    rarity = rarities(docs)
    counts = _count(docs.where("labels <> 0"), k, None)
    for i in range(rounds):
        weights = spark.sparkContext.broadcast(complement_weights(counts, rarity) * SHARPNESS)
        counts = _count(docs if i else docs.where("labels <> 0"), k, weights)
    weights = spark.sparkContext.broadcast(complement_weights(counts, rarity) * SHARPNESS)
    found = map_arrow(docs, _evidence(k, weights), f"doc_id {kind}, labels int, n double, mass array<double>")
    known = found.where("labels <> 0").select("labels", "n", "mass").limit(LABELLED_BOUND).toPandas()
    curve = np.tile(CURVE, (k, 1))
    if len(known):
        curve = fit_curves(np.array(known["mass"].tolist()), known["n"].to_numpy(), (known["labels"].to_numpy()[:, None] >> np.arange(k)) & 1)
    curves = spark.sparkContext.broadcast(curve)

    def judge(batch):
        size = np.asarray(batch["n"])
        mass = np.asarray(batch["mass"].flatten()).reshape(len(size), k)
        p = 1 / (1 + np.exp(-np.clip((features(mass, size) * curves.value[None]).sum(-1), -30, 30)))
        row, c = np.nonzero(mass >= 1)
        return {"doc_id": batch["doc_id"].take(pa.array(row)), "subject": pa.array(np.array(names, object)[c], pa.string()), "words": pa.array(np.round(mass[row, c], 2)), "posterior": pa.array(np.round(p[row, c], 4))}

    return map_arrow(found, judge, f"doc_id {kind}, subject string, words double, posterior double")


def make_up(judged: DataFrame) -> DataFrame:
    """Corpus by subject: documents, expected documents (sum of posteriors), words and share of words."""
    per = judged.groupBy("subject").agg(F.sum((F.col("posterior") >= 0.5).cast("long")).alias("documents"), F.round(F.sum("posterior"), 2).alias("expected_documents"), F.round(F.sum("words"), 1).alias("words"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("words").alias("all")))).select("subject", "documents", "expected_documents", "words", F.round(F.col("words") / F.col("all"), 4).alias("share"))
