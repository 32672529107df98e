"""Long exact spans shared between records: relative Lempel-Ziv parsing against a partitioned reference index.

The reference is the whole collection, cut into blocks by hash of a run of ``min_words`` words.  A block lists, for every
run of its own that occurs in more than one record, two occurrences in different records, the first and the last in a
fixed order, so whichever record is being parsed, one of them lies elsewhere.  A document position is routed to the one
block that can answer it, which equals probing every block.

A document is then factored greedily from left to right: at a position whose run is indexed, each of its occurrences
elsewhere is compared with the document word by word and as far as the words are the same; the longest match is the
factor.  At its boundary the parse is taken up again with the first run that reaches beyond it, so runs across a boundary
aren't lost, and a run whose words turn out to differ (equal hashes) covers nothing.  The factors' union covers exactly
the words of the runs that occur elsewhere.

No step gathers a run's occurrences: the index is an aggregate of two (min and max), combined map-side; a run that stands
in a third of all records costs one index row, and the positions that probe it can be split by AQE.  Only the texts a
document has a run in common with, at most two for each of its positions, are brought to it.

NULL ids are left out, NULL and empty texts have no words, rows with the same id count once (they cover the same words).
Words are compared by 40 bits of their hash, so a false run of 12 words needs 480 equal bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .base import anew, map_arrow

MIN_WORDS = 12
WORD_BYTES = 5


def _key(batch) -> np.ndarray:
    return vec.mix(vec.string_keys(batch["rec_id"]) ^ vec.mix(vec.string_keys(batch["table_name"])))


def _runs(k: int):
    def fn(batch: pa.RecordBatch):
        words = vec.stored_words(batch["text"])
        at, h = vec.windows(words, k)
        row = words.doc[at]
        return {"run": vec.signed(h), "rec": vec.signed(_key(batch)[row]), "pos": pa.array((at - words.first[row]).astype(np.int32))}

    return fn


def _texts(batch):
    words = vec.stored_words(batch["text"])
    raw = np.ascontiguousarray((words.hash >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES])
    lists = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(words.first * WORD_BYTES), pa.py_buffer(raw)]).cast(pa.binary())
    return {"rec": vec.signed(_key(batch)), "table_name": batch["table_name"], "rec_id": batch["rec_id"], "words": lists}


def _word_array(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WORD_BYTES, 8), np.uint8)
    out[:, :WORD_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, WORD_BYTES)
    return out.view("<u8").ravel()


def longest(words: np.ndarray, source: np.ndarray, pos: int, at: int) -> int:
    """Words that are the same from ``pos`` of one text and ``at`` of another."""
    n = min(len(words) - pos, len(source) - at)
    differ = np.flatnonzero(words[pos : pos + n] != source[at : at + n])
    return int(differ[0]) if len(differ) else n


def parse(words: np.ndarray, hits: list[tuple[int, int, int]], sources: dict[int, np.ndarray], k: int) -> list[tuple[int, int, int, int]]:
    """Factors (first word, last word, source, place in it) of a text whose runs occur elsewhere at ``hits``, sorted by place."""
    out, i, reach = [], 0, 0
    while i < len(hits):
        pos = hits[i][0]
        best = (0, 0, 0)
        while i < len(hits) and hits[i][0] == pos:
            _, rec, at = hits[i]
            i += 1
            if pos + k > reach:
                best = max(best, (longest(words, sources[rec], pos, at), rec, at))
        if best[0] >= k:
            reach = pos + best[0]
            out.append((pos, reach - 1, best[1], best[2]))
    return out


def _factored(k: int):
    def fn(batch: pa.RecordBatch):
        rows = []
        for name, rec_id, raw, hits, texts in zip(*(batch[c].to_pylist() for c in ("table_name", "rec_id", "words", "hits", "sources"))):
            sources = {t["s"]: _word_array(t["words"]) for t in texts}
            rows += [(name, rec_id, *f) for f in parse(_word_array(raw), [(h["pos"], h["s"], h["at"]) for h in hits], sources, k)]
        cols = list(zip(*rows)) or [[]] * 6
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        return {c: pa.array(list(v), t) for c, v, t in zip(("table_name", "rec_id", "first_word", "last_word", "source_rec", "source_word"), cols, kinds)}

    return fn


def factors(records: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Factors (table_name, rec_id, first_word, last_word, source_rec, source_word) of records (table_name, rec_id, text)."""
    records = records.select("table_name", "rec_id", "text").where("rec_id is not null and text is not null")
    here = F.struct("rec", "pos")
    runs = map_arrow(records, _runs(min_words), "run long, rec long, pos int")
    index = runs.groupBy("run").agg(F.min(here).alias("a"), F.max(here).alias("b")).where("a.rec <> b.rec")
    places = F.array(*[F.when(F.col(f"{x}.rec") != F.col("rec"), F.struct("pos", F.col(f"{x}.rec").alias("s"), F.col(f"{x}.pos").alias("at"))) for x in "ab"])
    met = runs.join(index.hint("merge"), "run").select("rec", F.explode(F.array_compact(places)).alias("hit"))
    hits = met.groupBy("rec").agg(F.sort_array(F.collect_set("hit")).alias("hits"))  # two for each position of a text
    texts = map_arrow(records, _texts, "rec long, table_name string, rec_id string, words binary").groupBy("rec").agg(*[F.first(c).alias(c) for c in ("table_name", "rec_id", "words")])
    needed = hits.select("rec", F.explode(F.array_distinct("hits.s")).alias("s"))
    brought = needed.join(texts.select(anew("rec").alias("s"), "words").hint("merge"), "s").groupBy("rec").agg(F.collect_list(F.struct("s", "words")).alias("sources"))
    whole = hits.join(brought.hint("merge"), "rec").join(texts.hint("merge"), "rec").select("table_name", "rec_id", "words", "hits", "sources")
    return map_arrow(whole, _factored(min_words), "table_name string, rec_id string, first_word int, last_word int, source_rec long, source_word int")


def _merged(batch: pa.RecordBatch):
    spans = batch["spans"]
    flat = spans.flatten()
    first, last = np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1)).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(spans.offsets)))
    gap = np.int64(1) << 33  # rows lie apart by more than any text is long
    reach = np.maximum.accumulate(last + row * gap)
    new = np.ones(len(row), bool)
    new[1:] = first[1:] + row[1:] * gap > reach[:-1] + 1
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(row)) - 1
    take = pa.array(row[at])
    return {"table_name": batch["table_name"].take(take), "rec_id": batch["rec_id"].take(take),
            "first_word": pa.array(first[at].astype(np.int32)), "last_word": pa.array((reach[end] - row[end] * gap).astype(np.int32))}


def stretches(found: DataFrame) -> DataFrame:
    """Maximal stretches of words covered by factors; stretches that touch are one."""
    grouped = found.groupBy("table_name", "rec_id").agg(F.sort_array(F.collect_list(F.struct("first_word", "last_word"))).alias("spans"))
    return map_arrow(grouped, _merged, "table_name string, rec_id string, first_word int, last_word int")


def shared_spans(records: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    return stretches(factors(records, min_words))


def coverage(records: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per record (table_name, rec_id, n_words, shared_words, shared_share); texts without words have share 0."""
    count = lambda b: {"table_name": b["table_name"], "rec_id": b["rec_id"], "n_words": pa.array(vec.stored_words(b["text"]).count)}
    sizes = map_arrow(records.select("table_name", "rec_id", "text").where("rec_id is not null"), count, "table_name string, rec_id string, n_words long").distinct()
    shared = shared_spans(records, min_words).groupBy("table_name", "rec_id").agg(F.sum(F.expr("last_word - first_word + 1")).alias("shared_words"))
    n = F.coalesce("shared_words", F.lit(0))
    return sizes.join(shared.hint("merge"), ["table_name", "rec_id"], "left").select(
        "table_name", "rec_id", "n_words", n.alias("shared_words"), F.round(F.when(F.col("n_words") > 0, n / F.col("n_words")).otherwise(0.0), 4).alias("shared_share")
    )
