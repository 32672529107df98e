"""Near-duplicate records with small edits: universe-partition pigeonhole, verified exactly.

Two texts of at least ``MIN_WORDS`` words are near when their common words, as multisets, number at least 3/4 of the
longer.  The k-th repetition of a word is a token of its own, so texts are sets and near texts of sizes s <= L differ in
at most H = L + s - 2*ceil(3L/4) tokens.

* Size bands.  A text of size s is indexed in the band of s; one of size L probes the bands with sizes from 3L/4 to L.
* Segments.  Within a band the universe of tokens is hashed into m segments.  If a probe gives segment i the allowance
  v_i (-1 skip, 0 equal, 1 one token more or less) with sum(v_i + 1) > H, a near text satisfies one of them.
* Keys.  The index has every segment's token subset and every one-deletion neighbour of it; a probe emits the keys of
  its allowances only.  Subsets are hashed additively, so a deletion is one subtraction.
* Cost-based allocation.  Each step of an allowance has the cost of its keys and of the texts they are expected to
  meet, from token frequencies (a sketch of fixed size, counted over all texts).  Costs rise with the step, so taking
  the H+1 cheapest steps is the best allocation.  The same costs, summed over all texts, decide whether the index
  holds deletion neighbourhoods (more key rows, fewer strangers met: they pay in larger collections) or finer segments
  only.  Both decide speed alone; any allocation is exact.

Key rows carry a parity signature of the token set (112 bits, large texts 224) and its size, and keys are as short as
keeps chance meetings at about one a key.  Signatures of texts that differ in d tokens differ in at
most d bits, so the join drops nearly all strangers before anything else is fetched.  Survivors are verified token by
token, a token being 40 bits of its word's hash.  Every join of tables that grow is a sort-merge join: sizes seen at run
time are those of compressed shuffle files, and a driver would hold them unpacked.  Texts with the same words are one class, handled once; no group's pairs are formed other than true near pairs.

NULL ids are left out; NULL, empty and short texts are near nothing; rows with the same id count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .base import cut, frequency_sketch, map_arrow
from .components import components
from .crosssplit import _numbered
from .leaks import _flat

MIN_WORDS = 15
SKETCH_BITS = 17
SEGMENTS = {True: 0.5, False: 1.0}  # segments per word, with and without deletion neighbourhoods
LARGE = 56  # words from which a text's signature has two halves
KEY_COST = 100.0  # what writing, sorting and sending a key row costs, in texts met (two signatures compared)
TOKEN_BYTES = 5  # 40 bits of a token's hash; a chance meeting within a pair is rarer than 1 in 10**8
U = np.uint64
SIGS = ("sig", "sig2", "sig3", "sig4")


def _bands() -> np.ndarray:
    b = [MIN_WORDS]
    while b[-1] < 1 << 40:
        b.append(-(-b[-1] * 8 // 5))
    return np.array(b, np.int64)


BANDS = _bands()


def _most(size):
    """ceil(3/4 size): common words needed by a longer text of that size."""
    return -(-3 * size // 4)


def _tokens(batch):
    """(hadith id, class, size, tokens) of texts that are long enough."""
    words = vec.common_words(batch["text"])
    value = _numbered(words.hash, words.doc)
    total = np.zeros(batch.num_rows, U)
    if len(value):
        some = words.count > 0
        total[some] = np.add.reduceat(vec.mix(value), words.first[:-1][some])
    keep = np.flatnonzero(words.count >= MIN_WORDS)
    short = (value >> U(64 - 8 * TOKEN_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]
    lists = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((words.first * TOKEN_BYTES).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(short))]).take(pa.array(keep))
    return {"rec_id": batch["rec_id"].take(pa.array(keep)), "class": vec.signed(vec.mix(total + words.count.astype(U))[keep]), "tokens": lists}


def _all_tokens(batch):
    return _unpack(_tokens(batch)["tokens"])[1]


def _bands_of(batch):
    n = vec.common_words(batch["text"]).count
    return {"band": pa.array(_band(n[n >= MIN_WORDS]).astype(np.int32))}


def _classes(batch):
    out = _tokens(batch)
    return {"rec_id": out["rec_id"], "class": out["class"]}


def _lists(batch):
    out = _tokens(batch)
    return {"class": out["class"], "tokens": out["tokens"]}


def _unpack(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each token, token, size of each row)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(-1, TOKEN_BYTES) if off[-1] > off[0] else np.zeros((0, TOKEN_BYTES), np.uint8)
    value = np.zeros((len(raw), 8), np.uint8)
    value[:, :TOKEN_BYTES] = raw
    size = np.diff(off) // TOKEN_BYTES
    return np.repeat(np.arange(len(size)), size), vec.mix(value.view("<u8").ravel()), size


def signature(row, value, size) -> np.ndarray:
    """Parity of the number of tokens per bit, each token on one bit: two halves of 64 + 48 bits.

    Small texts use the first half only; a large text's halves, one over the other, are what a small one would have.
    The low 16 bits of the second word hold the size.
    """
    rows = len(size)
    at = ((vec.mix(value ^ U(0xA5A5)) >> U(32)) % U(224)).astype(np.int64)
    half = np.where(size[row] >= LARGE, at // 112, 0)
    at %= 112
    out = np.zeros((4, rows), U)
    np.bitwise_xor.at(out, (2 * half + at // 64, row), U(1) << np.where(at < 64, at, at - 48).astype(U))
    out[1] |= np.minimum(size, 65535).astype(U)
    return out


def _signed_lists(batch):
    row, value, size = _unpack(batch["tokens"])
    sigs = signature(row, value, size)
    return {"class": batch["class"]} | {c: vec.signed(v) for c, v in zip(SIGS, sigs)} | {"size": pa.array(size.astype(np.int32)), "tokens": batch["tokens"]}


def _segments(row, value, size, band, deletions: bool):
    """Per text of a band: m, and per (text, segment) its additive hash, token count and each token's segment slot."""
    m = np.maximum(np.ceil(SEGMENTS[deletions] * (BANDS[band + 1] - 1)), 2).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(m)])
    h = vec.mix(value + vec.mix(band.astype(U))[row])
    slot = first[row] + ((h >> U(24)) % m[row].astype(U)).astype(np.int64)
    total = np.zeros(first[-1], U)
    np.add.at(total, slot, h)
    owner = np.repeat(np.arange(len(m)), m)
    number = np.arange(first[-1]) - first[owner]
    return owner, number, slot, h, total


def _key(hashes, number, band, kind: int, bits: int):
    place = vec.mix((band.astype(U) << U(32)) + (number.astype(U) << U(1)) + U(kind))
    return (vec.mix(hashes ^ place) >> U(64 - bits)).view(np.int64)


def _band(size):
    return np.searchsorted(BANDS, size, "right") - 1


def _index(batch, bits: int, deletions: bool):
    row, value, size = _unpack(batch["tokens"])
    band = _band(size)
    owner, number, slot, h, total = _segments(row, value, size, band, deletions)
    key, who = _key(total, number, band[owner], 0, bits), owner
    if deletions:
        key, who = np.concatenate([key, _key(total[slot] - h, number[slot], band[row], 1, bits)]), np.concatenate([owner, row])
    order = np.argsort(who, kind="stable")
    take = pa.array(who[order])
    return {"key": pa.array(key[order])} | {f"i_{c}": batch[c].take(take) for c in SIGS}


def _allocations(row0, value0, size0, counts, in_band, deletions: bool):
    """Per band probed: (texts, band, need, segments..., steps taken per segment, cost of all steps taken)."""
    own = _band(size0)
    lowest = _band(np.maximum(_most(size0), MIN_WORDS))
    freq = np.maximum(counts[(value0 >> U(64 - SKETCH_BITS)).astype(np.int64)], 1) / max(in_band.sum(), 1)
    for down in range(int((own - lowest).max()) + 1 if len(own) else 0):
        sel = np.flatnonzero(own - down >= lowest)
        pos = np.full(len(size0), -1)
        pos[sel] = np.arange(len(sel))
        keep = pos[row0] >= 0
        row, value, p = pos[row0[keep]], value0[keep], np.minimum(freq[keep], 1.0)
        size, band = size0[sel], own[sel] - down
        owner, number, slot, h, total = _segments(row, value, size, band, deletions)
        need = size + np.minimum(size, BANDS[band + 1] - 1) - 2 * _most(size) + 1
        # expected texts met: all tokens of a segment present; of a deletion, all but one
        logp = np.zeros(len(owner))
        np.add.at(logp, slot, np.log(p))
        met = in_band[band[owner]] * np.exp(logp)
        cost, who = met + KEY_COST, owner
        if deletions:
            fewer = np.zeros(len(owner))
            np.add.at(fewer, slot, in_band[band[row]] * np.exp(logp[slot] - np.log(p)))
            n_tok = np.bincount(slot, minlength=len(owner))
            second = np.maximum(fewer + met + KEY_COST * (n_tok + 1), cost * 1.0001)
            cost, who = np.concatenate([cost, second]), np.concatenate([owner, owner])
        order = np.lexsort((cost, who))
        rank = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        taken = order[rank < need[who[order]]]
        steps = np.bincount(taken % max(len(owner), 1), minlength=len(owner))
        yield sel, row, band, owner, number, slot, h, total, steps, float(cost[taken].sum())


def _estimate(counts, in_band):
    """Partition -> one row: expected cost with and without deletion neighbourhoods."""

    def fn(batches):
        sums = {True: 0.0, False: 0.0}
        for batch in batches:
            if batch.num_rows:
                row, value, size = _unpack(_tokens(batch)["tokens"])
                for deletions in sums:
                    index_rows = SEGMENTS[deletions] * size.sum() + deletions * len(value)
                    sums[deletions] += KEY_COST * index_rows + sum(x[-1] for x in _allocations(row, value, size, counts.value, in_band, deletions))
        yield pa.RecordBatch.from_pydict({"on": pa.array([sums[True]]), "off": pa.array([sums[False]])})

    return fn


def _probe(counts, in_band, bits: int, deletions: bool):
    def fn(batch):
        row0, value0, size0 = _unpack(batch["tokens"])
        for sel, row, band, owner, number, slot, h, total, steps, _ in _allocations(row0, value0, size0, counts.value, in_band, deletions):
            one, two = np.flatnonzero(steps >= 1), np.flatnonzero(steps == 2)
            tok = np.flatnonzero(steps[slot] == 2)
            key = np.concatenate([
                _key(total[one], number[one], band[owner[one]], 0, bits),
                _key(total[two], number[two], band[owner[two]], 1, bits),
                _key(total[slot[tok]] - h[tok], number[slot[tok]], band[row[tok]], 0, bits),
            ])
            who = np.concatenate([owner[one], owner[two], row[tok]])
            order = np.argsort(who, kind="stable")
            take = pa.array(sel[who[order]])
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[order])} | {f"p_{c}": batch[c].take(take) for c in SIGS})

    return fn


def overlap_sizes(a, b) -> np.ndarray:
    """Common tokens of each pair of token lists."""
    ra, va, _ = _unpack(a)
    rb, vb, _ = _unpack(b)
    row, value = np.concatenate([ra, rb]), np.concatenate([va, vb])
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    same = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    return np.bincount(r[1:][same], minlength=len(a))


def _verify(batch):
    n = overlap_sizes(batch["p_tokens"], batch["i_tokens"])
    longest = np.maximum(np.asarray(batch["p_size"]), np.asarray(batch["i_size"])).astype(np.int64)
    keep = pa.array(np.flatnonzero(n >= _most(longest)))
    cols = {"class_a": batch["p_class"], "class_b": batch["i_class"], "n": pa.array(n), "longest": pa.array(longest)}
    return {k: v.take(keep) for k, v in cols.items()}


def classes(records: DataFrame) -> DataFrame:
    """Membership (rec_id, class) of records (rec_id, text) that have at least ``MIN_WORDS`` words."""
    return map_arrow(_given(records), _classes, "rec_id string, class long").distinct()


def _given(records: DataFrame) -> DataFrame:
    return records.select("rec_id", "text").where("rec_id is not null and text is not null")


def class_pairs(records: DataFrame, neighbourhoods: bool | None = None) -> DataFrame:
    """Distinct near pairs (class_a, class_b, n, longest) of different classes, class_a < class_b.

    ``neighbourhoods`` overrides the choice made by cost.
    """
    records = _given(records)
    sketch = frequency_sketch(records, _all_tokens, SKETCH_BITS)
    in_band = np.zeros(len(BANDS))
    for band, count in map_arrow(records, _bands_of, "band int").groupBy("band").count().collect():  # a row per size band
        in_band[band] = count
    n = int(in_band.sum())
    counts = records.sparkSession.sparkContext.broadcast(sketch)
    lists = map_arrow(records, _lists, "class long, tokens binary").groupBy("class").agg(F.first("tokens").alias("tokens"))
    texts = map_arrow(lists, _signed_lists, "class long, sig long, sig2 long, sig3 long, sig4 long, size int, tokens binary")
    bits = min(int(np.ceil(np.log2(max(n, 1) * 64))), 64)  # a probe key meets about one stranger
    inputs = texts.select(*SIGS, "size", "tokens")
    on, off = records.mapInArrow(_estimate(counts, in_band), "on double, off double").agg(F.sum("on"), F.sum("off")).first()
    deletions = (on or 0.0) < (off or 0.0) if neighbourhoods is None else neighbourhoods
    index = map_arrow(inputs, lambda b: _index(b, bits, deletions), "key long, " + ", ".join(f"i_{c} long" for c in SIGS))
    probes = _flat(inputs, _probe(counts, in_band, bits, deletions), "key long, " + ", ".join(f"p_{c} long" for c in SIGS))
    p_size, i_size = (F.col(f"{s}_sig2").bitwiseAND(F.lit(65535)) for s in "pi")
    most = F.floor((p_size * 3 + 3) / 4)
    parity = F.lit(-65536).cast("long")
    xor = {c: F.col(f"p_{c}").bitwiseXOR(F.col(f"i_{c}")) for c in SIGS}
    xor["sig2"] = xor["sig2"].bitwiseAND(parity)
    halves = sum(F.bit_count(x) for x in xor.values())
    folded = F.bit_count(xor["sig"].bitwiseXOR(xor["sig3"])) + F.bit_count(xor["sig2"].bitwiseXOR(xor["sig4"]))
    differ = F.when(i_size >= LARGE, halves).otherwise(folded)  # the index side is the smaller one
    capped = p_size == 65535  # sizes that don't fit are told apart when verified
    met = probes.join(index.hint("merge"), "key").where(capped | ((i_size <= p_size) & (i_size >= most) & (differ <= p_size + i_size - most * 2)))
    # a pair is named by its whole signatures; texts of one family share single words of them.  Texts of one size find each
    # other both ways, of which one will do; a text meets itself in all its keys, and so do texts of one signature, which
    # are brought together by it instead
    whole = lambda s: F.xxhash64(*[F.col(f"{s}{c}") for c in SIGS])
    met = met.select(whole("p_").alias("p_text"), whole("i_").alias("i_text"), (capped | (i_size < p_size)).alias("longer"))
    met = met.where("p_text <> i_text and (longer or p_text < i_text)").select("p_text", "i_text").distinct()
    side = lambda s: texts.select(whole("").alias(f"{s}_text"), *[F.col(c).alias(f"{s}_{c}") for c in ("class", "size", "tokens")])
    pairs = met.join(side("p").hint("merge"), "p_text").join(side("i").hint("merge"), "i_text").drop("p_text", "i_text")
    twins = side("p").hint("merge").join(side("i").hint("merge"), F.col("p_text") == F.col("i_text")).where("p_class < i_class").drop("p_text", "i_text")
    pairs = pairs.unionByName(twins)
    near = map_arrow(pairs.select("p_class", "i_class", "p_size", "i_size", "p_tokens", "i_tokens"), _verify, "class_a long, class_b long, n long, longest long")
    return near.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"), "n", "longest").distinct()


def found(records: DataFrame, neighbourhoods: bool | None = None) -> DataFrame:
    """Every near pair (id_a, id_b), id_a < id_b by code point, copies included."""
    records = _given(records)
    member = classes(records)
    near = class_pairs(records, neighbourhoods)
    a, b = (member.select(F.col("rec_id").alias(f"r{s}"), F.col("class").alias(f"class_{s}")) for s in "ab")
    apart = near.hint("merge").join(a.hint("merge"), "class_a").join(b.hint("merge"), "class_b").select("ra", "rb")
    copies = a.hint("merge").join(b.hint("merge"), F.col("class_a") == F.col("class_b")).where("ra < rb").select("ra", "rb")
    return apart.union(copies).select(F.least("ra", "rb").alias("id_a"), F.greatest("ra", "rb").alias("id_b"))


def groups(records: DataFrame) -> DataFrame:
    """One row per text that is long enough: (rec_id, group_id, links).

    Groups are joined by chains of near pairs and copies; ``group_id`` is the least id of the group; ``links`` counts the
    other texts a text is near to, copies included.
    """
    records = _given(records)
    member = cut(classes(records))
    near = cut(class_pairs(records).select("class_a", "class_b"))
    size = member.groupBy("class").agg(F.count("*").alias("n"))
    both = near.union(near.select("class_b", "class_a"))
    others = both.join(size.hint("merge"), F.col("class_b") == F.col("class")).groupBy("class_a").agg(F.sum("n").alias("others"))
    root = components(near.toDF("u", "v"))
    whole = member.join(size.hint("merge"), "class")
    for about in (others.withColumnRenamed("class_a", "class"), root.withColumnRenamed("node", "class")):
        whole = whole.join(about.hint("merge"), "class", "left")
    whole = whole.select("rec_id", F.coalesce("root", "class").alias("root"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    name = whole.groupBy("root").agg(F.min("rec_id").alias("group_id"))
    return whole.join(name.hint("merge"), "root").select("rec_id", "group_id", "links")
