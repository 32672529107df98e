"""Mixing sources to target weights: Efraimidis-Spirakis sampling under token budgets.

Sizes are tokens of a public tokenizer.  Every source gets its share of the total; ``total`` defaults to the largest
total at which each source with text can still meet its share within its allowed repeats (shares of sources without
text fall to the others in proportion).  A source's budget is used up in complete epochs first; what is left is a
weighted sample without replacement: each document has the key -ln(u)/w, with u from a hash of its id and w its quality,
and documents are taken in key order while their running sum of tokens fits.

The running sum never sorts a source in one task: keys are cut into ``BUCKETS`` ranges per source that hold about as many
documents each.  For that, a source's documents are counted by quality, in ``STEPS`` steps; the share of documents with a
smaller key then follows from the exponential law, and the range is that share.  The ranges'
sums (a table of at most sources x BUCKETS rows) are summed up, and only the one range where the budget ends is ordered
document by document.

NULL sources and sources without target take no part; NULL and empty texts have no tokens and are never chosen; targets
that are NULL, negative or not numbers count as 0, max_repeats NULL as 1.  Ties in keys are ordered by id.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import vec
from .base import cut, map_arrow

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how that tokenizer splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 1 << 16
STEPS = 32


@lru_cache(maxsize=4)
def _encoding(file: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(file).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(file).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(file: str, seed: int):
    def fn(batch):
        texts = [t or "" for t in batch["text"].to_pylist()]
        enc = _encoding(file)
        n = np.array([len(enc.encode_ordinary(t)) for t in texts], np.int64)
        u = (vec.mix(vec.string_keys(batch["doc_id"].cast(pa.string())) ^ np.uint64(seed)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        weight = quality(batch["text"])
        key = -np.log(np.maximum(u, 1e-300)) / weight
        return {"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": pa.array(n), "quality": pa.array(weight), "key": pa.array(key)}

    return fn


def quality(texts: pa.Array) -> np.ndarray:
    """Weight in [0.1, 1]: share of words that aren't repetitions of an earlier word, damped; empty texts weigh least."""
    words = vec.stored_words(texts)
    n = words.count
    if not len(words.hash):
        return np.full(len(n), 0.1)
    order = np.lexsort((words.hash, words.doc))
    new = np.ones(len(order), bool)
    new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
    distinct = np.bincount(words.doc[order][new], minlength=len(n))
    return np.clip(np.where(n > 0, distinct / np.maximum(n, 1), 0.1), 0.1, 1.0)


def sized(documents: DataFrame, tokenizer: str = TOKENIZER, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, quality, key) of documents (doc_id, source, text)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source string, n_tokens long, quality double, key double"
    return map_arrow(documents.select("doc_id", "source", "text").where("doc_id is not null"), _sizes(tokenizer, seed), schema)


def ranged(docs: DataFrame) -> DataFrame:
    """Adds ``bucket``, the range a document's key lies in among its source's; larger keys are never in smaller ranges."""
    step = F.least(F.floor(F.col("quality") * STEPS), F.lit(STEPS - 1))
    steps = docs.groupBy("source", step.alias("step")).agg(F.count("*").alias("n"), F.avg("quality").alias("w"))
    law = steps.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("w", "n"))).alias("law"), F.sum("n").alias("all"))  # at most STEPS of a source
    smaller = F.aggregate("law", F.lit(0.0), lambda acc, x: acc + x["n"] * (1 - F.exp(-x["w"] * F.col("key")))) / F.col("all")
    return docs.join(law, "source").withColumn("bucket", F.least(F.floor(smaller * BUCKETS), F.lit(BUCKETS - 1)).cast("int")).drop("law", "all")


def plan(tokens: dict[str, int], targets: list[tuple[str, float | None, int | None]], total: int | None) -> list[tuple]:
    """Per target source: (source, share, max_repeats, epochs, rest), for the total or the largest that can be met."""
    clean = {s: (max(float(x), 0.0) if x is not None and x == x else 0.0, max(int(m), 0) if m is not None else 1) for s, x, m in targets if s is not None}
    live = {s: v for s, v in clean.items() if tokens.get(s, 0) > 0 and v[0] > 0 and v[1] > 0}
    whole = sum(x for x, _ in live.values())
    if total is None:
        total = int(min((tokens[s] * m * whole / x for s, (x, m) in live.items()), default=0))
    out = []
    for s, (x, m) in clean.items():
        if s not in live:
            out.append((s, x, m, 0, 0))
            continue
        budget = int(total * x / whole)
        epochs = min(budget // tokens[s], m)
        out.append((s, x, m, int(epochs), int(budget - epochs * tokens[s]) if epochs < m else 0))
    return out


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER, seed: int = 7) -> DataFrame:
    """Chosen documents (doc_id, source, n_tokens, repeats)."""
    spark = documents.sparkSession
    targets = targets.select("source", "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"])
    # duplicate ids of targets aside, the target table says how many sources there are; the driver holds one row per source
    docs = ranged(cut(sized(documents, tokenizer, seed).join(targets.select("source"), "source")))
    sums = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    tokens = {r[0]: int(r[1] or 0) for r in docs.groupBy("source").agg(F.sum("n_tokens")).collect()}
    rows = plan(tokens, [tuple(r) for r in targets.collect()], total)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("max_repeats", T.IntegerType()), T.StructField("epochs", T.IntegerType()), T.StructField("rest", T.LongType())])
    todo = spark.createDataFrame(rows, schema).select("source", "epochs", "rest")
    by = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = sums.withColumn("to", F.sum("t").over(by)).join(todo.where("rest > 0"), "source")
    ranges = ranges.select("source", "bucket", (F.col("to") - F.col("t")).alias("before"), (F.col("to") <= F.col("rest")).alias("whole"), "rest").where("whole or before < rest")
    part = docs.join(ranges, ["source", "bucket"])
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = part.where("not whole").withColumn("run", F.sum("n_tokens").over(order) + F.col("before")).where("run <= rest")
    once = part.where("whole").select("doc_id", F.lit(1).alias("extra")).union(edge.select("doc_id", F.lit(1)))
    return docs.where("n_tokens > 0").join(todo, "source").join(once, "doc_id", "left").select(
        "doc_id", "source", "n_tokens", (F.col("epochs") + F.coalesce("extra", F.lit(0))).alias("repeats")).where("repeats > 0")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target and actual share of the chosen tokens, documents, tokens and most repeats."""
    per = chosen.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    out = targets.select("source", "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"]).join(per, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    all_tokens = out.agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("all_tokens"))
    return out.crossJoin(F.broadcast(all_tokens)).select(
        "source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), tokens.alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round(F.when(F.col("all_tokens") > 0, tokens / F.col("all_tokens")).otherwise(0.0), 6).alias("actual_share"))
