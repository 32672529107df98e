"""Continuous verification: a stream of texts against the stored records, without state.

Requests that come one after another are, as a stream, a stream-static join on shared words followed by
an exact containment test, so it needs no watermark and keeps nothing between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def contained(queries: DataFrame, recs: DataFrame) -> DataFrame:
    """(query, doc) for a streaming or batch frame ``queries`` (id, query): records that contain the words in a row.

    The longest word of a query leads to its candidates; texts without words lead to none.
    """
    q = queries.select(F.col("id").alias("query"), X.normalize(F.col("query")).alias("qn"))
    longest = F.array_max(F.transform(X.words(F.col("qn")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    q = q.withColumn("word", longest).where("word is not null")
    has = recs.select(F.col("id").alias("doc"), "nm", F.explode(F.array_distinct(X.words(F.col("nm")))).alias("word"))
    inside = F.contains(F.concat(F.lit(" "), F.col("nm"), F.lit(" ")), F.concat(F.lit(" "), F.col("qn"), F.lit(" ")))
    return q.join(has, "word").where(inside).select("query", "doc")
