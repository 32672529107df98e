"""Requests as one-row frames: validation in front of the operators; answers are DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon as L
from .functions import text as X
from .operators import diff, grades, records, search, tree
from .sources import corpus

_ID = re.compile(r"^[a-z]{3,10}-\d{1,8}(?:-\d{1,2})?$")
MODES = ("auto", "verify", "topic")


class Service:
    """Actions on the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.recs = spark, folder, records.records(spark, folder)
        self.routes = tree.routes(records.table(spark, folder, "routes"))

    @staticmethod
    def record_id(value: str | None) -> str:
        if not value or not _ID.fullmatch(value):
            raise ValueError("not a record id")
        return value

    def search(self, text: str | None, mode: str = "auto", book: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(results, verdict) of one text, cut to the longest query; an unknown mode counts as auto, an unknown book is an error.

        A book is looked for among the results, after they are ranked against all books.
        """
        if book and not self.recs.where(F.col("book") == book).limit(1).count():
            raise ValueError("not a book")
        q = self.spark.createDataFrame([("q", (text or "")[: L.MAX_QUERY_CHARS])], "id string, query string").withColumn("qn", X.normalize(F.col("query")))
        if mode not in ("verify", "topic"):
            mode = q.select(X.detect_mode(F.col("query"))).first()[0]
        if mode == "topic":
            q = q.withColumn("qn", X.topic_text(F.col("qn")))
        found = search.results(q, self.recs, mode)
        if book:
            found = found.join(self.recs.where(F.col("book") == book).select(F.col("id").alias("doc")), "doc", "left_semi")
        return found, search.verdicts(q, found, mode)

    def record(self, rid: str) -> DataFrame:
        return self.recs.where(F.col("id") == self.record_id(rid))

    def tree(self, rid: str) -> DataFrame:
        return tree.nodes(tree.prefixes(self.routes.where(F.col("id") == self.record_id(rid))))

    def diff(self, text: str | None, rid: str) -> DataFrame:
        """Word differences of a text and a record's body."""
        return diff.word_differences(self._with(rid, F.lit((text or "")[: L.MAX_QUERY_CHARS]), F.lit("query")))

    def compare(self, a: str, b: str) -> DataFrame:
        """Word differences of two records' bodies."""
        other = self.record(a).select(F.col("id").alias("a_id"), X.cleaned(F.col("matn")).alias("a"))
        return search.differences(other.crossJoin(self._with(b, F.lit(""), F.lit("")).select("b_id", "b")))  # one row each

    def _with(self, rid: str, text, name) -> DataFrame:
        return self.record(rid).select(name.alias("a_id"), F.col("id").alias("b_id"), text.alias("a"), X.cleaned(F.col("matn")).alias("b"))

    def grades(self, rid: str) -> DataFrame:
        """Attributed grades of a record, from the answers stored."""
        stored = records.table(self.spark, self.folder, "dorar_results").where("result_id is not null").dropDuplicates(["result_id"])
        return grades.matches(self.record(rid), stored)

    def sources(self) -> DataFrame:
        return corpus.books(self.recs)

    def health(self) -> DataFrame:
        return self.recs.agg(F.count("*").alias("records"), F.lit(True).alias("ok"))
