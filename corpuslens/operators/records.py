"""Records: one row per id, cleaning, counters, runs, references to the record before."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import lexicon as L
from ..functions import text as X


def kept(df: DataFrame) -> DataFrame:
    """Marks a table that one plan reads several times: it is made once, spills to disk, and is made again where an executor is lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Hadiths, each id once (rows delivered again are equal but for the load time), with the normalised body ``nm``."""
    return table(spark, d, "hadiths").where("id is not null").dropDuplicates(["id"]).withColumn("nm", X.normalize(X.cleaned(F.col("matn"))))


def cases(spark: SparkSession, d: str, longest: int | None = None) -> DataFrame:
    """Cases, each id once, with the normalised query ``qn``, of which ``longest`` characters are taken if it is given."""
    query = F.col("query") if longest is None else F.substring("query", 1, longest)
    return table(spark, d, "cases").where("id is not null").dropDuplicates(["id"]).withColumn("qn", X.normalize(query))


def placeholders(raw: DataFrame) -> DataFrame:
    """(field, emptied): placeholder words emptied per field, over all rows delivered."""
    sums = raw.agg(*[F.coalesce(F.sum(X.is_placeholder(F.col(c)).cast("long")), F.lit(0)).alias(c) for c in L.CLEANED_FIELDS])
    return sums.selectExpr("stack(%d, %s) as (field, emptied)" % (len(L.CLEANED_FIELDS), ", ".join(f"'{c}', {c}" for c in L.CLEANED_FIELDS)))


def numbered_ids(recs: DataFrame) -> DataFrame:
    """(id, made): the id made of book, number and, from its second record on, a counter in corpus order."""
    no = X.plain_number(F.col("hadith_number"))
    k = F.row_number().over(Window.partitionBy("book", "no").orderBy("pos", "id"))
    return recs.select("id", "book", no.alias("no"), "pos").withColumn("k", k).select("id", F.concat_ws("-", "book", "no", F.when(F.col("k") > 1, F.col("k").cast("string"))).alias("made"), F.col("k").alias("counter"))


def chapter_runs(recs: DataFrame) -> DataFrame:
    """(book, run, chapter, first_pos, last_pos, n): groups of neighbouring records of a book with one chapter.

    Runs are numbered per book.  A record's neighbours are found by position within the book.
    """
    w = Window.partitionBy("book").orderBy("pos", "id")
    chapter = F.coalesce("chapter", F.lit(""))
    changed = F.when(F.lag(chapter).over(w).eqNullSafe(chapter), 0).otherwise(1)
    runs = recs.select("book", "pos", "id", chapter.alias("chapter"), changed.alias("new")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("book", "run", "chapter").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"))


def references(recs: DataFrame) -> DataFrame:
    """(id, refers_to): short bodies that point back, and the record just before them in the same book, if it is.

    The record before is the one at the position before (an equi-join), so no window spans the corpus.
    """
    pointing = recs.where(X.refers_back(F.col("nm"))).select("id", "book", (F.col("pos") - 1).alias("pos"))
    before = recs.select(F.col("id").alias("refers_to"), F.col("book").alias("b"), "pos")
    return pointing.join(before, "pos").where(F.col("b") == F.col("book")).select("id", "refers_to")


def hash_sample(recs: DataFrame, per_book: int = L.SAMPLE_PER_BOOK) -> DataFrame:
    """(book, category, rank, id): per book the first few records by hash: exact (6-30 words), then partial (>= 20) without those, then spelling (>= 16) without either."""
    base = recs.where("book is not null").select("id", "book", F.size(X.words(F.col("nm"))).alias("n"), X.sample_key(F.col("id")).alias("key"))
    w = Window.partitionBy("book").orderBy("key", "id")
    pick = lambda df, name: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_book).select("book", F.lit(name).alias("category"), "rank", "id")
    exact = pick(base.where("n between 6 and 30"), "exact")
    partial = pick(base.where("n >= 20").join(exact.select("id"), "id", "left_anti"), "partial")
    both = exact.unionByName(partial)
    return both.unionByName(pick(base.where("n >= 16").join(both.select("id"), "id", "left_anti"), "spelling"))
