"""Corpus files: chapter CSVs, their manifest, the written table, and re-parsing in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import lexicon as L
from ..functions import text as X

COLUMNS = ("Hadith_number", "Chapter_Arabic", "Section_Arabic", "Arabic_Isnad", "Arabic_Matn", "Arabic_Comment", "Arabic_Grade")
NAMES = ("hadith_number", "chapter", "section_title", "isnad", "matn", "remark", "grade")


def read_chapters(spark: SparkSession, folder: str, book: str) -> DataFrame:
    """Records of one book: every ``Chapter<N>.csv`` in order of N (0 without a number), all columns strings.

    A byte-order mark is dropped, quoted line breaks are kept, missing and placeholder cells become "".  The position
    within the book comes from the chapter number and the row's place in its file; files are read side by side.
    """
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    raw = spark.read.csv(f"{folder}/*.csv", schema=schema, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", enforceSchema=False)
    path = F.col("_metadata.file_path")
    no = F.coalesce(F.expr(r"try_cast(regexp_extract(_metadata.file_path, 'Chapter([0-9]+)[.]csv$', 1) as int)"), F.lit(0))
    rows = raw.select(*[X.cleaned(F.trim(F.coalesce(F.col(c), F.lit("")))).alias(n) for c, n in zip(COLUMNS, NAMES)], path.alias("src"), no.alias("chapter_no"), F.monotonically_increasing_id().alias("row"))
    in_file = Window.partitionBy("src").orderBy("row")
    rows = rows.withColumn("in_file", F.row_number().over(in_file)).withColumn("hadith_number", X.plain_number(F.col("hadith_number")))
    sizes = rows.groupBy("chapter_no", "src").agg(F.max("in_file").alias("n"))  # one row per file
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("chapter_no", "src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("src", "before")
    placed = rows.join(before, "src").withColumn("pos", F.col("before") + F.col("in_file") - 1)
    k = F.row_number().over(Window.partitionBy("hadith_number").orderBy("pos"))
    return placed.withColumn("k", k).select(F.concat_ws("-", F.lit(book), "hadith_number", F.when(F.col("k") > 1, F.col("k").cast("string"))).alias("id"), F.lit(book).alias("book"), "pos", *NAMES, "src")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(folder, k, chapter_no): the k-th file of each folder."""
    raw = spark.read.json(path, multiLine=True, schema="files map<string, array<int>>")
    return raw.select(F.explode("files").alias("folder", "numbers")).select("folder", F.posexplode("numbers").alias("p", "chapter_no")).select("folder", (F.col("p") + 1).alias("k"), "chapter_no")


def attach_sources(runs: DataFrame, manifest: DataFrame, folder_of: DataFrame) -> DataFrame:
    """(book, run, src): the k-th run of chapters of a book is the k-th file; differing counts are an error, not a guess."""
    numbered = runs.join(folder_of, "book")
    have = numbered.groupBy("folder").agg(F.max("run").alias("have"))
    want = manifest.groupBy("folder").agg(F.max("k").alias("want"))
    checked = have.join(want, "folder", "left").select("folder", F.expr("if(have <=> want, true, raise_error(concat(folder, ': ', have, ' chapter groups but ', coalesce(want, 0), ' files')))").alias("ok"))
    return numbered.join(checked.where("ok").select("folder"), "folder").join(manifest, (manifest.folder == numbered.folder) & (manifest.k == numbered.run)).select("book", "run", F.concat(numbered.folder, F.lit("/Chapter"), "chapter_no", F.lit(".csv")).alias("src"))


def write_records(recs: DataFrame, path: str) -> None:
    """The native store: Parquet, a folder per book."""
    recs.write.mode("overwrite").partitionBy("book").parquet(path)


def rewrite(spark: SparkSession, path: str, change) -> str:
    """Reads a store, changes it and writes the result beside it; the path that is read is never overwritten."""
    out = f"{path.rstrip('/')}-next"
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(out)
    return out


def catalogue(spark: SparkSession) -> DataFrame:
    """Field catalogue: where each cleaned field comes from."""
    return spark.createDataFrame([(n, c, n in L.CLEANED_FIELDS) for n, c in zip(NAMES, COLUMNS)], "field string, source_column string, cleaned boolean")


def books(recs: DataFrame) -> DataFrame:
    """The books of a corpus: (book, book_title, compiler, records)."""
    return recs.groupBy("book").agg(F.max("book_title").alias("book_title"), F.max("compiler").alias("compiler"), F.count("*").alias("records"))
