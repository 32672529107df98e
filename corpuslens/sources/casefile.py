"""Case files: one JSON object with a list of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASE = (
    "id string, category string, query string, expect string, status string, split string, relevant array<string>, "
    "evidence array<struct<id: string, book_title: string, number: string, source: string, url: string, quote: string, retrieved: string, method: string>>, "
    "origin struct<kind: string, record: string, rule: string, label_source: string, author: string, added: string>, clean_query string"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per case; fields that are missing are NULL."""
    return spark.read.json(path, multiLine=True, schema=T.StructType([T.StructField("cases", T.ArrayType(T.StructType.fromDDL(CASE)))])).select(F.explode("cases").alias("c")).select("c.*")


def write(cases: DataFrame, path: str) -> None:
    """A line of JSON per case, in parts: the form to keep and to read side by side."""
    cases.write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=CASE)
