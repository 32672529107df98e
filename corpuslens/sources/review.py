"""Review sheet: reading with delimiter and column checks, row rules as columns, all-or-nothing import."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L

COLUMNS = ("id", "category", "split", "status", "query", "expect", "relevant", "candidates", "reviewer", "date", "basis", "decision", "author")
_LIST = r"[\s,;،؛|]+"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The sheet as strings; the delimiter is ";" if the header has more of them than ",".  A missing column is an error."""
    header = spark.read.text(path).limit(1).first()
    line = (header[0] if header else "").lstrip("﻿")
    sep = ";" if line.count(";") > line.count(",") else ","
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    missing = sorted(set(COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in COLUMNS])


def write(df: DataFrame, path: str) -> int:
    """Small sheet for people, with a byte-order mark; rows come to the driver one partition at a time."""
    n = 0
    with Path(path).open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(COLUMNS)
        for row in df.select(*COLUMNS).toLocalIterator():
            out.writerow([x if x is not None else "" for x in row])
            n += 1
    return n


def ids_of(c) -> F.Column:
    return F.filter(F.split(c, _LIST), lambda x: x != "")


def checked(sheet: DataFrame, cases: DataFrame, recs: DataFrame) -> DataFrame:
    """The sheet with ``errors``: what is wrong with each row; nothing may be applied while any row has one."""
    known = cases.select(F.col("id").alias("cid"), F.col("origin.kind").alias("kind"), F.col("query").alias("old_query"))
    s = sheet.withColumn("row", F.monotonically_increasing_id()).join(known, F.col("id") == F.col("cid"), "left")
    asked = s.select("row", F.explode(F.array_distinct(ids_of(F.col("relevant")))).alias("rid"))
    unknown = asked.join(recs.select(F.col("id").alias("rid")), "rid", "left_anti").groupBy("row").agg(F.count("*").alias("unknown"))
    s = s.join(unknown, "row", "left")
    category = F.when(F.col("category") == "absent", "not_in_six_books").otherwise(F.col("category"))
    exists = category != "not_in_six_books"
    n = F.size(ids_of(F.col("relevant")))
    skip = F.col("decision").isin("", "skip")
    date_ok = F.expr("try_to_date(date, 'yyyy-MM-dd') is not null or try_to_date(date, 'yyyy/MM/dd') is not null")
    rules = [
        (~F.col("decision").isin("accept", "remove", "skip", ""), "decision"),
        ((F.col("id") != "") & F.col("cid").isNull(), "unknown case"),
        ((F.col("decision") == "remove") & (F.coalesce(F.col("kind"), F.lit("")) != "human"), "only cases you added"),
        (~category.isin(*L.CATEGORIES), "unknown category"),
        (F.col("query") == "", "query is empty"),
        (F.col("kind").isNotNull() & (F.col("kind") != "human") & (F.col("query") != F.col("old_query")), "query of a generated case"),
        ((F.col("expect") != "") & (F.col("expect") != F.when(exists, "exists").otherwise("absent")), "does not fit"),
        (F.coalesce(F.col("unknown"), F.lit(0)) > 0, "unknown record"),
        (exists & (n == 0), "at least one record"),
        (~exists & (n > 0), "no record"),
        (F.col("basis") == "", "basis"),
        (~F.col("split").isin("dev", "test"), "split"),
        ((F.col("kind") == "v0_smoke") & (F.col("split") == "test"), "stay in dev"),
        (~F.coalesce(date_ok, F.lit(False)), "YYYY-MM-DD"),
    ]
    errors = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)) & (~skip | F.lit(m == "decision")), F.lit(m)) for c, m in rules]))
    return s.withColumn("errors", errors).select(*COLUMNS, "errors")


def human_id(category, query) -> F.Column:
    """Id of a case a person added: by content, so that importing it again updates it."""
    return F.concat_ws("-", F.lit("human"), category, F.substring(F.sha1(query), 1, 8))


def apply(cases: DataFrame, sheet: DataFrame, recs: DataFrame) -> DataFrame:
    """(id, category, query, split, status, relevant) after the import; a sheet with any error changes nothing and raises."""
    rows = checked(sheet, cases, recs)
    wrong = rows.where(F.size("errors") > 0).agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("errors")))).alias("e")).first()
    if wrong["n"]:
        raise ValueError(f"{wrong['n']} rows: {', '.join(wrong['e'])}")
    new_id = F.when(F.col("id") != "", F.col("id")).otherwise(human_id(F.col("category"), F.col("query")))
    taken = rows.where("decision = 'accept'").select(new_id.alias("id"), "category", "query", "split", F.lit("reviewed").alias("status"), ids_of(F.col("relevant")).alias("relevant")).dropDuplicates(["id"])
    gone = rows.where("decision = 'remove'").select("id")
    kept = cases.select("id", "category", "query", "split", "status", "relevant").join(taken.select("id").union(gone), "id", "left_anti")
    return kept.unionByName(taken)


def export(cases: DataFrame, closest: DataFrame) -> DataFrame:
    """The sheet's rows of cases, with up to three candidate records each, (query, rank, doc) of ``closest``, for a person to look at."""
    near = closest.groupBy(F.col("query").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]), " ").alias("candidates"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = cases.select("id", text("category").alias("category"), F.coalesce("split", F.lit("dev")).alias("split"), text("status").alias("status"), text("query").alias("query"), text("expect").alias("expect"),
                       F.array_join(F.coalesce("relevant", F.array()), " ").alias("relevant"), F.coalesce("origin.author", F.lit("")).alias("author")).join(near, "id", "left")
    return out.select(*[text(c).alias(c) if c in out.columns else F.lit("").alias(c) for c in COLUMNS])
