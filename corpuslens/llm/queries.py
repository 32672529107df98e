"""Queries of this subpackage by name; ``sql`` has their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosssplit, leaks, linkage, lookalikes, markup, mixing, names, neardup, spans, subjects
from .base import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Hadith bodies and case queries as (table_name, rec_id, text)."""
    h = table(spark, d, "hadiths").select(F.lit("hadiths").alias("table_name"), F.col("id").alias("rec_id"), F.col("matn").alias("text"))
    q = table(spark, d, "cases").select(F.lit("cases").alias("table_name"), F.col("id").alias("rec_id"), F.col("query").alias("text"))
    return h.unionByName(q)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_records(spark, d))


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    return spans.coverage(_records(spark, d))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").select(F.col("id").alias("case_id"), F.col("query").alias("text"), "split", "relevant", F.col("origin.kind").alias("source"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.found(_cases(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.report(_cases(spark, d))


def _tests(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).where("split = 'test'").select("case_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_pairs(_tests(spark, d), table(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(_tests(spark, d), table(spark, d, "documents"))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hadiths").select(F.col("id").alias("rec_id"), F.col("matn").alias("text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.found(_bodies(spark, d))


def _quotes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, d, "dorar_results").select(F.col("result_id").cast("string").alias("rec_id"), "text", "book", "ref")
    r = table(spark, d, "hadiths").select(F.col("id").alias("rec_id"), F.col("matn").alias("text"), F.col("book_title").alias("book"), F.col("hadith_number").alias("ref"))
    return q, r


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.matches(*_quotes(spark, d)).select(F.col("rec_id").cast("long").alias("result_id"), F.col("record_id").alias("hadith_id"))


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    m = linkage.matches(*_quotes(spark, d))
    return m.select(F.col("rec_id").cast("long").alias("result_id"), F.col("record_id").alias("hadith_id"), "text_dice", "book_dice", "ref_same", "score", "confidence")


def _fields(spark: SparkSession, d: str) -> list:
    h, c = table(spark, d, "hadiths"), table(spark, d, "cases")
    return [(h, "hadiths", "id", "matn"), (h, "hadiths", "id", "isnad"), (c, "cases", "id", "query")]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.deviating(_fields(spark, d))


def p6_normalized(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.normalized(_fields(spark, d))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dorar_api_sample").select(F.col("sample_id").alias("key"), F.col("ahadith.result").alias("source"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.fields(_answers(spark, d)).select(F.col("key").alias("sample_id"), "item_no", "field_name", "letters_md5")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.fields(_answers(spark, d)).select(F.col("key").alias("sample_id"), "item_no", "field_name", "value")


def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    return markup.path_scores(_answers(spark, d))


def p9_mix(spark: SparkSession, d: str, tokenizer: str | None = None) -> DataFrame:
    """``tokenizer``: vocabulary file; by default the session's ``corpuslens.tokenizer``, else a public one."""
    file = tokenizer or spark.conf.get("corpuslens.tokenizer", mixing.TOKENIZER)
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer=file)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    names = sorted(r[0] for r in table(spark, d, "subjects").select("subject").where("subject is not null").distinct().collect())
    return subjects.classify(table(spark, d, "documents"), table(spark, d, "subject_labels"), names)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("posterior >= 0.5").select("doc_id", "subject")


def p10_makeup(spark: SparkSession, d: str) -> DataFrame:
    return subjects.make_up(_judged(spark, d))


def _narrators(spark: SparkSession, d: str) -> DataFrame:
    return names.entities(table(spark, d, "routes").where("name is not null and not coalesce(is_relative, false)").select("name"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(_narrators(spark, d))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    return _narrators(spark, d)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(_bodies(spark, d))


QUERIES = {
    "p5_found": p5_found,
    "p5_entities": p5_entities,
    "p10_found": p10_found,
    "p10_makeup": p10_makeup,
    "p7_found": p7_found,
    "p7_clean": p7_clean,
    "p7_paths": p7_paths,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p6_found": p6_found,
    "p6_normalized": p6_normalized,
    "p1_found": p1_found,
    "p1_matches": p1_matches,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p3_found": p3_found,
    "p3_coverage": p3_coverage,
}
