"""Queries do their whole job: nothing behind a length or a number of candidates is left out."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuslens import lexicon as L
from corpuslens.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
FILLER = "حشو " * (L.MAX_QUERY_CHARS // 4)
LATE = "ورقه خضراء يانعه"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def long_query(spark, tmp_path_factory):
    """Two cases whose words that a record has stand behind the longest query of a search box, and six records."""
    d = str(tmp_path_factory.mktemp("long"))
    r = spark.read.parquet(f"{DATA}/hadiths.parquet").where("id is not null").limit(6).collect()
    n = spark.createDataFrame([(x["id"], i) for i, x in enumerate(r)], "id string, i int")
    recs = spark.read.parquet(f"{DATA}/hadiths.parquet").join(n, "id").dropDuplicates(["id"])
    recs = recs.withColumn("matn", F.when(F.col("i") == 0, LATE).when(F.col("i") == 1, "حشو").otherwise(F.concat(F.lit("شيء غيره "), F.col("i").cast("string"))))
    recs.drop("i").coalesce(1).write.parquet(f"{d}/hadiths.parquet")
    c = spark.read.parquet(f"{DATA}/cases.parquet").where("id is not null").dropDuplicates(["id"]).limit(2)
    # the first record is the relevant one of both
    c = c.withColumn("query", F.lit(FILLER + LATE)).withColumn("relevant", F.array(F.lit(r[0]["id"]))).withColumn("expect", F.lit("exists")).withColumn("status", F.lit("auto"))
    c.coalesce(1).write.parquet(f"{d}/cases.parquet")
    con = duckdb.connect()
    for t in ("hadiths", "cases"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    return d, con, r[0]["id"]


def same_as_sql(spark, long_query, name):
    d, con, _ = long_query
    df = QUERIES[name](spark, d)
    cur = con.execute(SQL[name])
    at = [[c[0] for c in cur.description].index(c) for c in df.columns]
    assert rows(df) == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)


def test_bm25_of_the_whole_query(spark, long_query):
    d, _, late = long_query
    assert {(r["doc"], r["rank"]) for r in QUERIES["bm25_topk"](spark, d).collect()} > {(late, 1)}
    same_as_sql(spark, long_query, "bm25_topk")


def test_closest_to_the_whole_query(spark, tmp_path):
    """The first record has the words behind the cut too and is closer for it."""
    d = str(tmp_path)
    words = [f"{a}{b}{c}" for a in "ابتثجحخد" for b in "رزسشصضطظ" for c in "عغفقكلمن"][:400]
    cut = " ".join(words)[: L.MAX_QUERY_CHARS].split()[:-1]
    r = [x["id"] for x in spark.read.parquet(f"{DATA}/hadiths.parquet").where("id is not null").select("id").distinct().orderBy("id").limit(2).collect()]
    texts = spark.createDataFrame([(r[1], " ".join(words)), (r[0], " ".join(cut))], "id string, text string")
    spark.read.parquet(f"{DATA}/hadiths.parquet").dropDuplicates(["id"]).join(texts, "id").withColumn("matn", F.col("text")).drop("text").write.parquet(f"{d}/hadiths.parquet")
    spark.read.parquet(f"{DATA}/cases.parquet").where("id is not null").dropDuplicates(["id"]).limit(1).withColumn("query", F.lit(" ".join(words))).write.parquet(f"{d}/cases.parquet")
    got = [(x["doc"], x["share"], x["common"]) for x in QUERIES["closest_candidates"](spark, d).orderBy("rank").collect()]
    assert got == [(r[1], 1.0, len(words)), (r[0], round(len(cut) / len(words), 2), len(cut))]
    assert QUERIES["review_export"](spark, d).first()["candidates"].startswith(r[1])


@pytest.mark.parametrize("name", ["gram_measures", "ir_metrics"])
def test_measures_of_the_whole_query(spark, long_query, name):
    d, con, late = long_query
    got = QUERIES[name](spark, d).collect()
    if name == "gram_measures":
        assert {r["doc"] for r in got} == {late} and all(0 < r["containment"] < 0.2 for r in got)
    else:
        assert all(r["mrr"] == 1.0 for r in got)
    same_as_sql(spark, long_query, name)


QUERY = "واحد اثنان ثلاثه اربعه خمسه سته"


def test_alignment_of_all_words_beside_all_anchors():
    from corpuslens.operators import search

    words, other = QUERY.split(), [f"غير{c}" for c in "ابتثجحخدذرزسشصضطظعغفقكلمن"]
    assert search.align(words, [words[0]] * 20 + other + words, [1.0] * 6) == 1.0
    many = [a + b for a in "ابتثجحخدذرزس" for b in "شصضطظعغفقكل"][:130]
    assert search.align(many, many[:3] + many[120:], [1.0] * 130) >= 13 / 130


@pytest.fixture(scope="module")
def far_down(spark, tmp_path_factory):
    """Fifty records with a query's words the wrong way round, and one, long, that has them in order: BM25 has it last."""
    d = str(tmp_path_factory.mktemp("far"))
    recs = spark.read.parquet(f"{DATA}/hadiths.parquet").where("id is not null").dropDuplicates(["id"]).orderBy("id").limit(60).cache()
    n = spark.createDataFrame([(x["id"], i) for i, x in enumerate(recs.select("id").orderBy("id").collect())], "id string, i int")
    right = n.orderBy("i").first()["id"]
    long = "كلام طويل " * 60 + QUERY
    text = F.when(F.col("i") == 0, long).when(F.col("i") <= 50, " ".join(reversed(QUERY.split()))).otherwise("شيء غيره")
    recs.join(n, "id").withColumn("matn", text).drop("i").coalesce(1).write.parquet(f"{d}/hadiths.parquet")
    c = spark.read.parquet(f"{DATA}/cases.parquet").where("id is not null").dropDuplicates(["id"]).limit(1)
    c = c.withColumn("query", F.lit(QUERY)).withColumn("relevant", F.array(F.lit(right))).withColumn("expect", F.lit("exists")).withColumn("status", F.lit("auto")).withColumn("split", F.lit("dev"))
    c.coalesce(1).write.parquet(f"{d}/cases.parquet")
    return d, right


@pytest.mark.parametrize("name", ["search_verify", "results_shown", "search_metrics", "verdict_metrics", "search_threshold_report"])
def test_every_record_that_is_met_is_aligned(spark, far_down, name):
    d, right = far_down
    got = QUERIES[name](spark, d).collect()
    if name == "search_verify":
        assert [r["doc"] for r in got if r["rank"] == 1] == [right] and [r["match"] for r in got if r["rank"] == 1] == [1.0]
    elif name == "results_shown":
        assert [(r["place"], r["doc"]) for r in got] == [(1, right)]
    elif name == "search_metrics":
        assert all(r["recall_at_1"] == 1.0 and r["mrr"] == 1.0 for r in got)
    elif name == "verdict_metrics":
        assert all((r["verdict_recall"], r["top1_precision"], r["missed"]) == (1.0, 1.0, 0) for r in got)
    else:
        assert {r["value"] for r in got if r["scope"] == "overall"} == {1.0}
