"""Connectors, review sheet and stream."""

import json

import pytest

from corpuslens.operators import records
from corpuslens.sources import answers, corpus, review
from corpuslens.streaming import verify

HEAD = ",".join(corpus.COLUMNS)


def test_chapters(spark, tmp_path):
    (tmp_path / "Chapter2.csv").write_text("﻿" + HEAD + '\n3.0,ب,س,عن زيد,"نص\nسطر",nan,\n', encoding="utf-8")
    (tmp_path / "Chapter1.csv").write_text("﻿" + HEAD + "\n1,ا,س,عن عمرو,اول,None,x\n1,ا,س,,ثان,,\n", encoding="utf-8")
    rows = corpus.read_chapters(spark, str(tmp_path), "wadi").orderBy("pos").collect()
    assert [r["id"] for r in rows] == ["wadi-1", "wadi-1-2", "wadi-3"] and [r["pos"] for r in rows] == [0, 1, 2]
    assert rows[2]["matn"] == "نص\nسطر" and rows[2]["remark"] == "" and rows[0]["remark"] == ""


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"files": {"W": [1, 4]}}))
    m = corpus.read_manifest(spark, str(tmp_path / "m.json"))
    runs = spark.createDataFrame([("w", 1), ("w", 2)], "book string, run long")
    folder = spark.createDataFrame([("w", "W")], "book string, folder string")
    assert [r["src"] for r in corpus.attach_sources(runs, m, folder).orderBy("run").collect()] == ["W/Chapter1.csv", "W/Chapter4.csv"]
    with pytest.raises(Exception, match="chapter groups"):
        corpus.attach_sources(runs.limit(1), m, folder).collect()


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "w", 1), ("b", None, 2)], "id string, book string, pos int")
    corpus.write_records(df, str(tmp_path / "s"))
    out = corpus.rewrite(spark, str(tmp_path / "s"), lambda d: d.where("pos = 1"))
    assert [r["id"] for r in spark.read.parquet(out).collect()] == ["a"]


def test_grade_service(spark, tmp_path):
    block = '<div class="hadith">1 - نص &amp; غيره</div>\n<div class="hadith-info"><span class="info-subtitle">الراوي:</span> زيد <span class="info-subtitle">المحدث :</span> عمرو<span class="info-subtitle">آخر:</span> x</div>'
    (tmp_path / "k.json").write_text(json.dumps({"ahadith": {"result": block * 2}}, ensure_ascii=False), encoding="utf-8")
    answers.register(spark)
    df = spark.read.format("grade_service").option("fixture", str(tmp_path)).option("keys", json.dumps(["k", "none"])).load().withColumnRenamed("skey", "key")
    rows = answers.fields(df).orderBy("item_no").collect()
    assert [(r["item_no"], r["text"], r["rawi"], r["muhaddith"], r["verdict"]) for r in rows] == [(i, "نص & غيره", "زيد", "عمرو", None) for i in (1, 2)]
    assert answers.fields(spark.createDataFrame([("a", ""), ("b", None), ("c", "<p>x</p>")], "key string, result string")).count() == 0


def _cases(spark):
    return spark.createDataFrame([("g1", "exact", "نص", "dev", "auto", ["r1"], ("corpus_sample",)), ("h1", "meaning", "سؤال", "dev", "auto", ["r1"], ("human",)), ("v1", "partial", "قديم", "dev", "auto", ["r1"], ("v0_smoke",))],
                                 "id string, category string, query string, split string, status string, relevant array<string>, origin struct<kind:string>")


def _sheet(spark, *rows):
    base = {c: "" for c in review.COLUMNS} | {"category": "exact", "split": "dev", "query": "نص", "relevant": "r1", "date": "2026-01-02", "basis": "b", "decision": "accept", "id": "g1"}
    return spark.createDataFrame([tuple((base | r)[c] for c in review.COLUMNS) for r in rows], ", ".join(f"{c} string" for c in review.COLUMNS))


def test_review_rules(spark):
    recs = spark.createDataFrame([("r1",)], "id string")
    bad = [({"basis": ""}, "basis"), ({"relevant": ""}, "at least one record"), ({"id": "zz"}, "unknown case"), ({"category": "odd"}, "unknown category"), ({"expect": "absent"}, "does not fit"), ({"id": "v1", "query": "قديم", "split": "test"}, "stay in dev"),
           ({"decision": "remove"}, "only cases you added"), ({"relevant": "r1; r9"}, "unknown record"), ({"date": "2 Jan"}, "YYYY-MM-DD"), ({"decision": "maybe"}, "decision"), ({"query": "آخر"}, "query of a generated case"), ({"category": "absent"}, "no record")]
    rows = review.checked(_sheet(spark, *[b for b, _ in bad]), _cases(spark), recs).collect()
    found = [set(r["errors"]) for r in rows]
    assert all(any(m in e for e in found) for _, m in bad)
    with pytest.raises(ValueError, match="basis"):
        review.apply(_cases(spark), _sheet(spark, {"basis": ""}, {}), recs)


def test_review_import_is_idempotent(spark, tmp_path):
    recs = spark.createDataFrame([("r1",)], "id string")
    sheet = _sheet(spark, {"id": "", "category": "meaning", "query": "جديد"}, {"id": "h1", "query": "سؤال", "category": "meaning", "decision": "remove"}, {"decision": "skip", "basis": ""})
    once = review.apply(_cases(spark), sheet, recs)
    assert {r["id"] for r in once.collect()} >= {"g1", "v1"} and once.count() == 3 and "h1" not in {r["id"] for r in once.collect()}
    review.write(sheet, str(tmp_path / "s.csv"))
    back = review.read(spark, str(tmp_path / "s.csv"))
    assert back.count() == 3 and (tmp_path / "s.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    (tmp_path / "t.csv").write_text("id;query\n1;2\n")
    with pytest.raises(ValueError, match="missing columns"):
        review.read(spark, str(tmp_path / "t.csv"))


def test_stream(spark, tmp_path):
    recs = records.records(spark, "/root/testdata/sf0.001")
    q = spark.createDataFrame([("1", " ".join(recs.where("length(nm) > 60").first()["nm"].split()[2:8])), ("2", None), ("3", "غير موجود هنا")], "id string, query string")
    q.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, query string").json(str(tmp_path / "in"))
    run = verify.contained(stream, recs).writeStream.format("memory").queryName("verified").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    got = {tuple(r) for r in spark.sql("select * from verified").collect()}
    assert got == {tuple(r) for r in verify.contained(q, recs).collect()} and {g[0] for g in got} == {"1"}
