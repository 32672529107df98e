"""Differences, folded trees, generated cases, provenance and the request façade."""

import json

import pytest
from pyspark.sql import functions as F

from corpuslens import api
from corpuslens.operators import diff, folding, generate, index, provenance, search
from corpuslens.sources import casefile, review


def test_focused_difference():
    source = " ".join(f"كلمة{c}" for c in "ابتثجحخدذرزسشصضطظع")
    words = source.split()
    got = diff.focused(" ".join([*words[9:11], "غيرها", *words[12:14]]), source, context=2)
    assert got[0] == ("gap", "", "…") and got[-1] == ("gap", "", "…")
    assert [k for k, _, _ in got] == ["gap", "ctx", "same", "replace", "same", "ctx", "gap"]
    assert next(o for o in got if o[0] == "replace") == ("replace", "غيرها", words[11])
    assert diff.focused(None, None) == [] and diff.focused("قال", "قلم")[0][0] == "replace"


def test_folded_tree(spark):
    nodes = folding.fold([(1, ["عمر بن الخطاب", "علقمة"], True), (2, ["عمر", "علقمة", "زيد"], True), (3, ["سعد"], False), (4, ["عمر بن الخطاب", "نافع"], False), (5, [], True)])
    first = nodes[0]
    assert (first["label"], first["merge"], first["variants"], first["routes"], first["linked"]) == ("عمر بن الخطاب", "prefix", ["عمر"], 3, True)
    assert [(n["label"], n["parent"]) for n in nodes[1:]] == [("علقمة", 1), ("زيد", 2), ("نافع", 1)]
    df = spark.createDataFrame([("x", 1, ["ا", "ب"], True, "z")], "id string, route_no int, names array<string>, linked boolean, label string")
    assert folding.folded(df).count() == 2 and folding.folded(df.limit(0)).count() == 0


@pytest.mark.parametrize("word,n,want", [("ذهب", 0, ("زهب", "other_letter")), ("كتاب", 1, ("كاتب", "swap_letters")), ("مكتبهم", 1, ("مكتهم", "drop_letter")), ("من", 1, (None, None)), ("عمل", 2, (None, None))])
def test_typo(spark, word, n, want):
    e = spark.range(1).select(generate.typo(generate.errors(F.lit(word)), F.lit(n)).alias("e")).first()["e"]
    assert ((e["became"], e["rule"]) if e else (None, None)) == want


def test_generated_cases(spark):
    nm = " ".join(f"كلمه{i}" for i in range(24))
    df = spark.createDataFrame([("a", nm), ("b", "قصير"), ("c", "")], "id string, nm string")
    assert [tuple(r) for r in generate.partial(df).collect()] == [("a", " ".join(nm.split()[8:16]))]
    made = generate.spelling(df).collect()
    assert len(made) == 1 and made[0]["clean_query"] == " ".join(nm.split()[6:16]) and len(made[0]["typos"]) == 2


def test_provenance(spark):
    df = spark.createDataFrame([("direct",), ("convergence+co_narrator",), (None,), ("odd",)], "j string")
    got = [r[0] for r in df.select(provenance.method_text(F.col("j"))).collect()]
    assert got[0] == got[2] == provenance.METHODS["direct"] and got[1].count(";") == 1 and got[3] == "odd"
    p = df.limit(1).select(provenance.make(*[F.lit(x) for x in ("s", "u", "", "d", "m")]).alias("p")).first()["p"]
    assert p["quote"] == provenance.MISSING and p["confidence"] is None


def test_requests(spark):
    service = api.Service(spark, "/root/testdata/sf0.001")
    for bad in ("", None, "../etc/passwd", "wadi-1<script>", "x" * 500, "wadi-", "WADI-1"):
        with pytest.raises(ValueError, match="not a record id"):
            service.record(bad)
    assert service.record("wadi-1").count() <= 1
    found, verdict = service.search("<img src=x onerror=alert(1)>", "odd")
    assert found.count() == 0 and verdict.first()["state"] == "empty"
    text = " ".join(service.recs.where("length(nm) > 80").orderBy("id").first()["nm"].split()[:12])
    found, verdict = service.search(text)
    assert verdict.first()["state"] == "found" and found.count() > 0


def test_request_actions(spark):
    service = api.Service(spark, "/root/testdata/sf0.001")
    ids = [r["id"] for r in service.recs.where("length(nm) > 80").orderBy("id").limit(2).collect()]
    assert service.compare(*ids).count() == 1 and service.compare(ids[0], ids[0]).first()["shared_words"] == service.compare(ids[0], ids[0]).first()["a_words"]
    assert service.diff("نص آخر", ids[0]).count() == 1
    assert service.health().first()["records"] == service.recs.count() == sum(r["records"] for r in service.sources().collect())
    assert service.grades(ids[0]).columns[0] == "id"
    with pytest.raises(ValueError, match="not a book"):
        service.search("نص", book="none")
    with pytest.raises(ValueError, match="not a record id"):
        service.diff("نص", "../x")


def test_evidence(spark):
    recs = spark.createDataFrame([("a", "قال، وَإنما  الأعمالُ بالنيات", "قال وانما الاعمال بالنيات"), ("b", "كلمة", "كلمه"), ("c", None, "")], "id string, matn string, nm string")
    cs = spark.createDataFrame([("q", "انما الاعمال"), ("r", "كلمه"), ("s", "")], "id string, qn string")
    found = spark.createDataFrame([("q", "a"), ("r", "b"), ("q", "c"), ("s", "a")], "query string, doc string")
    got = {(r["query"], r["doc"]): (r["first_word"], r["last_word"], r["quote"]) for r in index.evidence(found, cs, recs).collect()}
    assert got == {("q", "a"): (1, 2, "وَإنما الأعمالُ"), ("r", "b"): (0, 0, "كلمة"), ("q", "c"): (None, None, None)}


def test_gram_measures(spark):
    pairs = spark.createDataFrame([("1", "x", "كتاب", "كتاب كتاب"), ("2", "x", "", "كتاب"), ("3", "x", "علم", "كتاب")], "query string, doc string, qn string, nm string")
    got = {r["query"]: (r["containment"], r["cosine"]) for r in index.gram_measures(pairs).collect()}
    assert got == {"1": (1.0, 1.0), "2": (0.0, 0.0), "3": (0.0, 0.0)}


def test_shown_results(spark):
    rows = [("q", i, f"d{i}", m) for i, m in enumerate([0.3, 0.9, 0.4, 0.8, 0.7, 0.6, 0.5, 0.5, 0.5], 1)]
    got = [r["doc"] for r in search.shown(spark.createDataFrame(rows, "query string, rank int, doc string, match double")).orderBy("place").collect()]
    assert got == ["d1", "d2", "d4", "d5", "d6", "d7"]


def test_case_files_and_export(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"cases": [{"id": "a", "query": "نص", "relevant": ["r1", "r2"], "origin": {"kind": "human", "author": "x"}}, {"id": "b"}]}, ensure_ascii=False), encoding="utf-8")
    cases = casefile.read(spark, str(tmp_path / "c.json"))
    casefile.write(cases, str(tmp_path / "out"))
    again = casefile.read_lines(spark, str(tmp_path / "out"))
    assert sorted(again.collect(), key=str) == sorted(cases.collect(), key=str) and again.count() == 2
    near = spark.createDataFrame([("a", 2, "r9"), ("a", 1, "r3")], "query string, rank int, doc string")
    rows = {r["id"]: r for r in review.export(cases, near).collect()}
    assert rows["a"]["candidates"] == "r3 r9" and rows["a"]["relevant"] == "r1 r2" and rows["a"]["author"] == "x" and rows["b"]["split"] == "dev" and rows["b"]["candidates"] == ""
