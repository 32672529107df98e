"""Literals and brute force for the core's functions and operators, with nulls, empties, ties, repeats and clashing columns."""

import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from corpuslens import lexicon as L
from corpuslens.functions import text as X
from corpuslens.operators import chains, evaluation, families, grades, index, records, search, tree
from corpuslens.plans import registry


DATA = "/root/testdata/sf0.001"


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("قَالَ رَسُولُ اللَّهِ صلى الله عليه وسلم", "قال رسول الله"), ("أبي هريرة رضي الله عنه قال", "ابي هريره قال"), (None, ""), ("", ""), ("abc 12", "12"), ("الـكـتـاب", "الكتاب"), ("<img src=x onerror=alert(1)>", "1"),
    ],
)
def test_normalize(spark, text, want):
    assert one(spark, text, X.normalize) == want


def test_tokens_grams_stems(spark):
    assert one(spark, "قال زيد في الكتاب و", lambda c: X.tokens(X.normalize(c))) == ["زيد", "الكتاب"]
    assert one(spark, "", lambda c: X.tokens(X.normalize(c))) == []
    assert one(spark, "من اب", lambda c: X.char_ngrams(X.normalize(c))) == [" من", "من ", " اب", "اب "]
    for w, want in (("والكتاب", "كتاب"), ("بيت", "يت"), ("فب", "فب"), ("للناس", "ناس")):
        assert one(spark, w, X.stem) == want


def test_modes_and_names(spark):
    assert one(spark, "ما من مسلم يغرس غرسا", X.detect_mode) == "verify" and one(spark, "ابحث عن فضل الصبر", X.detect_mode) == "topic"
    assert one(spark, "ابي هريره", X.canonical) == "ابو هريره" and one(spark, "ابي بن كعب", X.canonical) == "ابي بن كعب" and one(spark, "عبد الله ابن عمر", X.canonical) == "عبد الله بن عمر"
    assert one(spark, "رقم 0123/4", X.first_number) == "0123" and one(spark, "12.0", X.plain_number) == "12" and one(spark, " NaN ", X.cleaned) == ""


def plain_align(q, d, w):
    """The specification, written out."""
    q, w = q[: L.MAX_ALIGN_WORDS], w[: L.MAX_ALIGN_WORDS]
    anchors = [i for i, x in enumerate(d) if any(search.word_similarity(y, x) for y in q[:3])] or [i for i, x in enumerate(d) if any(search.word_similarity(y, x) for y in q[:12])]
    best = 0.0
    for a in sorted(anchors)[: L.MAX_ANCHORS]:
        win = d[max(0, a - 1) : a + len(q) + 3]
        table = [[0.0] * (len(win) + 1) for _ in range(len(q) + 1)]
        for i, x in enumerate(q):
            for j, y in enumerate(win):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + w[i] * search.word_similarity(x, y))
        best = max(best, table[-1][-1] / sum(w))
    return best


def test_alignment_follows_its_specification():
    rnd = random.Random(2)
    words = ["كتاب", "الكتاب", "كتب", "قلم", "والقلم", "بيت", "بيوت", "رجل", "رجال", "شمس", "قمر", "نجوم"]
    for _ in range(200):
        q, d = rnd.choices(words, k=rnd.randrange(1, 9)), rnd.choices(words, k=rnd.randrange(1, 30))
        w = [rnd.choice([0.15, 1.0, 3.5]) for _ in q]
        assert search.align(q, d, w) == pytest.approx(plain_align(q, d, w))
    assert search.align([], ["ا"], []) == 0.0 and search.align(["ا"], [], [1.0]) == 0.0


def test_word_similarity():
    assert search.word_similarity("كتاب", "والكتاب") == 0.95 and search.word_similarity("كتاب", "قلم") == 0.0
    a, b = "مدرسة", "مدرسه"
    assert search.word_similarity(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


RECS = [("a", "w", "رجل يغرس شجرا نافعا للناس", 0), ("b", "w", "رجل يغرس شجرا نافعا للطير", 1), ("c", "v", "بمثله", 2), ("d", "v", None, 3), ("e", "v", "", 4), ("f", "v", "كتاب كتاب كتاب قلم", 5)]


@pytest.fixture
def recs(spark):
    return spark.createDataFrame(RECS, "id string, book string, matn string, pos long").withColumn("doc", F.lit(1)).withColumn("nm", X.normalize(X.cleaned(F.col("matn"))))


@pytest.fixture
def cs(spark):
    rows = [("q1", "رجل يغرس شجرا", "exists", "auto", "dev", ["a"], "exact"), ("q2", "قلمم", "exists", "auto", None, ["f"], "spelling"), ("q3", None, "absent", "auto", "test", None, "exact"), ("q4", "غريب", "absent", "auto", "dev", [], "not_in_six_books"), ("q5", "يغرس شجرا نافعا", "exists", "reviewed", "test", ["b", None], "partial")]
    return spark.createDataFrame(rows, "id string, query string, expect string, status string, split string, relevant array<string>, category string").withColumn("qn", X.normalize(F.col("query")))


def test_bm25_by_hand(spark, recs, cs):
    dl = {"a": 5, "b": 5, "c": 1, "d": 0, "e": 0, "f": 4}
    n, avg = 6, 15 / 6
    idf = math.log(1 + (n - 2 + 0.5) / 2.5)
    want = round(3 * idf * 2.4 / (1 + 1.4 * (0.25 + 0.75 * dl["a"] / avg)), 6)
    rows = {(r["query"], r["doc"]): (r["rank"], r["score"]) for r in index.top(cs, recs).collect()}
    assert rows["q1", "a"] == (1, want) and rows["q1", "b"] == (2, want) and not any(q in ("q3", "q4", "q2") for q, _ in rows)


def test_spelling_and_search(spark, recs, cs):
    assert [(r["term"], r["alternative"]) for r in index.expansions(cs, recs).collect() if r["term"] == "قلمم"] == [("قلمم", "قلم")]
    found = search.results(cs, recs)
    states = {r["query"]: r["state"] for r in search.verdicts(cs, found).collect()}
    assert states["q1"] == "found" and states["q3"] == "empty" and states["q4"] == "not_found" and states["q2"] != "found"


def test_containment(spark, recs, cs):
    assert {tuple(r) for r in index.containment(cs, recs).collect()} == {("q1", "a"), ("q1", "b"), ("q5", "a"), ("q5", "b")}


def test_metrics(spark, recs, cs):
    m = {(r["split"], r["category"], r["gid"]): r.asDict() for r in evaluation.metrics(evaluation.first_ranks(cs, index.top(cs, recs))).collect()}
    whole = next(v for k, v in m.items() if k[2] == 3)
    assert whole["cases"] == 5 and whole["ranked_cases"] == 3 and whole["absent_cases"] == 2
    assert whole["recall_at_1"] == round(1 / 3, 3) and whole["recall_at_3"] == round(2 / 3, 3) and whole["mrr"] == 0.5
    rep = evaluation.threshold_report(evaluation.metrics(evaluation.first_ranks(cs, index.top(cs, recs)))).collect()
    assert any(not r["holds"] for r in rep) and all(r["holds"] is not None for r in rep)


def test_references_and_families(spark, recs):
    ref = spark.createDataFrame([("c", "b")], "id string, refers_to string")
    assert records.references(recs).collect() == []  # the record before is in another book
    q = recs.select(F.col("id").alias("doc"))
    near = families.neighbours(recs, q)
    got = {(r["doc"], r["other"]) for r in near.collect()}
    assert ("a", "b") in got and ("b", "a") in got and ("a", "f") not in got
    fam = {(r["doc"], r["member"]): r["similarity"] for r in families.closure(q, near, ref).collect()}
    assert fam["c", "b"] == 1.0 and fam["c", "c"] == 1.0 and fam["a", "c"] == fam["a", "b"] >= 0.45


def test_trees(spark):
    rows = [("x", 1, 1, "ج", True), ("x", 1, 2, "ب", True), ("x", 1, 3, "ا", True), ("x", 2, 1, "د", True), ("x", 2, 2, "ب", True), ("x", 2, 3, "ا", True), ("x", 2, 3, "ا", True), ("x", 3, 1, "ه", False), ("x", 3, 2, None, False), (None, 1, 1, "ا", True)]
    rts = tree.routes(spark.createDataFrame([(*r, "k") for r in rows], "id string, route_no int, step int, name string, to_prophet boolean, names string"))
    nd = tree.nodes(tree.prefixes(rts))
    assert {r["path"]: r["routes"] for r in nd.collect()} == {"ا": 2, "ا > ب": 2, "ا > ب > ج": 1, "ا > ب > د": 1, "ه": 1}
    assert tree.branch_points(nd).first()["label"] == "ب"
    assert tuple(tree.summary(rts).first()) == ("x", 3, 1, 1)
    assert {r["route_no"] for r in tree.shortest(rts).collect()} == {1, 2}
    assert {r["name"]: (r["teachers"], r["students"]) for r in tree.relations(rts).collect()} == {"ا": (0, 1), "ب": (1, 2), "ج": (1, 0), "د": (1, 0)}


def test_expansion_is_cut(spark):
    rows = [("x", s, f"{a}{b}") for s in range(1, 5) for a in "اب" for b in "جده"]
    assert tree.expand(spark.createDataFrame(rows, "id string, step int, name string")).first()["variants"] == L.MAX_ROUTES


def test_look_back(spark):
    recs = spark.createDataFrame([(f"r{i}", "w", i) for i in range(6)], "id string, book string, pos long")
    rts = spark.createDataFrame([("r0", 1, ["ا", "ب", "ج"]), ("r4", 1, ["ب", "د"]), ("r2", 1, ["ا", "ب", "ه"]), ("r5", 1, ["ا", "س"])], "id string, route_no int, names array<string>")
    got = {(r["id"], r["donor"]) for r in chains.look_back(recs, rts).collect()}
    assert got == {("r4", "r2")}
    rts = spark.createDataFrame([("r0", 1, ["ج", "ب", "ا"]), ("r3", 1, ["ب", "د"]), ("r4", 1, ["ب", "د"])], "id string, route_no int, names array<string>")
    assert {(r["id"], r["donor"], r["place"]) for r in chains.look_back(recs, rts).collect()} == {("r3", "r0", 2)}


def test_accusative(spark):
    counts = spark.createDataFrame([("زيد", 40), ("زيدا", 10), ("رضا", 2), ("رض", 90), ("عمرا", 30), ("عمر", 60)], "word string, n long")
    assert {r["word"] for r in chains.accusative(counts).collect()} == {"زيدا"}


def test_grades(spark):
    recs = spark.createDataFrame([("h1", "كلمة اولى ثم ثانية ثم ثالثة ثم رابعة ثم خامسة", "صحيح الكتب", "7", "كلمه اولي ثم ثانيه ثم ثالثه ثم رابعه ثم خامسه")], "id string, matn string, book_title string, hadith_number string, nm string")
    full, short = "كلمة اولى ثم ثانية ثم ثالثة ثم رابعة ثم خامسة", "كلمة اولى ثم ثانية"
    res = spark.createDataFrame([(1, full, "م", "صحيح الكتب", "7", "صحيح"), (2, full, "م", "غيره", "1", "حسن"), (3, full, None, "غيره", "1", "حسن"), (4, full, "م", "صحيح الكتب", "9", "x"), (5, None, "م", "صحيح الكتب", "7", "x"), (6, short, "م", "صحيح الكتب", "7", "x")], "result_id long, text string, muhaddith string, book string, ref string, verdict string")
    got = {r["result_id"]: (r["kind"], r["confidence"]) for r in grades.matches(recs, res).collect()}
    assert got == {1: ("same_source", "high"), 2: ("same_text", "high"), 4: ("same_text", "uncertain"), 6: ("same_source", "high")}
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("",), ("a",)], "skey string")
    store = spark.createDataFrame([("a",)], "skey string")
    assert {tuple(r) for r in grades.lookup(keys, store, spark.createDataFrame([("a",), ("b",)], "skey string")).collect()} == {("a", "built"), ("b", "runtime"), ("c", "missing")}
    assert [r["skey"] for r in grades.to_fetch(keys, store, 1).collect()] == ["b"]


def test_compare():
    got = search.compare("قال زيد في الكتاب", "قال عمرو في كتاب")
    assert got["shared"] == 3 and got["a_words"] == 4 and [o[0] for o in got["ops"]] == ["equal", "replace", "equal"]
    assert search.compare(None, "")["shared"] == 0


def test_empty_tables(spark, recs, cs):
    none_r, none_c = recs.limit(0), cs.limit(0)
    assert index.top(cs, none_r).count() == 0 and index.top(none_c, recs).count() == 0 and index.containment(cs, none_r).count() == 0
    assert search.results(none_c, recs).count() == 0 and families.neighbours(none_r, none_r.select(F.col("id").alias("doc"))).count() == 0
    assert evaluation.metrics(evaluation.first_ranks(none_c, index.top(none_c, recs))).count() >= 0


def test_near_copies_beyond_the_kept(spark, tmp_path, monkeypatch):
    text = "انما الاعمال بالنيات وانما لكل امري ما نوي"
    recs = spark.createDataFrame([(f"r{i}", text, i) for i in range(60)], "id string, nm string, pos long")
    monkeypatch.setattr(registry, "_r", lambda s, d: recs)
    got = [tuple(r) for r in registry.near_copies(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(("r0", f"r{i}") for i in range(1, 60))


def test_look_back_and_completion(spark):
    recs = spark.createDataFrame([(f"b-{i}", "b", i) for i in range(1, 8)] + [("c-8", "c", 8)], "id string, book string, pos long")
    chains_ = {"b-1": [["زيد", "عمرو بن بكر", "خالد", "سعد"]], "b-2": [["علي", "عمرو"]], "b-3": [["حسن", "خالد"], ["نصر"]], "b-4": [["سعد", "زيد"]], "b-5": [["حسن", "سعد"]], "b-7": [["بشر", "علي"]], "c-8": [["بشر", "زيد"]]}
    rows = [(i, k, n[::-1], i == "b-1") for i, rs in chains_.items() for k, n in enumerate(rs, 1)]
    rts = spark.createDataFrame(rows, "id string, route_no int, names array<string>, linked boolean")
    same = spark.createDataFrame([("b-2",), ("b-3",), ("b-7",), ("c-8",)], "id string")
    # the rules read literally, record after record
    order = [f"b-{i}" for i in range(1, 8)] + ["c-8"]
    want, place = {}, {i: (i[0], int(i[2:])) for i in order}
    state = {i: [(list(n), None, i == "b-1") for n in rs] for i, rs in chains_.items()}
    fits = lambda a, b: a == b or a.startswith(b + " ") or b.startswith(a + " ")
    for i in order:
        for r, (names, _, _) in enumerate(state.get(i, [])):
            if i in ("b-2", "b-3", "b-7", "c-8"):
                for back in (1, 2, 3):
                    donor = next((d for d in order if place[d] == (i[0], place[i][1] - back)), None)
                    hits = [(theirs[k + 1 :], d_linked) for theirs, _, d_linked in state.get(donor, []) for k in [next((k for k, n in enumerate(theirs) if fits(n, names[-1])), None)] if k is not None and k + 1 < len(theirs)]
                    if hits:
                        state[i][r] = (names + hits[0][0], donor, hits[0][1])
                        break
            want[i, r + 1] = tuple(map(lambda x: tuple(x) if isinstance(x, list) else x, state[i][r]))
    got = {(x["id"], x["route_no"]): (tuple(x["names"]), x["prior"], x["linked"]) for x in chains.completed(recs, rts, same).collect()}
    assert got == want and got["b-3", 1] == (("حسن", "خالد", "سعد"), "b-2", True) and got["b-2", 1][1] == "b-1"
    met = {(x["id"], x["route_no"]): (x["donor"], x["place"]) for x in chains.look_back(recs, rts).collect()}
    assert met["b-2", 1] == ("b-1", 2) and met["b-3", 1] == ("b-1", 3) and ("c-8", 1) not in met
    assert chains.completed(recs, rts, same.limit(0)).count() == len(rows) and chains.completed(recs.limit(0), rts.limit(0), same).count() == 0


def test_closest_by_order(spark):
    import difflib

    texts = {"a": "واحد اثنان ثلاثة اربعة خمسة", "b": "خمسة اربعة ثلاثة اثنان واحد", "c": "واحد اثنان", "d": "ستة سبعة", "e": "", "f": "واحد اثنان ثلاثة غير اربعة خمسة", "g": "واحد اثنان ثلاثة اربعة خمسة"}
    recs = spark.createDataFrame([(k, t.replace("ة", "ه")) for k, t in texts.items()], "id string, nm string")
    for q in ("واحد اثنان ثلاثه اربعه خمسه", "سته", "غريب", "", "واحد واحد اثنان ثلاثه"):
        words = q.split()
        scored = []
        for k, t in texts.items():
            ws = t.replace("ة", "ه").split()
            common = len(set(words) & set(ws))
            if words and common >= max(1, len(set(words)) // 2):
                n = sum(m.size for m in difflib.SequenceMatcher(None, words, ws, autojunk=False).get_matching_blocks())
                scored.append((-n / len(words), -common, k))
        got = [(r["doc"], r["common"]) for r in index.closest(spark.createDataFrame([("q", q)], "id string, qn string"), recs).orderBy("rank").collect()]
        assert got == [(k, -c) for _, c, k in sorted(scored)[:3]]


def test_grades_with_arabic_digits(spark):
    recs = spark.createDataFrame([("a", "واحد اثنان ثلاثة اربعة خمسة", "جامع الوادي", "17", "واحد اثنان ثلاثه اربعه خمسه")], "id string, matn string, book_title string, hadith_number string, nm string")
    res = spark.createDataFrame([(1, "واحد اثنان ثلاثة اربعة خمسة", "جامع الوادي", "١٧", "صحيح", "فلان")], "result_id long, text string, book string, ref string, verdict string, muhaddith string")
    assert [(r["kind"], r["confidence"]) for r in grades.matches(recs, res).collect()] == [("same_source", "high")]


def test_verdict_metrics(spark):
    ranks = spark.createDataFrame([("1", "exact", "dev", "exists", True, 1), ("2", "exact", "dev", "exists", True, 2), ("3", "exact", "dev", "exists", True, None), ("4", "absent", "dev", "absent", False, None), ("5", "absent", "test", "absent", False, None)], "id string, category string, split string, expect string, ranked boolean, rank int")
    states = spark.createDataFrame([("1", "found"), ("2", "near"), ("3", "not_found"), ("4", "found"), ("5", "empty")], "query string, state string")
    m = {(r["category"], r["split"]): r for r in evaluation.verdict_metrics(ranks, states).where("gid in (0, 3)").collect()}
    whole = m[None, None]
    assert (whole["verdict_precision"], whole["verdict_recall"], whole["top1_precision"], whole["false_exists"], whole["missed"]) == (0.667, 0.667, 0.5, 1, 1)
    assert m["absent", "test"]["verdict_precision"] is None and m["absent", "test"]["false_exists"] == 0
    report = evaluation.threshold_report(evaluation.metrics(ranks), evaluation.verdict_metrics(ranks, states)).where("metric = 'false_exists'").collect()
    assert [(r["value"], r["holds"]) for r in report] == [(1.0, False)]


def test_similar_is_exact(spark):
    """The search by heavy grams gives what the full product gives."""
    recs = spark.read.parquet(f"{DATA}/hadiths.parquet").where("id is not null").dropDuplicates(["id"]).withColumn("nm", X.normalize(X.cleaned(F.col("matn"))))
    w = families.weights(recs).toPandas()
    vectors = {d: dict(zip(g["gram"], g["w"])) for d, g in w.groupby("doc")}
    queries = sorted(vectors)[:12]
    for least in (0.3, 0.9):
        want = {(a, b) for a in queries for b in vectors if a != b and sum(v * vectors[b].get(g, 0.0) for g, v in vectors[a].items()) >= least}
        got = {(r["doc"], r["other"]) for r in families.similar(recs, spark.createDataFrame([(q,) for q in queries], "doc string"), least).collect()}
        assert got == want and (want or least > 0.3)


def test_parser_quality(spark):
    from corpuslens.operators import parser

    df = spark.createDataFrame([("a", "حدثنا زيد بن علي عن عمرو ح وحدثنا بكر بن سعد عن عمرو", ""), ("b", None, None), ("c", "حدثنا زيد بن علي عن عمرو عن زيد بن علي", "")], "id string, isnad string, matn string")
    got = chains.parser_quality(parser.facts(df), parser.routes(df)).first()
    assert (got["records"], got["without_route"], got["nothing_parsed"], got["fragments_only"]) == (3, 1, 1, 0)
    assert got["routes"] == 3 and got["with_several"] == 1 and got["strand_records"] == 1 and got["routes_per_strand_record"] == 2.0 and got["same_name_twice"] == 1 and got["noise_names"] == 0
    empty = chains.parser_quality(parser.facts(df.limit(0)), parser.routes(df.limit(0))).first()
    assert empty["records"] == 0 and empty["noise_per_1000_names"] == 0.0
