"""Exact operators on pairs and spans against brute force, with the awkward rows."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import crosssplit, leaks, linkage, neardup, spans, vec

DATA = "/root/testdata/sf0.001"


def common(text):
    return "".join(vec._common_of(ord(c)) for c in text or "").split()


def base_words(n, salt=0):
    letters = "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"
    return ["".join(letters[(i * 7 + salt * 3 + k * (i % 5 + 1)) % len(letters)] for k in range(3 + i % 3)) for i in range(n)]


W = base_words(60)
V = base_words(60, 5)
LONG = " ".join(W * 400)

TEXTS = {
    "a": " ".join(W[:40]), "b": " ".join(W[:38] + V[:2]), "c": " ".join(W[:40]), "d": " ".join(V[:40]), "e": None, "f": "", "g": "nan",
    "h": " ".join(W[:14]), "i": " ".join(V[:20] + W[:20]), "j": LONG, "k": LONG + " " + V[3], "l": " ".join(["قال"] * 30), "m": " ".join(["قال"] * 29 + ["كان"]),
    "n": " ".join(W[:13]), "o": " ".join(w[0] + "​" + w[1:] for w in W[:40]),
}


def test_common_form():
    assert common("أحمَد‌ُ كِتابٌ ﻻ") == ["احمد", "كتاب", "لا"]
    assert common("nan None ١٢ 34 ک ی") == ["34", "ك", "ي"]
    words = vec.common_words(pa.array(list(TEXTS.values())))
    assert list(words.count) == [len(common(t)) for t in TEXTS.values()]
    assert [words.text(i) for i in range(words.first[0], words.first[1])] == common(TEXTS["a"])


def test_stored_words_split_like_python():
    texts = ["a b c​d", " x\ty\r\n z ", "", None, "　", "ا، ب"]
    assert list(vec.stored_words(pa.array(texts)).count) == [len((t or "").split()) for t in texts]


def test_near_duplicates(spark):
    rows = [(k, t, 1) for k, t in TEXTS.items()] + [("a", TEXTS["a"], 2), (None, TEXTS["a"], 3)]
    df = spark.createDataFrame(rows, "rec_id string, text string, n int")
    counts = {k: Counter(common(t)) for k, t in TEXTS.items()}
    size = {k: sum(c.values()) for k, c in counts.items()}
    want = {(x, y) for x in TEXTS for y in TEXTS if x < y and min(size[x], size[y]) >= 15 and 4 * sum((counts[x] & counts[y]).values()) >= 3 * max(size[x], size[y])}
    got = [tuple(r) for r in neardup.found(df).collect()]
    assert ("a", "b") in want and ("l", "m") in want and ("a", "o") in want and ("j", "k") in want
    assert set(got) == want and len(got) == len(want)


def test_shared_spans(spark):
    rows = [("t", k, t) for k, t in TEXTS.items() if k not in ("j", "k")] + [("t", "a", TEXTS["a"]), ("t", None, TEXTS["a"])]
    df = spark.createDataFrame(rows, "table_name string, rec_id string, text string").withColumn("pos", F.lit(0))
    recs = {k: (t or "").split() for k, t in TEXTS.items() if k not in ("j", "k")}
    seen = defaultdict(set)
    for k, w in recs.items():
        for i in range(len(w) - 11):
            seen[tuple(w[i : i + 12])].add(k)
    want = set()
    for k, w in recs.items():
        cover = set()
        for i in range(len(w) - 11):
            if len(seen[tuple(w[i : i + 12])]) > 1:
                cover |= set(range(i, i + 12))
        for i in sorted(cover):
            if i - 1 not in cover:
                j = i
                while j + 1 in cover:
                    j += 1
                want.add(("t", k, i, j))
    got = [tuple(r) for r in spans.shared_spans(df).collect()]
    assert want and set(got) == want and len(got) == len(want)
    cov = {r["rec_id"]: r["shared_share"] for r in spans.coverage(df).collect()}
    assert cov["c"] == 1.0 and cov["f"] == 0.0


def test_factors_are_longest_matches(spark):
    a, b, c = W[:40], V[:10] + W[5:30] + V[10:20], W[12:40] + V[:12]
    texts = {"a": a, "b": b, "c": c, "d": V[20:45], "e": W[:14] + V[30:45]}
    df = spark.createDataFrame([("t", k, " ".join(t)) for k, t in texts.items()], "table_name string, rec_id string, text string")
    found = spans.factors(df, 12).collect()
    key = {int(x): k for k, x in zip(texts, spans._key(pa.RecordBatch.from_pydict({"table_name": ["t"] * 5, "rec_id": list(texts)})).view("int64"))}
    assert {r["rec_id"] for r in found} == set(texts)
    for r in found:
        text, source = texts[r["rec_id"]], texts[key[r["source_rec"]]]
        i, j, at = r["first_word"], r["last_word"] + 1, r["source_word"]
        assert source is not text and text[i:j] == source[at : at + j - i] and j - i >= 12
        assert j == len(text) or at + j - i == len(source) or text[j] != source[at + j - i]
    # of two references, the one that matches further is taken
    words, short, far = np.arange(30), np.arange(13), np.concatenate([[99], np.arange(25)])
    assert spans.parse(words, [(0, 1, 0), (0, 2, 1)], {1: short, 2: far}, 12) == [(0, 24, 2, 1)]
    # the parse is taken up again at a factor's boundary, and equal hashes of other words cover nothing
    assert spans.parse(words, [(0, 1, 0), (1, 2, 2), (2, 2, 3), (15, 3, 0)], {1: short, 2: far, 3: np.arange(50, 80)}, 12) == [(0, 12, 1, 0), (2, 24, 2, 3)]


def test_texts_of_one_signature_meet(spark):
    """A word replaced by one of the same signature bit leaves the signature as it is."""
    rows = [f"{a}{b}{c}" for a in "بتثجحخد" for b in "رزسشصض" for c in "كلمنه"]
    batch = pa.RecordBatch.from_pydict({"rec_id": [str(i) for i in range(len(rows))], "text": [" ".join(W[:20] + [w]) for w in rows]})
    row, value, size = neardup._unpack(neardup._tokens(batch)["tokens"])
    sigs = {}
    for i, sig in enumerate(zip(*neardup.signature(row, value, size))):
        sigs.setdefault(tuple(map(int, sig)), []).append(i)
    a, b = next(v for v in sigs.values() if len(v) > 1)[:2]
    df = spark.createDataFrame([("a", " ".join(W[:20] + [rows[a]])), ("b", " ".join(W[:20] + [rows[b]])), ("c", " ".join(V[:20]))], "rec_id string, text string")
    for neighbourhoods in (True, False):
        assert [tuple(r) for r in neardup.found(df, neighbourhoods).collect()] == [("a", "b")]


def test_leaks(spark):
    tests = spark.createDataFrame([("t1", " ".join(W[:20])), ("t2", " ".join(W[:20])), ("t3", " ".join(V[:7])), (None, TEXTS["a"]), ("t4", None)], "case_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(V[30:40] + W[3:11] + V[:3]), "x"), (2, " ".join(W[3:10]), "x"), (3, None, "x"), (4, " ".join(W[0:4] + [V[9]] + W[5:12]), "x"), (5, LONG, "x"), (None, LONG, "x")], "doc_id long, text string, source string")
    got = {tuple(r) for r in leaks.leaked_pairs(tests, docs).collect()}
    assert got == {(d, c) for d in (1, 5) for c in ("t1", "t2")}
    loose = {tuple(r) for r in leaks.leaked_pairs(tests, docs, exact=False).collect()}
    assert (4, "t1") in loose and got <= loose


def test_overlaps_end_at_gaps(spark):
    """Overlaps of one diagonal with a gap are two; replaced words are counted where a mask ignores them."""
    text = W[:40]
    doc = list(text)
    for i in range(12, 24):
        doc[i] = V[i]
    doc[30] = V[30]
    tests = spark.createDataFrame([("t", " ".join(text))], "case_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string")
    got = sorted((r["first_word"], r["last_word"], r["replaced"], r["exact"]) for r in leaks.overlaps(tests, docs).where("shift = 0").collect())
    assert got == [(0, 11, 0, True), (24, 39, 1, True)]
    report = leaks.leak_report(tests, docs).collect()
    assert [(r["words"], r["replaced"], r["share"], r["exact"]) for r in report] == [(16, 1, 0.4, True)]


def test_cross_split(spark):
    rows = [("x1", W[:30], "dev", ["r"]), ("y1", W[:28] + V[:2], "test", ["r"]), ("y2", W[5:12], "test", ["r"]), ("y3", W[5:12], "test", ["q"]), ("y4", V[:30], "test", None), ("y5", W[:7], "test", []), ("x2", W[:6], "dev", [None, "r"]), ("z", W[:30], None, ["r"]), ("y6", None, "test", ["r"])]
    df = spark.createDataFrame([(i, " ".join(w) if w else None, s, r, "k") for i, w, s, r in rows] * 2, "case_id string, text string, split string, relevant array<string>, source string")
    want = set()
    for i, a, s, r in rows:
        for j, b, t, q in rows:
            if s == "dev" and t == "test" and a and b:
                n, lo, hi = crosssplit.lcs(a, b), min(len(a), len(b)), max(len(a), len(b))
                same = bool(set(r or []) & set(q or []) - {None})
                if (lo >= 8 and 10 * n >= 8 * hi) or (same and lo >= 6 and 10 * n >= 9 * lo):
                    want.add((min(i, j), max(i, j)))
    got = [tuple(r) for r in crosssplit.found(df).collect()]
    assert ("x1", "y2") in want and ("x1", "y1") in want and ("x1", "y3") not in want
    assert set(got) == want and len(got) == len(want)
    assert sum(r["n_cases"] for r in crosssplit.report(df).collect()) == len(rows)


def test_cross_split_one_word_longer(spark):
    a, b, c, d, e, f, g, h, x, y, z = W[:11]
    rows = [("s", [a, b, c, d, x, e, f, g, h], "dev"), ("t", [a, b, y, c, d, e, f, z, g, h], "test")]
    rows += [(f"{i}{k}", p, "dev") for i in range(5) for k, p in enumerate(([a, b], [c, d], [e, f], [g, h]))]  # the shared pairs are frequent
    df = spark.createDataFrame([(i, " ".join(w), s, None, "k") for i, w, s in rows], "case_id string, text string, split string, relevant array<string>, source string")
    assert crosssplit.lcs(rows[0][1], rows[1][1]) == 8
    assert [tuple(r) for r in crosssplit.found(df).collect()] == [("s", "t")]


@pytest.mark.parametrize("a,b", [([1, 2, 3, 4], [2, 4, 3]), ([], [1]), ([1, 1, 2, 1], [1, 2, 1, 1]), (list(range(100)), list(range(50, 150)))])
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert crosssplit.lcs(a, b) == table[-1][-1]


def test_empty_tables(spark):
    rec = spark.createDataFrame([], "rec_id string, text string")
    assert neardup.found(rec).count() == 0
    assert spans.shared_spans(spark.createDataFrame([], "table_name string, rec_id string, text string")).count() == 0
    cases = spark.createDataFrame([], "case_id string, text string, split string, relevant array<string>, source string")
    assert crosssplit.found(cases).count() == 0
    assert leaks.leaked_pairs(cases, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_and_groups(spark):
    import random

    from corpuslens.llm import components

    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0

    df = spark.createDataFrame(list(TEXTS.items()), "rec_id string, text string")
    pairs = [tuple(r) for r in neardup.found(df).collect()]
    rows = {r["rec_id"]: (r["group_id"], r["links"]) for r in neardup.groups(df).collect()}
    assert all(rows[a][0] == rows[b][0] for a, b in pairs)
    assert {k: v[1] for k, v in rows.items()} == {k: sum(k in p for p in pairs) for k in rows}
    assert rows["d"] == ("d", 0)
    assert {tuple(r) for r in neardup.found(df, True).collect()} == {tuple(r) for r in neardup.found(df, False).collect()} == set(pairs)


def test_wording_of_a_text_that_fills_a_third(spark):
    hot = " ".join(W[:34])
    rows = [(f"h{i}", hot) for i in range(100)] + [(f"o{i}", " ".join(base_words(34, 6 + i))) for i in range(200)]
    records = spark.createDataFrame(rows, "rec_id string, text string")
    quotes = spark.createDataFrame([("whole", hot), ("half", " ".join(W[8:28])), ("other", " ".join(V[:20]))], "rec_id string, text string")
    sizes = {(r.q_size, r.r_size, r.n) for r in linkage.wording(quotes, records).where("n >= q_size / 2").collect()}
    assert {(34, 34, 34), (20, 34, 20)} <= sizes


def test_wording_that_none_of_the_rarest_words_shares(spark):
    """A run of RUN words is met, though rarer words stand elsewhere in the record, or changed words in the quotation."""
    rare, long, new = base_words(20, 40), base_words(180, 60), base_words(30, 90)
    long = [f"{w}{V[i // 28]}" for i, w in enumerate(long)]
    rows = [("half", " ".join(rare + W[:24])), ("long", " ".join(long))] + [(f"o{i}", " ".join(W[(5 * i + 7 * k) % 60] for k in range(30))) for i in range(60)]
    records = spark.createDataFrame(rows, "rec_id string, text string")
    changed = [f"{new[i // 9]}جديد" if i % 9 == 8 else w for i, w in enumerate(long)]
    quotes = spark.createDataFrame([("frequent", " ".join(W[:24])), ("changed", " ".join(changed))], "rec_id string, text string")
    sizes = {(r.q_size, r.r_size, r.n) for r in linkage.wording(quotes, records).where("n >= q_size / 2").collect()}
    assert {(24, 44, 24), (180, 180, 160)} <= sizes


def test_every_shared_run_is_met():
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in W[:30] for b in "بتثجح"]
    weight = 1 / np.arange(1, len(words) + 1)
    texts = [list(rng.choice(words, rng.integers(4, 90), p=weight / weight.sum())) for _ in range(60)]
    for i in range(0, 60, 2):  # a run of eight words anywhere in two texts, between the rarest words
        at, to = rng.integers(0, len(texts[i]) + 1), rng.integers(0, len(texts[i + 1]) + 1)
        run = list(rng.choice(words[:12], linkage.RUN))
        texts[i][at:at], texts[i + 1][to:to] = run, run
    runs = [{tuple(t[k : k + linkage.RUN]) for k in range(len(t) - linkage.RUN + 1)} for t in texts]
    want = {(i, j) for i in range(60) for j in range(i) if runs[i] & runs[j]}
    row, value, letters = linkage._unpack(linkage._lists(pa.RecordBatch.from_pydict({"text": [" ".join(t) for t in texts]}))["words"])
    counts = np.bincount((value >> np.uint64(64 - linkage.SKETCH_BITS)).astype(np.int64), minlength=1 << linkage.SKETCH_BITS)
    text, key, _ = linkage.window_rows(row, value, letters, counts)
    keys = [set(key[text == i].tolist()) for i in range(60)]
    assert len(want) >= 30 and all(keys[i] & keys[j] for i, j in want)


def test_packed_windows_lose_nothing(spark):
    rng = np.random.default_rng(4)
    n, u = 4000, np.uint64
    key, rest = rng.integers(0, 2**63, n).astype(u) * u(2), rng.integers(0, 2**63, n).astype(u) * u(2)
    bits = rng.integers(0, 64, (2, n)).astype(u)
    other = rest ^ u(1) << bits[0] ^ np.where(rng.random(n) < 0.7, u(1) << bits[1], u(0))  # two bits, one or none
    q_size = rng.integers(1, 400, n)
    r_size = np.array([rng.integers(np.ceil(linkage.FLOOR * x), np.floor(x / linkage.PART) + 1) for x in q_size])
    far = rng.random(n) < 0.3
    q, r = (linkage.packed(np.arange(n), key, *x).view(np.int64).tolist() for x in ((rest, q_size), (np.where(far, vec.mix(rest), other), r_size)))
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(q, r))], "i int, q_window long, r_window long")
    met = {x.i for x in rows.where(linkage._meet()).collect()}
    assert set(np.flatnonzero(~far).tolist()) <= met and len(met & set(np.flatnonzero(far).tolist())) < 0.01 * n
    small = [linkage.packed(np.arange(1), key[:1], rest[:1], np.array([x])).view(np.int64).tolist()[0] for x in (10, 30, 40)]
    sizes = spark.createDataFrame([(small[0], small[1]), (small[2], small[0])], "q_window long, r_window long")
    assert sizes.where(linkage._meet()).count() == 0


def test_texts_are_gathered_once(spark):
    """Windows and the words they are compared by come from one shuffle of each side's texts."""
    df = spark.createDataFrame([("a", TEXTS["a"]), ("b", TEXTS["b"])], "rec_id string, text string")
    pairs = linkage.wording(df, df.withColumn("text", F.concat("text", F.lit(" قال"))))
    assert len(pairs.collect()) == 4
    assert pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") == 2
