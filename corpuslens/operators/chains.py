"""Corpus-level operators on parsed chains: spelling of names, look-back completion, word tags, quality counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import lexicon as L
from ..functions import text as X
from . import grammar as G
from .parser import same_or_prefix


def name_words(raw: DataFrame) -> DataFrame:
    """(word, n) over all names."""
    return raw.where("name is not null").select(F.explode(X.words(X.fold(F.col("name")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def accusative(counts: DataFrame) -> DataFrame:
    """(word, n, fixed, fixed_n): words written with a case ending whose bare form is far more frequent."""
    bare = counts.select(F.col("word").alias("fixed"), F.col("n").alias("fixed_n"))
    ending = counts.where(F.col("word").endswith("ا") & (F.length("word") > 3)).withColumn("fixed", F.expr("left(word, length(word) - 1)"))
    return ending.join(bare, "fixed").where("fixed_n >= 20 and fixed_n > 3 * n").select("word", "n", "fixed", "fixed_n")


def _begins(a: Column, b: Column) -> Column:
    """Whether one name is the other or its first words."""
    space = lambda c: F.concat(c, F.lit(" "))
    return F.startswith(space(a), space(b)) | F.startswith(space(b), space(a))


def look_back(recs: DataFrame, rts: DataFrame) -> DataFrame:
    """(id, route_no, donor, donor_route, place): routes whose last name a record up to three places before goes on from.

    The nearest record of the book wins, then its first route.  The name is matched at its first place in the donor's
    route, there or here in a fuller spelling; a route in which that place is the last gives nothing.  The donor is found
    by an equi-join on (book, position), one per distance.  Names count from the compiler's teacher on.
    """
    upside = rts.select("id", "route_no", F.reverse("names").alias("names")).where(F.size("names") > 0)
    at = upside.join(recs.select("id", "book", "pos"), "id")
    wanted = at.select("id", "route_no", "book", F.explode(F.sequence(F.lit(1), F.lit(L.LOOK_BACK))).alias("back"), "pos", F.element_at("names", -1).alias("tail")).withColumn("pos", F.col("pos") - F.col("back"))
    donor = at.select(F.col("id").alias("donor"), F.col("route_no").alias("donor_route"), "book", "pos", F.col("names").alias("theirs"))
    place = F.array_position(F.transform("theirs", lambda n: _begins(n, F.col("tail"))), F.lit(True))
    met = wanted.join(donor, ["book", "pos"]).withColumn("at", place).where((F.col("at") > 0) & (F.col("at") < F.size("theirs")))
    w = Window.partitionBy("id", "route_no").orderBy("back", "donor", "donor_route")
    return met.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "route_no", "donor", "donor_route", F.col("at").cast("int").alias("place"))


def completed(recs: DataFrame, rts: DataFrame, same: DataFrame) -> DataFrame:
    """(id, route_no, names, prior, linked): routes from the compiler's teacher on, those of records in ``same`` (id) completed.

    A record that names the chain of the one before takes, for each of its routes, the rest of the first route that goes
    on from its last name, from the nearest of the three records before it in its book; that record may have been
    completed itself.  Such records follow one another in short runs, so a run and the records it may take from are read
    in order in one place; all other records pass by.
    """
    own = rts.select("id", "route_no", F.reverse("names").alias("names"), "linked").where(F.size("names") > 0)
    place = recs.select("id", "book", "pos").join(same.select("id").distinct().withColumn("same", F.lit(True)), "id", "left").withColumn("same", F.coalesce("same", F.lit(False)))
    in_book = Window.partitionBy("book").orderBy("pos")
    runs = place.where("same").withColumn("new", (F.col("pos") - F.lag("pos").over(in_book) > L.LOOK_BACK).cast("int"))
    runs = runs.withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(in_book)).select("book", "run", "pos")
    near = runs.select("book", "run", F.explode(F.sequence(F.col("pos") - L.LOOK_BACK, "pos")).alias("pos")).distinct()
    routes = own.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("route_no", "names", "linked"))).alias("routes"))
    grouped = near.join(place, ["book", "pos"]).join(routes, "id", "left")
    changed = grouped.groupBy("book", "run").applyInPandas(_fill, "id string, route_no int, names array<string>, prior string, linked boolean")
    kept = own.join(same.select("id").distinct(), "id", "left_anti").select("id", "route_no", "names", F.lit(None).cast("string").alias("prior"), "linked")
    return kept.unionByName(changed)


def _fill(run: pd.DataFrame) -> pd.DataFrame:
    """Routes of a run's records that name the same chain, completed in order of position."""
    have: dict[int, tuple[str, list[dict]]] = {}
    out = []
    for pos, rid, same, routes in run.sort_values("pos")[["pos", "id", "same", "routes"]].itertuples(index=False):
        mine = [{"route_no": r["route_no"], "names": list(r["names"]), "prior": None, "linked": r["linked"]} for r in (routes if routes is not None else [])]
        have[pos] = (rid, mine)
        if not same:
            continue
        for route in mine:
            found = ((have[p][0], r, k) for p in range(pos - 1, pos - 1 - L.LOOK_BACK, -1) if p in have for r in have[p][1]
                     for k in [next((i for i, n in enumerate(r["names"]) if same_or_prefix(n, route["names"][-1])), None)] if k is not None and k + 1 < len(r["names"]))
            hit = next(found, None)
            if hit:
                route["names"] += hit[1]["names"][hit[2] + 1 :]
                route["prior"], route["linked"] = hit[0], hit[1]["linked"]
        out += [(rid, r["route_no"], r["names"], r["prior"], r["linked"]) for r in mine]
    return pd.DataFrame(out, columns=["id", "route_no", "names", "prior", "linked"])


def corrected(raw: DataFrame, fixes: DataFrame) -> DataFrame:
    """(id, route_no, step, was, name): names in which a word is put into the spelling ``accusative`` found for it.

    The fixes join on the word, so no list of them is held anywhere.
    """
    words = raw.where("name is not null and id is not null").select("id", "route_no", "step", F.posexplode(X.words(X.fold(F.col("name")))).alias("at", "word"))
    right = F.coalesce("fixed", "word")
    joined = words.join(fixes.select("word", "fixed"), "word", "left").groupBy("id", "route_no", "step").agg(
        F.sort_array(F.collect_list(F.struct("at", "word", right.alias("right")))).alias("w"), F.max(F.col("fixed").isNotNull()).alias("any"))
    text = lambda c: F.array_join(F.transform("w", lambda x: x[c]), " ")
    return joined.where("any").select("id", "route_no", "step", text("word").alias("was"), text("right").alias("name"))


def _tags(recs: DataFrame, raw: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """(id, p, word, tag) of each chain's words: m for transmission words, n for parts of names, empty for others; markers win.

    Spans are exploded to word positions, so the join is on (id, position) and not on a range.
    """
    ws = recs.select("id", F.posexplode(F.filter(F.split(F.coalesce("isnad", F.lit("")), r"(?U)\s+"), lambda w: w != "")).alias("p", "word"))
    inside = raw.where("span_start is not null and span_end > span_start").select("id", F.explode(F.sequence("span_start", F.col("span_end") - 1)).alias("p")).distinct().withColumn("named", F.lit(True))
    marker = F.regexp_replace(X.fold(F.col("word")), "^[وف](?=..)", "").isin(*markers) | X.fold(F.col("word")).isin(*markers)
    return ws.join(inside, ["id", "p"], "left").select("id", "p", "word", F.when(marker, "m").when(F.col("named"), "n").otherwise("").alias("tag"))


def word_tags(recs: DataFrame, raw: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """(id, markers, names, plain): how many words of each chain are transmission words, names, or neither."""
    one = lambda t: F.sum((F.col("tag") == t).cast("long"))
    return _tags(recs, raw, markers).groupBy("id").agg(one("m").alias("markers"), one("n").alias("names"), one("").alias("plain"))


def tagged(recs: DataFrame, raw: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """(id, words): each chain's words in order with their tags."""
    words = _tags(recs, raw, markers).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("p", "word", "tag"))).alias("w"))
    return words.select("id", F.transform("w", lambda x: F.struct(x["word"].alias("word"), x["tag"].alias("tag"))).alias("words"))


def quality(recs: DataFrame, rts: DataFrame) -> DataFrame:
    """One row of counts over all records and routes."""
    per = rts.where(F.size("names") > 0).groupBy("id").agg(F.count("*").alias("routes"), F.sum(F.size("names")).alias("names"), F.sum(F.size("names") - F.size(F.array_distinct("names"))).alias("twice"))
    r = F.coalesce("routes", F.lit(0))
    out = recs.select("id").join(per, "id", "left").agg(
        F.count("*").alias("records"), F.sum((r == 0).cast("long")).alias("without_route"), F.sum(r).alias("routes"), F.sum((r > 1).cast("long")).alias("with_several"),
        F.coalesce(F.sum("names"), F.lit(0)).alias("names"), F.coalesce(F.sum("twice"), F.lit(0)).alias("same_name_twice"))
    return out


def parser_quality(facts: DataFrame, raw: DataFrame) -> DataFrame:
    """One row of counts and rates over parsed sentences (``parser.facts``) and the names of their routes (``parser.routes``).

    Noise are names that begin with a word of narration, or have a word behind them that is no part of a name; rates
    without a denominator are 0.
    """
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    none, left, strands = F.col("routes") == 0, F.size("fragments") > 0, F.col("switch") | F.col("chain_partial")
    of = facts.agg(
        F.count("*").alias("records"), n(none).alias("without_route"), n(none & ~left).alias("nothing_parsed"), n(none & left).alias("fragments_only"), F.coalesce(F.sum("routes"), F.lit(0)).alias("routes"),
        n(F.col("routes") > 1).alias("with_several"), n(strands).alias("strand_records"), F.coalesce(F.sum(F.when(strands, F.col("routes"))), F.lit(0)).alias("strand_routes"))
    words = F.split("name", " ")
    per = raw.groupBy("id", "route_no").agg((F.count("*") - F.count_distinct("name")).alias("twice")).agg(F.coalesce(F.sum("twice"), F.lit(0)).alias("same_name_twice"))
    names = raw.agg(F.count("*").alias("names"), n(words[0].isin(*sorted(G.NARRATION))).alias("noise_names"), n(F.exists(F.slice(words, 2, F.size(words)), lambda w: w.isin(*G.TRAILS))).alias("trailing_noise"))
    rate = lambda a, b, by: F.round(F.when(F.col(b) > 0, by * F.col(a) / F.col(b)).otherwise(0.0), 2)
    whole = of.crossJoin(names).crossJoin(per)  # one row each
    return whole.select("*", rate("noise_names", "names", 1000).alias("noise_per_1000_names"), rate("strand_routes", "strand_records", 1).alias("routes_per_strand_record"))
