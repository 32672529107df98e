"""Route trees: routes of a record merged from the root down, branch points, relations and views of them.

A route lists names from the compiler's teacher down; the tree is walked from the root, so the last name is its first
level.  In the exact merge a node is a distinct path prefix, which makes nodes, edges and counts plain aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import lexicon as L
from ..functions import text as X


def routes(raw: DataFrame) -> DataFrame:
    """(id, route_no, names from the root, linked): one row per route; NULL names are left out, duplicate rows count once."""
    steps = raw.where("id is not null and name is not null").select("id", "route_no", "step", X.fold(F.col("name")).alias("name"), "to_prophet").distinct()
    steps = steps.groupBy("id", "route_no", "step").agg(F.min("name").alias("name"), F.max("to_prophet").alias("linked"))
    return steps.groupBy("id", "route_no").agg(F.reverse(F.transform(F.sort_array(F.collect_list(F.struct("step", "name"))), lambda s: s["name"])).alias("names"), F.coalesce(F.max("linked"), F.lit(False)).alias("linked"))


def prefixes(rts: DataFrame) -> DataFrame:
    """(id, route_no, depth, path, parent, label, linked): each route's path prefixes."""
    depth = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("names")), lambda k: F.array_join(F.slice("names", 1, k), " > ")))
    long = rts.where(F.size("names") > 0).select("id", "route_no", "linked", "names", depth.alias("p", "path"))
    parent = F.array_join(F.slice("names", 1, F.col("p")), " > ")
    return long.select("id", "route_no", (F.col("p") + 1).alias("depth"), "path", parent.alias("parent"), F.element_at("names", F.col("p") + 1).alias("label"), "linked")


def nodes(pre: DataFrame) -> DataFrame:
    """(id, depth, path, parent, label, routes, linked)."""
    return pre.groupBy("id", "depth", "path", "parent", "label").agg(F.countDistinct("route_no").alias("routes"), F.max("linked").alias("linked"))


def branch_points(nd: DataFrame) -> DataFrame:
    """(id, path, label, routes, branches): the node with most routes x (branches - 1), of two branches or more."""
    children = nd.where("depth > 1").groupBy("id", F.col("parent").alias("path")).agg(F.count("*").alias("branches"))
    found = nd.join(children.where("branches >= 2"), ["id", "path"]).withColumn("weight", F.col("routes") * (F.col("branches") - 1))
    w = Window.partitionBy("id").orderBy(F.desc("weight"), "depth", "path")
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "path", "label", "routes", "branches")


def summary(rts: DataFrame) -> DataFrame:
    """(id, routes, companions, shortest): distinct first names of linked routes count as companions."""
    first = F.when(F.col("linked"), F.element_at("names", 1))
    return rts.where(F.size("names") > 0).groupBy("id").agg(F.count("*").alias("routes"), F.countDistinct(first).alias("companions"), F.min(F.size("names")).alias("shortest"))


def shortest(rts: DataFrame) -> DataFrame:
    """(id, route_no, length): the shortest routes of each record, among linked ones if there are any."""
    n = rts.where(F.size("names") > 0).select("id", "route_no", "linked", F.size("names").alias("length"))
    pool = n.withColumn("any", F.max("linked").over(Window.partitionBy("id"))).where("linked = any")
    return pool.withColumn("least", F.min("length").over(Window.partitionBy("id"))).where("length = least").select("id", "route_no", "length")


def relations(rts: DataFrame) -> DataFrame:
    """(name, teachers, students): distinct neighbours of a name over all routes."""
    pair = rts.select(F.explode(F.zip_with(F.slice("names", 1, F.greatest(F.size("names") - 1, F.lit(0))), F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0))), lambda t, s: F.struct(t.alias("teacher"), s.alias("student")))).alias("x")).select("x.*").distinct()
    t = pair.groupBy(F.col("student").alias("name")).agg(F.count("*").alias("teachers"))
    s = pair.groupBy(F.col("teacher").alias("name")).agg(F.count("*").alias("students"))
    return t.join(s, "name", "full").select("name", F.coalesce("teachers", F.lit(0)).alias("teachers"), F.coalesce("students", F.lit(0)).alias("students"))


def as_text(rts: DataFrame) -> DataFrame:
    return rts.where(F.size("names") > 0).select("id", "route_no", F.array_join(F.reverse("names"), " ← ").alias("route_text"))


def expand(raw: DataFrame, limit: int = L.MAX_ROUTES) -> DataFrame:
    """(id, variants): cartesian product of the distinct names at each step of a record, cut to ``limit`` after every step."""
    names = raw.where("id is not null and name is not null").select("id", "step", X.fold(F.col("name")).alias("name")).distinct()
    level = names.groupBy("id", "step").agg(F.sort_array(F.collect_list("name")).alias("names"))
    levels = level.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "names"))), lambda s: s["names"]).alias("levels"))
    grown = F.aggregate("levels", F.expr("array(cast(array() as array<string>))"), lambda acc, lv: F.slice(F.flatten(F.transform(acc, lambda r: F.transform(lv, lambda n: F.concat(r, F.array(n))))), 1, limit))
    return levels.select("id", grown.alias("routes")).select("id", F.size("routes").alias("variants"), F.element_at("routes", 1).getItem(0).alias("first_name"))


def find(rts: DataFrame, wanted: str) -> DataFrame:
    """(name, routes): names that contain the wanted text, both normalised."""
    w = X.fold(F.lit(wanted))
    return rts.select("id", "route_no", F.explode("names").alias("name")).where(F.contains("name", w)).groupBy("name").agg(F.countDistinct("id", "route_no").alias("routes"))


def through(rts: DataFrame, wanted: str) -> DataFrame:
    """(id, route_no): routes through one name."""
    return rts.where(F.array_contains("names", X.fold(F.lit(wanted)))).select("id", "route_no")


def of_families(family: DataFrame, rts: DataFrame, recs: DataFrame) -> DataFrame:
    """(doc, id, book, route_no, names, linked): routes of all members (doc, member) of a document's family."""
    of = recs.select(F.col("id").alias("member"), "book")
    return family.select("doc", "member").distinct().join(of, "member").join(rts.withColumnRenamed("id", "member"), "member").select("doc", F.col("member").alias("id"), "book", "route_no", "names", "linked")


def whole(family_routes: DataFrame) -> DataFrame:
    """Routes that enter a tree: those that reach the root, or have two names or more."""
    return family_routes.where((F.size("names") > 1) | ((F.size("names") == 1) & F.col("linked")))


def incomplete(family_routes: DataFrame) -> DataFrame:
    """(doc, id, route_no, names): routes of one name that don't reach the root; they enter no tree."""
    return family_routes.where((F.size("names") == 1) & ~F.col("linked")).select("doc", "id", "route_no", F.array_join("names", " > ").alias("names"))


def family_nodes(family_routes: DataFrame) -> DataFrame:
    """(doc, depth, path, parent, label, kind, routes, records, books, linked): one tree per family, its books as leaves.

    The first name after the root is a companion; a route ends in the book of its record.  Each node counts the distinct
    routes, records and books that pass through it.
    """
    ends = whole(family_routes).withColumn("steps", F.concat("names", F.array(F.concat(F.lit("book:"), "book"))))
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("steps")), lambda k: F.array_join(F.slice("steps", 1, k), " > "))).alias("p", "path")
    long = ends.select("doc", "id", "route_no", "book", "linked", "steps", at)
    kind = F.when(F.col("p") == F.size("steps") - 1, "book").when(F.col("p") == 0, "companion").otherwise("narrator")
    long = long.select("doc", "id", "route_no", "book", "linked", (F.col("p") + 1).alias("depth"), "path", F.array_join(F.slice("steps", 1, F.col("p")), " > ").alias("parent"), F.element_at("steps", F.col("p") + 1).alias("label"), kind.alias("kind"))
    return long.groupBy("doc", "depth", "path", "parent", "label", "kind").agg(
        F.countDistinct("id", "route_no").alias("routes"), F.countDistinct("id").alias("records"), F.countDistinct("book").alias("books"), F.max("linked").alias("linked"))


def family_branch_points(nd: DataFrame) -> DataFrame:
    """(doc, path, label, routes, branches): of each family of several routes the node with most routes x (branches - 1); books aren't nodes to branch at."""
    children = nd.where("depth > 1").groupBy("doc", F.col("parent").alias("path")).agg(F.count("*").alias("branches"))
    found = nd.where("kind <> 'book'").join(children.where("branches >= 2"), ["doc", "path"]).withColumn("weight", F.col("routes") * (F.col("branches") - 1))
    w = Window.partitionBy("doc").orderBy(F.desc("weight"), "depth", "path")
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc", "path", "label", "routes", "branches")


def family_summary(family_routes: DataFrame) -> DataFrame:
    """(doc, routes, narrations, companions, books, incomplete, top_companion): companions are first names of linked routes of two names or more."""
    ok = (F.size("names") > 1) | ((F.size("names") == 1) & F.col("linked"))
    key = F.struct("id", "route_no")
    companion = F.when(F.col("linked") & (F.size("names") > 1), F.element_at("names", 1))
    per = family_routes.where(ok).groupBy("doc", companion.alias("companion")).agg(F.countDistinct("id", "route_no").alias("n")).where("companion is not null")
    top = per.groupBy("doc").agg(F.min_by("companion", F.struct(-F.col("n"), "companion")).alias("top_companion"))
    base = family_routes.groupBy("doc").agg(
        F.count_distinct(F.when(ok, key)).alias("routes"), F.count_distinct(F.when(ok, F.col("id"))).alias("narrations"), F.count_distinct(F.when(ok, companion)).alias("companions"),
        F.count_distinct(F.when(ok, F.col("book"))).alias("books"), F.count_distinct(F.when(~ok & (F.size("names") > 0), key)).alias("incomplete"))
    return base.join(top, "doc", "left")


def compared(rts: DataFrame) -> DataFrame:
    """(id, route_a, route_b, shared, only_a, only_b): two routes of a record, name by name; a record has at most ``MAX_ROUTES``."""
    side = lambda s: rts.where(F.size("names") > 0).select("id", F.col("route_no").alias(f"route_{s}"), F.array_distinct("names").alias(s))
    both = side("a").join(side("b"), "id").where("route_a < route_b")
    return both.select("id", "route_a", "route_b", F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_except("a", "b")).alias("only_a"), F.size(F.array_except("b", "a")).alias("only_b"))
