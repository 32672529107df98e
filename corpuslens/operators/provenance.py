"""Where a value comes from: a struct beside each value that is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "—"
# How a route was put together, by join code.
METHODS = {
    "direct": "rules on transmission words", "co_narrator": "co-narrators joined by and", "convergence": "strands joined where the text says they meet",
    "shared_name": "strands joined at a shared name", "complete_segment": "a strand that names the root itself", "shared_name_taliq": "continued by an aside at a shared name",
    "prior_isnad": "completed from a record before it in the book",
}


def make(source: Column, url: Column, quote: Column, retrieved: Column, method: Column, confidence: Column | None = None) -> Column:
    """An empty quote shows as missing; confidence is NULL where none is given."""
    shown = F.when(F.coalesce(quote, F.lit("")) == "", MISSING).otherwise(quote)
    return F.struct(source.alias("source"), url.alias("url"), shown.alias("quote"), retrieved.alias("retrieved"), method.alias("method"), (F.lit(None).cast("string") if confidence is None else confidence).alias("confidence"))


def method_text(join: Column) -> Column:
    """Text of a join code, part by part; unknown parts stay, NULL reads as direct."""
    names = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])
    parts = F.filter(F.split(F.coalesce(join, F.lit("direct")), r"\+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(names, p), p)), "; ")
