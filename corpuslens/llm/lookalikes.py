"""Plans for text in one consistent form (see ``confusables``): which values deviate, and every value normalised."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import confusables
from .base import map_arrow


def _long(fields: list[tuple[DataFrame, str, str, str]]) -> list[tuple[DataFrame, str, str]]:
    return [(df.select(F.col(key).cast("string").alias("rec_id"), F.col(field).alias("text")).where("rec_id is not null and text is not null"), name, field) for df, name, key, field in fields]


def deviating(fields: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(table_name, field_name, rec_id) of values, given as (table, name, id column, text column), not in the consistent form."""

    def fn(batch):
        at = pa.array(confusables.flags(batch["text"]))
        return {"rec_id": batch["rec_id"].filter(at)}

    parts = [map_arrow(df, fn, "rec_id string").select(F.lit(name).alias("table_name"), F.lit(field).alias("field_name"), "rec_id") for df, name, field in _long(fields)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def normalized(fields: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(table_name, field_name, rec_id, text, changed): every value in the consistent form, once per id."""

    def fn(batch):
        flag = confusables.flags(batch["text"])
        texts = [confusables.consistent(t) if f else t for t, f in zip(batch["text"].to_pylist(), flag)]
        return {"rec_id": batch["rec_id"], "text": pa.array(texts, pa.string()), "changed": pa.array(flag)}

    parts = [map_arrow(df, fn, "rec_id string, text string, changed boolean").select(F.lit(name).alias("table_name"), F.lit(field).alias("field_name"), "rec_id", "text", "changed") for df, name, field in _long(fields)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["table_name", "field_name", "rec_id"])
