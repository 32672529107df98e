"""Answers of the outer grade service: a Python data source (fixture-backed, one partition) and their fields."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Labels of the service's answers and the classes of its blocks.
FIELDS = {"الراوي": "rawi", "المحدث": "muhaddith", "المصدر": "book", "الصفحة أو الرقم": "ref", "خلاصة حكم المحدث": "verdict"}
TEXT, ABOUT, LABEL = "hadith", "hadith-info", "info-subtitle"


class GradeService(DataSource):
    """Options: ``fixture`` (folder with <skey>.json), ``keys`` (JSON list).  The network is never used by default."""

    @classmethod
    def name(cls):
        return "grade_service"

    def schema(self):
        return "skey string, result string"

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.keys = options["fixture"], json.loads(options.get("keys", "[]"))

    def partitions(self):
        return [InputPartition(0)]  # the service wants its calls one after another

    def read(self, partition):
        for key in self.keys:
            file = Path(self.folder) / f"{key}.json"
            yield (key, json.loads(file.read_text(encoding="utf-8"))["ahadith"]["result"] if file.exists() else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GradeService)


class _Events(HTMLParser):
    """Collects what is shown into the place that is open: a text, a label or a value; ``items`` holds finished results."""

    def __init__(self):
        super().__init__()
        self.items: list[dict[str, str]] = []
        self.body: list[str] | None = None
        self.about: dict[str, list[str]] | None = None
        self.open: list[str] | None = None
        self.label: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        kind = (dict(attrs).get("class") or "").split()
        if tag == "div" and TEXT in kind:
            self.body, self.about, self.label = [], None, None
            self.open = self.body
        elif tag == "div" and ABOUT in kind and self.body is not None:
            self.about, self.open = {}, None
        elif tag == "span" and LABEL in kind and self.about is not None:
            self.label = self.open = []

    def handle_endtag(self, tag):
        if tag == "span" and self.label is not None and self.open is self.label:
            self.open = self.about[shown(self.label).rstrip(" :")] = []
        elif tag == "div" and self.about is not None:
            self._finish()
        elif tag == "div" and self.open is self.body:
            self.open = None

    def handle_data(self, data):
        if self.open is not None:
            self.open.append(data)

    def _finish(self):
        values = {FIELDS[k]: shown(v) for k, v in self.about.items() if k in FIELDS}
        self.items.append({"text": re.sub(r"^\d+\s*-\s*", "", shown(self.body))} | values)
        self.body = self.about = self.open = self.label = None


def shown(parts: list[str]) -> str:
    """White space squeezed; a no-break space is one, too."""
    return " ".join("".join(parts).split())


def read(answer: str | None) -> list[dict[str, str]]:
    """Results of one answer: text, rawi, muhaddith, book, ref, verdict as far as they are there."""
    events = _Events()
    events.feed(answer or "")
    events.close()
    return events.items


_ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("text", *FIELDS.values())])


@F.pandas_udf(T.ArrayType(_ITEM))
def _items(s: pd.Series) -> pd.Series:
    return s.map(lambda a: [{c: r.get(c) for c in _ITEM.names} for r in read(a)])


def fields(answers: DataFrame) -> DataFrame:
    """(key, item_no, text, rawi, muhaddith, book, ref, verdict) of answers (key, result) in the service's plain layout.

    Unknown labels are ignored; other HTML and empty answers have no rows.
    """
    return answers.where("result is not null").select("key", F.posexplode(_items("result")).alias("p", "item")).select("key", (F.col("p") + 1).alias("item_no"), "item.*")
