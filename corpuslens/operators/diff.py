"""Word differences between a pasted text and a source, cropped to the part around the match."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame

from .search import _key

CONTEXT = 8
SCHEMA = "ops array<struct<kind:string,user:string,source:string>>"


def focused(user: str | None, source: str | None, context: int = CONTEXT, crop: bool = True) -> list[tuple[str, str, str]]:
    """(kind, user words, source words): same, replace, delete, insert, ctx (source around the match) and gap (cut off).

    Source words stay as stored.  Without any common word nothing is cropped.
    """
    typed, stored = (user or "").split(), (source or "").split()
    matcher = difflib.SequenceMatcher(a=[_key(w) for w in typed], b=[_key(w) for w in stored], autojunk=False)
    blocks = [m for m in matcher.get_matching_blocks() if m.size]
    core = (blocks[0].b, blocks[-1].b + blocks[-1].size) if blocks else (0, len(stored))
    low, high = (max(0, core[0] - context), min(len(stored), core[1] + context)) if crop and blocks else (0, len(stored))
    out = [("gap", "", "…")] if low else []
    for kind, i, j, k, m in matcher.get_opcodes():
        shown = " ".join(stored[max(k, low) : min(m, high)])
        if kind == "equal":
            out += [("same", "", shown)] if shown else []
        elif blocks and i == j and (m <= core[0] or k >= core[1]):
            out += [("ctx", "", shown)] if shown else []
        elif shown or (j > i and low <= k <= high):
            out.append((kind, " ".join(typed[i:j]), shown))
    return out + ([("gap", "", "…")] if high < len(stored) else [])


def word_differences(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, ops) of pairs (a_id, b_id, a = pasted, b = source)."""

    def run(batches):
        for pdf in batches:
            ops = [[dict(zip(("kind", "user", "source"), op)) for op in focused(a, b)] for a, b in zip(pdf["a"], pdf["b"])]
            yield pd.DataFrame({"a_id": pdf["a_id"], "b_id": pdf["b_id"], "ops": ops})

    return pairs.select("a_id", "b_id", "a", "b").mapInPandas(run, f"a_id string, b_id string, {SCHEMA}")
