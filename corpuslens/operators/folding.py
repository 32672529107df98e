"""Route trees with merging of fuller and shorter spellings: an order-dependent fold over the routes of one record.

A name joins the first child, in order of creation, that has the same spelling or of which one begins with the other;
the longer spelling becomes the label, shorter ones its variants.  A record has at most ``MAX_ROUTES`` routes of a few
names, so its routes fit one row and the fold needs no other record.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parser import same_or_prefix

SCHEMA = "id string, node int, parent int, depth int, label string, kind string, merge string, variants array<string>, routes int, linked boolean"


def fold(routes: list[tuple[int, list[str], bool]]) -> list[dict]:
    """Nodes of the routes (number, names from the root, linked), in order of creation; parent 0 is the root.

    Routes of one name that don't reach the root are left out.
    """
    nodes: list[dict] = []
    children: dict[int, list[int]] = {}
    for no, names, linked in routes:
        if not names or (len(names) < 2 and not linked):
            continue
        at = 0
        for depth, name in enumerate(names, 1):
            kind = "companion" if depth == 1 else "narrator"
            hit = next((c for c in children.get(at, []) if same_or_prefix(nodes[c - 1]["label"], name)), None)
            if hit is None:
                nodes.append({"node": len(nodes) + 1, "parent": at, "depth": depth, "label": name, "kind": kind, "merge": "exact", "variants": [], "routes": set(), "linked": False})
                hit = len(nodes)
                children.setdefault(at, []).append(hit)
            n = nodes[hit - 1]
            if name != n["label"]:
                n["merge"] = "prefix"
                longer, shorter = sorted((name, n["label"]), key=lambda s: -len(s.split()))
                n["label"] = longer
                if shorter not in n["variants"]:
                    n["variants"].append(shorter)
            n["routes"].add(no)
            n["linked"] |= linked
            at = hit
    return [n | {"routes": len(n["routes"])} for n in nodes]


def folded(rts: DataFrame) -> DataFrame:
    """Nodes of each record's tree, from routes (id, route_no, names from the root, linked)."""
    rows = rts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("route_no", "names", "linked"))).alias("routes"))

    def run(batches):
        for pdf in batches:
            out = [{"id": i} | n for i, routes in zip(pdf["id"], pdf["routes"]) for n in fold([(r["route_no"], list(r["names"]), bool(r["linked"])) for r in routes])]
            yield pd.DataFrame(out, columns=[c.strip().split()[0] for c in SCHEMA.split(",")])

    return rows.mapInPandas(run, SCHEMA)
