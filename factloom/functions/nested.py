"""Values in documents that nest to any depth: one pass over a document with a stack of its own.

Column functions have no recursion, and a level for each job would read everything
again for each level, so these two walks are Arrow functions; the documents stay
where they are and nothing is written between levels.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Entries that hold others, and those that name something, with what stands before the name.
COMPOSITES = ("minecraft:alternatives", "minecraft:group", "minecraft:sequence")
LEAVES = {"minecraft:item": "", "minecraft:tag": "#"}


def _listed(value: object) -> list:
    return value if isinstance(value, list) else []


def _entries(document: object) -> Iterator[str]:
    pools = _listed(document.get("pools")) if isinstance(document, dict) else []
    stack = [e for p in pools if isinstance(p, dict) for e in _listed(p.get("entries"))]
    while stack:
        entry = stack.pop()
        if not isinstance(entry, dict):
            continue
        kind, name = entry.get("type"), entry.get("name")
        if kind in COMPOSITES:
            stack += _listed(entry.get("children"))
        elif kind in LEAVES and isinstance(name, str) and name:
            yield LEAVES[kind] + name


def _filters(document: object) -> Iterator[str]:
    rules = document.get("minecraft:spawn_rules") if isinstance(document, dict) else None
    stack = [c.get("minecraft:biome_filter") for c in _listed((rules if isinstance(rules, dict) else {}).get("conditions")) if isinstance(c, dict)]
    while stack:
        test = stack.pop()
        if isinstance(test, list):
            stack += test
        elif isinstance(test, dict):
            inner = next((k for k in ("all_of", "any_of", "none_of") if k in test), None)
            if inner in ("all_of", "any_of"):
                stack.append(test[inner])
            elif inner is None and test.get("test") == "has_biome_tag" and test.get("operator") in (None, "==") and isinstance(test.get("value"), str):
                yield test["value"]


def _sorted(walk: Callable[[object], Iterator[str]], body: Column) -> Column:
    def of(bodies: pa.Array) -> pa.Array:
        out = []
        for text in bodies.to_pylist():
            try:
                out.append(None if text is None else sorted(set(walk(json.loads(text)))))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(of, "array<string>")(body)


def loot_items(body: Column) -> Column:
    """Items and ``#`` tags of a loot table's entries at any depth, sorted and distinct; null of what isn't JSON."""
    return _sorted(_entries, body)


def biome_tags(body: Column) -> Column:
    """Tags that some condition of a spawn rule asks for; what is under ``none_of`` or negated doesn't count."""
    return _sorted(_filters, body)
