"""All registered queries: name -> (Spark query, SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "prep_queries", "text_queries", "graph_queries", "vector_queries", "compose_queries", "train_queries",
    "ml_queries", "source_queries",
)


def all_queries() -> dict:
    out = {}
    for module in MODULES:
        found = import_module(f"tablevec.plans.{module}").QUERIES
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out.update(found)
    return out
