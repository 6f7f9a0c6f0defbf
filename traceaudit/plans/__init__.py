"""Registered queries over the standard tables, grouped by audit family."""

from __future__ import annotations

from importlib import import_module

from traceaudit.plans.registry import Query

FAMILIES = (
    "corpus", "provenance", "monitor", "traffic", "capability", "fidelity", "quality", "cost",
    "transcripts", "text", "watermark", "sources", "streams", "checks", "adapters",
)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for family in FAMILIES:
        for name, query in import_module(f"traceaudit.plans.{family}").CATALOG.queries.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = query
    return found
