"""Every registered query, by name."""

from __future__ import annotations

from importlib import import_module

from meterlens.registered.query import Query

AREAS = ("spend", "kpis", "warehouse", "infra", "aiml", "tags", "users", "cloud")


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for area in AREAS:
        for query in import_module(f"meterlens.registered.{area}").QUERIES:
            if query.name in found:
                raise ValueError(f"two queries named {query.name}")
            found[query.name] = query
    return found
