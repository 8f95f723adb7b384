"""All registered queries by name: (query, DuckDB text or None)."""

from __future__ import annotations

from . import metric_queries, replay_queries, report_queries, signal_queries, source_queries

MODULES = [metric_queries, replay_queries, signal_queries, source_queries, report_queries]


def entries() -> dict:
    out: dict = {}
    for module in MODULES:
        for name, pair in module.ENTRIES.items():
            if name in out:
                raise ValueError(f"query {name} registered twice")
            out[name] = pair
    return out
