"""The named queries of the engine and their SQL counterparts."""

from __future__ import annotations

from pageline.plans import pages, queries, runs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for part in (queries, pages, runs):
    for name, f in part.registry.queries.items():
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
    ORACLES.update(part.registry.oracles)
