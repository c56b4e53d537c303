"""Where named queries and their SQL are kept."""

from __future__ import annotations


class Registry:
    """Queries by their function's name, and the SQL of those that have some."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return keep
