"""Collections of queries, each with its SQL where SQL can express it."""

from __future__ import annotations


class Plan:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def pct(v: str, by: str = "") -> str:
    """The SQL of percent_rank_average()."""
    part = f"PARTITION BY {by}" if by else ""
    tie = f"PARTITION BY {by}, {v}" if by else f"PARTITION BY {v}"
    return f"((rank() OVER ({part} ORDER BY {v}) + (count(*) OVER ({tie}) - 1) / 2.0::DOUBLE) / count(*) OVER ({part}))"
