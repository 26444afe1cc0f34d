"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from millrace.sources.standins import oracle as with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name``."""

    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = with_views(oracle)
        return f

    return keep
