"""All queries of this library but those of the training-data subpackage."""

from __future__ import annotations

from . import base, detect, documents, fetching, health, ingest, parse, registry, stored, text  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
