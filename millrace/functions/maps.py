"""Open-data rows as maps of text: field resolution and row dumps.

A row is map<string,string>; values of objects and lists are their JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,string>"


def row_map(json_text: Column) -> Column:
    return F.from_json(json_text, MAP)


def resolve(row: Column, candidates: tuple[str, ...], override: str | None = None) -> Column:
    """The first candidate that is there and not null; with ``override``, that field only."""
    if override is not None:
        return F.try_element_at(row, F.lit(override))
    return F.coalesce(*(F.try_element_at(row, F.lit(c)) for c in candidates))


def _lower_keys(row: Column) -> Column:
    """Keys in lower case; of keys that differ in case only, the last one's value."""
    entries = F.map_entries(row)
    return F.aggregate(entries, F.create_map().cast(MAP), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))


def resolve_any_case(row: Column, candidates: tuple[str, ...]) -> Column:
    """As ``resolve``, whatever the keys' case; -1 stands for null."""
    low = _lower_keys(row)
    return F.coalesce(*(F.nullif(F.try_element_at(low, F.lit(c)), F.lit("-1")) for c in candidates))


def _dump(row: Column, keep) -> Column:
    kept = F.array_sort(F.map_entries(F.map_filter(row, keep)))
    text = F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return squash(text)


def squash(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def dump(row: Column) -> Column:
    """``key: value`` in key order, without computed keys (:...) and nulls; of an address object
    its ``human_address``."""
    flat = F.transform_values(row, lambda _, v: F.coalesce(F.when(v.startswith("{"), F.get_json_object(v, "$.human_address")), v))
    return _dump(flat, lambda k, v: ~k.startswith(":") & v.isNotNull())


def dump_features(row: Column) -> Column:
    return _dump(row, lambda _, v: v.isNotNull() & (v != "-1"))
