"""Folds and cuts over arrays in native expressions.

Spark has no running fold, and ``aggregate`` copies what it has gathered at each step, so
appending in it costs the square of an array's length. ``running`` folds blocks of about the
cube root of the length: first without gathering, for the states that blocks start with, then
each block on its own. ``pieces`` cuts a text in blocks for a like reason: a substring costs a
walk from its string's start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], state: str) -> Column:
    """The fold's states (of SQL type ``state``) after each item, from ``zero`` on."""

    def told(own: Column) -> Column:
        n = F.size(own)
        size = F.ceil(F.cbrt(n)).cast("int")
        places = lambda k: F.sequence(k * size, F.least((k + 1) * size, n) - 1)
        blocks = F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)
        after = lambda at, j: step(at, F.get(own, j)).cast(state)

        def gathered(first: Column, k: Column) -> Column:
            states = F.aggregate(places(k), F.array(first), lambda acc, j: F.concat(acc, F.array(after(F.element_at(acc, -1), j))))
            return F.slice(states, 2, size)

        first = F.aggregate(blocks, F.array(zero.cast(state)), lambda acc, k: F.concat(acc, F.array(F.aggregate(places(k), F.element_at(acc, -1), after))))
        return F.when(n > 0, let(first, lambda starts: F.flatten(F.transform(blocks, lambda k: gathered(F.get(starts, k), k))))).otherwise(F.array().cast(f"array<{state}>"))

    return let(items, told)


def pieces(text: Column, bounds: Column) -> Column:
    """The parts of ``text`` from ``a`` to ``b`` (code points, end exclusive) of an array of such
    bounds, which don't overlap and ascend."""

    def block(own: Column) -> Column:
        base = own[0]["a"]
        cut = F.struct(own.alias("own"), base.alias("base"), F.substring(text, base + 1, F.element_at(own, -1)["b"] - base).alias("text"))
        return let(cut, lambda x: F.transform(x["own"], lambda g: F.substring(x["text"], g["a"] - x["base"] + 1, g["b"] - g["a"])))

    def whole(all_bounds: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_bounds))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(all_bounds), size), lambda k: let(F.slice(all_bounds, k, size), block))
        return F.when(F.size(all_bounds) > 0, F.flatten(blocks)).otherwise(F.array().cast("array<string>"))

    return let(bounds, whole)
