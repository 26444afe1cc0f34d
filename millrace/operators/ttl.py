"""Time to live: which attempts fetch, and which a key's mark suppresses.

An attempt that fetches leaves a mark until its time plus its time to live; attempts before that are
skipped and leave the mark as it is. So from each attempt, were it to fetch, the next one that fetches is
known: the first at or after its mark's end. Attempts are dealt to tasks by ranges of (key, time) and
read in spans of sorted rows. In a span all next attempts are found by one sort of times and ends
together, and chains of them are followed by doubling: each round doubles the steps that a pointer
spans. No attempt is looked at alone.

A key that lies within one span is done by that. One that goes over several is, in each, a function of
the mark's end that it comes in with: how many attempts fetch, and the end of the mark it leaves. A
key's functions are applied one after another by binary search. A mark doesn't reach further than the
longest time to live, so a function's places are the attempts that near its span's start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.session import ship_package

SPAN = 250_000
#: No mark: everything is fetched.
NONE = -(1 << 62)


def next_fetch(group: np.ndarray, at: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Of each row the first later one of its group at or after its mark's end, else the group's end."""
    n = len(at)
    order = np.lexsort((np.repeat([1, 0], n), np.concatenate([at, until]), np.concatenate([group, group])))
    is_row = order < n
    before = np.cumsum(is_row)
    out = np.empty(n, np.int64)
    out[order[~is_row] - n] = before[~is_row]
    return np.maximum(out, np.arange(1, n + 1))


def chains(group: np.ndarray, at: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, were it to fetch: how many of its group fetch from it on, and the last one's mark's end."""
    n = len(at)
    jump = next_fetch(group, at, until)
    jump = np.where((jump < n) & (group[np.minimum(jump, n - 1)] == group), jump, n)
    count, last = np.ones(n, np.int64), np.arange(n)
    while len(on := np.flatnonzero(jump < n)):
        to = jump[on]
        count[on], last[on], jump[on] = count[on] + count[to], last[to], jump[to]
    return count, until[last]


def _spans(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _places(a: int, b: int, at: np.ndarray, count: np.ndarray, out: np.ndarray, longest: int) -> tuple[list, list, list]:
    """The function of rows a to b: for an incoming end of at most ``cuts[i]`` the i-th value, beyond all
    cuts none (nothing fetches); ends beyond what a mark before them can have are left out."""
    stop = a + int(np.searchsorted(at[a:b], at[a] + longest, "left")) + 1
    own = slice(a, min(b, stop))
    cuts, n, end = at[own], count[own], out[own]
    same = np.append((n[1:] == n[:-1]) & (end[1:] == end[:-1]), False)
    return cuts[~same].tolist(), n[~same].tolist(), end[~same].tolist()


def suppress_by_ttl(fetches: DataFrame, key: str, at: str, ttl_seconds: str, span: int = SPAN) -> DataFrame:
    """The key, and how many of its attempts are fetched and skipped. An attempt without a time, or
    whose time to live isn't known, fetches and leaves no mark; those without a time come first."""
    ship_package(fetches.sparkSession)
    rows = fetches.select(key, F.coalesce(F.col(at).cast("long"), F.lit(NONE)).alias("__at"), F.coalesce(F.col(at).cast("long") + F.col(ttl_seconds).cast("long"), F.lit(NONE)).alias("__until"))
    longest = max(rows.agg(F.max(F.when(F.col("__until") > NONE, F.col("__until") - F.col("__at")))).first()[0] or 0, 0)
    function = "__rows long, __fetched long, __order long, __cuts array<long>, __counts array<long>, __ends array<long>"
    schema = T.StructType([fetches.schema[key], *T.StructType.fromDDL(function).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, place = to_arrow_schema(schema), (TaskContext.get().partitionId() << 32)
        for table in _spans(batches, span):
            keys = table.column(key).combine_chunks()
            code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            group = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]]))
            t, until = (table.column(c).to_numpy() for c in ("__at", "__until"))
            count, out = chains(group, t, until)
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.diff(np.append(first, len(t)))
            # Groups but for the first and the last lie within the span as a whole.
            edge = sorted({0, len(first) - 1})
            told = [_places(int(first[g]), int(first[g] + size[g]), t, count, out, longest) for g in edge]
            inner = np.setdiff1d(np.arange(len(first)), edge)
            none = pa.nulls(len(inner), pa.list_(pa.int64()))
            lists = [pa.chunked_array([pa.array([x[i] for x in told], pa.list_(pa.int64())), none]).combine_chunks() for i in range(3)]
            ordered = np.concatenate([edge, inner]).astype(np.int64)
            columns = [keys.take(pa.array(first[ordered])), pa.array(size[ordered]), pa.array(count[first[ordered]]), pa.array(place + np.arange(len(ordered))), *lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            place += len(ordered)

    dealt = rows.repartitionByRange(key, "__at", "__until").sortWithinPartitions(key, "__at", "__until")
    return _composed(dealt.mapInArrow(run, schema), key)


def _composed(functions: DataFrame, key: str) -> DataFrame:
    """Fetched and skipped attempts: as they are of keys within one span; of those that lie in several, or at
    a span's edge, the rows (few) are read once, in order, with the mark's end that the one before leaves."""
    schema = T.StructType([functions.schema[key], T.StructField("fetched", T.LongType()), T.StructField("skipped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, known, own, end, fetched, rows = to_arrow_schema(schema), False, None, NONE, 0, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((own, fetched, rows - fetched), arrow, strict=True)], schema=arrow)
        for b in batches:
            done = pc.is_null(b.column("__cuts"))
            if (whole := b.filter(done)).num_rows:
                fetches = whole.column("__fetched")
                yield pa.RecordBatch.from_arrays([whole.column(0).cast(arrow[0].type), fetches, pc.subtract(whole.column("__rows"), fetches)], schema=arrow)
            b = b.filter(pc.invert(done))
            for i in range(b.num_rows):
                k = b.column(0)[i].as_py()
                if not known or k != own:
                    if known:
                        yield row()
                    known, own, end, fetched, rows = True, k, NONE, 0, 0
                rows += b.column("__rows")[i].as_py()
                cuts, counts, ends = (b.column(c)[i].values.to_numpy() for c in ("__cuts", "__counts", "__ends"))
                if (at := int(np.searchsorted(cuts, end, "left"))) < len(cuts):
                    fetched, end = fetched + int(counts[at]), int(ends[at])
        if known:
            yield row()

    ordered = functions.repartition(key).sortWithinPartitions(key, "__order")
    return ordered.select(key, "__rows", "__fetched", "__cuts", "__counts", "__ends").mapInArrow(run, schema)
