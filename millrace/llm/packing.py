"""Bounded-space online packing of token sequences.

Each partition keeps ``windows`` open windows. A document longer than a window fills whole
windows first; its rest goes to the open window that it fits best. When none fits, the
fullest is emitted: as it is, if its free part is ``slack`` tokens at most, else topped up with
the rest's head, and the remainder is placed anew. So padding is at most ``slack`` a sequence
and few documents that fit a window are cut. What stays open at the end of a partition is
merged: rounds of a bounded fan-in run the same packing over the left-over pieces, and the
last one cuts what is left into powers of two, which need no padding.

Which pieces share a sequence, and the sequences' ids, follow from the order and partitions of
the input; each id of each document lies in one piece, whatever they are.

Defined cases: a null text is empty; an empty text is its end id alone; rows with equal ids
are packed each, equal rows too; very long texts are cut into full windows; of windows that
fit equally well the one opened first is taken; an empty table gives no pieces; other
columns, of whatever name, are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows, stored
from .textops import slices, texts_of
from .token_files import crc_of_ids, parquet_options
from .tokens import default_tokenizer, encoder, with_end

WINDOW, OPEN_WINDOWS, FAN_IN, SLACK = 2048, 64, 32, 64
PIECE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")]
    + [T.StructField("open", T.BooleanType()), T.StructField("part", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
)


class Packer:
    """Open windows of one partition. ``emit`` gets the pieces of a finished sequence."""

    def __init__(self, size: int, windows: int, slack: int = 0):
        self.size, self.windows, self.slack = size, windows, slack
        self.free: list[int] = []  # of the open windows, ascending
        self.open: list[list] = []  # their pieces
        self.done: list[list] = []

    def _keep(self, free: int, pieces: list) -> None:
        if free:
            k = bisect_right(self.free, free)
            self.free.insert(k, free)
            self.open.insert(k, pieces)
        else:
            self.done.append(pieces)

    def add(self, doc_id, start: int, doc_tokens: int, ids: np.ndarray) -> None:
        while len(ids):
            k = bisect_left(self.free, len(ids))
            if len(ids) >= self.size:
                free, pieces = self.size, []
            elif k < len(self.free):
                free, pieces = self.free.pop(k), self.open.pop(k)
            elif len(self.free) < self.windows:
                free, pieces = self.size, []
            else:
                free, pieces = self.free.pop(0), self.open.pop(0)
                if free <= self.slack:
                    self.done.append(pieces)
                    continue
            head, ids = ids[:free], ids[free:]
            pieces.append((doc_id, start, doc_tokens, head))
            start += len(head)
            self._keep(free - len(head), pieces)

    def close(self) -> None:
        """Ends all: what is left follows each other in windows, the last ones powers of two."""
        pieces = [p for own in self.open for p in own]
        left, self.open, self.free = sum(len(p[3]) for p in pieces), [], []
        while left:
            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= room
            sequence = []
            while room:
                doc_id, start, n, ids = pieces.pop(0)
                if len(ids) > room:
                    pieces.insert(0, (doc_id, start + room, n, ids[room:]))
                    ids = ids[:room]
                sequence.append((doc_id, start, n, ids))
                room -= len(ids)
            self.done.append(sequence)


def _pieces(sequences: list[list], first_id: int, is_open: bool, part: int) -> pa.RecordBatch:
    rows = [(p[0], p[1], len(p[3]), p[2], first_id + k, p[3]) for k, s in enumerate(sequences) for p in s]
    length = np.array([r[2] for r in rows], np.int64)
    at = np.concatenate([[0], np.cumsum(length)])
    per = np.array([sum(len(p[3]) for p in s) for s in sequences], np.int64)
    base = np.repeat(np.cumsum(per) - per, [len(s) for s in sequences])
    column = lambda k: pa.array([r[k] for r in rows], pa.int64())
    ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([r[5] for r in rows]) if rows else np.zeros(0), pa.int32()))
    return pa.RecordBatch.from_arrays(
        [column(0), column(1), pa.array(length), column(3), column(4), pa.array(at[:-1] - base), pa.array([is_open] * len(rows), pa.bool_()), pa.array([part] * len(rows), pa.int64()), ids], names=PIECE.names
    )


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, size: int = WINDOW, windows: int = OPEN_WINDOWS, slack: int = SLACK) -> DataFrame:
    """Pieces with their ids: doc_id, start, length, doc_tokens, sequence_id, offset, ids."""
    path = tokenizer or default_tokenizer()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, made = encoder(path), Packer(size, windows, min(slack, size // 32)), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, at = with_end(*enc.encode(texts_of(rows)), end_id)
                for doc_id, a, b in zip(rows.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    packer.add(doc_id, 0, b - a, ids[a:b])
                yield _pieces(packer.done, (part << 32) + made, False, part)
                made += len(packer.done)
                packer.done = []
        if packer.open:
            yield _pieces(packer.open, (part << 32) + made, True, part)

    def merge(level: int, last: bool):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            packer, part = Packer(size, windows, min(slack, size // 32)), int(rows["part"].iloc[0]) // FAN_IN
            for r in rows.sort_values(["sequence_id", "offset"]).itertuples():
                packer.add(None if pd.isna(r.doc_id) else int(r.doc_id), int(r.start), int(r.doc_tokens), np.asarray(r.ids, np.int32))
            if last:
                packer.close()
            first = (level << 56) + (part << 32)
            out = [_pieces(packer.done, first, False, part)]
            if packer.open:
                out.append(_pieces(packer.open, first + len(packer.done), True, part))
            return pa.Table.from_batches(out).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

        return run

    arrow_rows(docs.sparkSession)
    # Written once: a partition that is computed again must not be packed otherwise than its left-overs were.
    level, table = 0, stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(place, PIECE), "packed", **parquet_options())
    parts = [table.filter(~F.col("open"))]
    groups = max(1, (table.agg(F.max("part")).first()[0] or 0) + 1)
    while True:
        level, groups = level + 1, -(-groups // FAN_IN)
        left = table.filter("open").groupBy(F.expr(f"part div {FAN_IN}")).applyInPandas(merge(level, groups == 1), PIECE)
        table = stored(left, f"packed-{level}")
        parts.append(table.filter(~F.col("open")))
        if groups == 1:
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("open", "part")


def piece_digests(pieces: DataFrame) -> DataFrame:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(crc_of_ids(b))], names=[*names, "ids_crc32"])

    return pieces.select(*names, "ids").mapInArrow(digest, ", ".join(f"{n} long" for n in [*names, "ids_crc32"]))
