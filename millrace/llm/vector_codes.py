"""Compression of vectors to codes of their parts, in whole numbers.

Components become floor(scale * x); a vector is cut into equal consecutive parts, and each part
position has a codebook. The codebooks are broadcast (positions times entries times a part's
length, whatever the table), Arrow batches compute all squared distances by expanding the norm,
|c|**2 - 2 x c, with products of int64 matrices, and take the first least one. A round's
sums of each entry's parts are made in each partition and merged by a grouped shuffle; the driver gets
them, a row for each entry, and makes the new codebooks. All of it is exact, so results don't
depend on how rows are dealt.

Defined cases: vectors that are null, empty, or hold null or non-finite components are dropped, and so are
those of another length than most have (of equally frequent lengths the least holds); a length
that isn't a multiple of the number of parts is filled up with zeros; the codebooks start with the
least vector of each of the least ids, null being no id unless there are too few others; with fewer
ids than entries the codebooks are as much shorter; rows with equal ids are rows each; components
beyond what distances of a long can hold (some 2**27 with 64 of them) are held there; an empty
table gives no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows, fresh, join_skewed, stored
from .vectors import matrix, scaled, usable

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
BLOCK = 1024


@dataclass
class Codebooks:
    """``entries``: whole numbers by part position, entry, and place in the part."""

    entries: np.ndarray
    length: int
    scale: int

    @property
    def largest(self) -> int:
        """What components are held at, so that a whole vector's squared distance fits a long."""
        return isqrt((1 << 63) // max(1, self.length)) // 2 - 1

    def split(self, x: np.ndarray) -> np.ndarray:
        """Vectors as whole numbers, by part position, row, and place in the part."""
        parts, _, wide = self.entries.shape
        out = np.zeros((len(x), parts * wide), np.int64)
        out[:, : x.shape[1]] = scaled(x, self.scale, self.largest)
        return out.reshape(len(x), parts, wide).transpose(1, 0, 2)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry (the first of equally near ones) of each part (rows) of each vector (columns),
        and the vectors' squared distances from what the codes say."""
        norms = (self.entries**2).sum(2)
        far = norms[:, None, :] - 2 * np.matmul(x, self.entries.transpose(0, 2, 1))
        code = far.argmin(2)
        return code, (np.take_along_axis(far, code[:, :, None], 2)[:, :, 0] + (x**2).sum(2)).sum(0)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Vectors that codes (a row each) stand for: the middle of what has their whole numbers."""
        own = self.entries[np.arange(len(self.entries)), codes]
        return (own.reshape(len(codes), -1)[:, : self.length] + 0.5) / self.scale

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def first_codebooks(kept: DataFrame, length: int, key: str, vector: str, parts: int, entries: int, scale: int) -> Codebooks:
    """The parts of the least vector of each of the least ids."""
    least = [r[0] for r in kept.select(key).distinct().orderBy(F.asc_nulls_last(key)).limit(entries).collect()]
    at_most = kept.filter(F.col(key) <= F.lit(least[-1])) if least[-1] is not None else kept.filter(F.col(key).isNull() | F.col(key).isin(least[:-1]))
    rows = at_most.groupBy(key).agg(F.min(vector).alias("v")).orderBy(F.asc_nulls_last(key)).collect()
    wide = -(-length // parts)
    empty = Codebooks(np.zeros((parts, len(rows), wide), np.int64), length, scale)
    empty.entries = np.ascontiguousarray(empty.split(np.array([[float(c) for c in r.v] for r in rows])))
    return empty


def entry_sums(kept: DataFrame, vector: str, books: Codebooks) -> DataFrame:
    """Part position, entry, number of parts that it is nearest to, and their sums by place in the part."""
    parts, entries, wide = books.entries.shape
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count, total = shared.value, np.zeros(parts * entries, np.int64), np.zeros((wide, parts * entries), np.int64)
        for b in batches:
            x = own.split(matrix(b, vector, own.length))
            at = (own.assign(x)[0] + entries * np.arange(parts)[:, None]).ravel()
            count += np.bincount(at, minlength=len(count))
            for place in range(wide):
                np.add.at(total[place], at, np.ascontiguousarray(x[:, :, place]).ravel())
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array((used // entries).astype(np.int32)), pa.array((used % entries).astype(np.int32)), pa.array(count[used]), *(pa.array(t[used]) for t in total)], names=names)

    names = ["part", "entry", "n", *(f"s{i}" for i in range(wide))]
    sums = kept.select(vector).mapInArrow(run, ", ".join(f"{c} {'int' if c in ('part', 'entry') else 'long'}" for c in names))
    return sums.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names[2:]))


def fit_codebooks(kept: DataFrame, length: int, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks after ``rounds`` of assigning all parts and moving entries to floor(mean); unused ones stay."""
    arrow_rows(kept.sparkSession, BLOCK)
    books = first_codebooks(kept, length, key, vector, parts, entries, scale)
    for _ in range(rounds):
        moved = books.entries.copy()
        for part, entry, n, *sums in entry_sums(kept, vector, books).collect():
            moved[part, entry] = [s // n for s in sums]
        books = Codebooks(moved, books.length, books.scale)
    return books


def encode(rows: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """``rows`` (usable vectors of the codebooks' length) without the vector, with ``codes`` (an array
    of entries by part position) and ``error``."""
    arrow_rows(rows.sparkSession, BLOCK)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    others = [f for f in rows.schema.fields if f.name not in (vector, "codes", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error = shared.value.assign(shared.value.split(matrix(b, vector, shared.value.length)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, len(code), dtype=np.int32)), pa.array(code.T.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in others), lists, pa.array(error)], names=[*(f.name for f in others), "codes", "error"])

    schema = T.StructType([*others, T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    return rows.select(*(f.name for f in others), vector).mapInArrow(run, schema)


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` (a stored table) with ``label_error``: the error summed over equal labels, nulls together."""
    key, rows = fresh(coded, "__label", "__rows")
    # A label as text, with nothing before it only where it is null.
    own = coded.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")))
    sums = stored(own.groupBy(key).agg(F.sum("error").alias("label_error"), F.count("*").alias(rows)), "label-errors")
    return join_skewed(own.drop("label_error"), sums, key, rows, coded.count()).drop(key, rows)


def codes_table(rows: DataFrame) -> DataFrame:
    """vec_id, code (hex digits), error, label_error and the codebooks' digest of each usable row of
    ``rows`` (vec_id, embedding, label)."""
    kept, length = usable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"))
    if not length:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = fit_codebooks(kept, length)
    told = with_label_error(stored(encode(kept, books), "vector-codes"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return told.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
