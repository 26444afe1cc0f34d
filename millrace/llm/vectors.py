"""Vectors of a table as whole-number matrices, batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows whose vector has only finite entries and the length that most of these have (of
    equally frequent ones the least), and that length, which is zero if there are none."""
    own = F.col(vector)
    finite = rows.filter(own.isNotNull() & (F.size(own) > 0) & F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    most = finite.groupBy(F.size(own).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return finite.filter(F.size(own) == (most.n if most else 0)), most.n if most else 0


def matrix(batch: pa.RecordBatch, column: str, length: int) -> np.ndarray:
    """The lists of a column without nulls, all of ``length`` entries, as a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def scaled(x: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) in whole numbers, held at ``most`` in size."""
    return np.clip(np.floor(x.astype(np.float64) * scale), -float(most), float(most)).astype(np.int64)
