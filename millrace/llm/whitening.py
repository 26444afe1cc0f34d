"""Whitening of embeddings from an exact scatter in residue numbers.

Entries become whole numbers, floor(scale * c) + shift, and the fit list is each distinct vector of
them once. Its scatter is exact: each partition multiplies blocks of residues modulo several primes
in doubles, which hold such products and their sums exactly; Spark adds the residues of all
partitions; Chinese remaindering gives the whole numbers back, with as many primes as their
size needs. A column of ones beside the entries gives count and sums by the same product. So
the covariance is centred in whole numbers, without rounding, however far the entries lie from
zero, and doesn't depend on how rows are dealt. Its eigenvectors come from a double eigh, whose
rest beside the diagonal is rotated away in extended precision.

The fit list is written once to the shared folder, as several jobs read it. The driver gets residues
of the scatter (a number for each pair of dimensions and prime) and sums, nothing that grows with rows.

Defined cases: vectors that are null, empty, or hold null or non-finite entries are dropped, and so are
those of another length than most have (of equally frequent lengths the least holds); repeated
rows are rows of their own, but count once in the fit; rows with equal ids are rows each; of
dimensions without spread the components are null when whitened, and so is ``explained`` if there is no
spread at all; there are as many components as dimensions if that is fewer; a deviation beyond a
long is null; entries beyond 2**61 after scaling are held there; an empty table gives no rows;
other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows, stored
from .vectors import matrix, scaled, usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LARGEST = 1 << 61
#: Primes lie below PRIME_BITS bits; with residues of half their size, BLOCK products add up exactly in a double.
PRIME_BITS, BLOCK = 21, 4096


def primes(product: int, bits: int = PRIME_BITS) -> list[int]:
    """The largest primes below 2**bits whose product is greater than ``product``."""
    out, p = [], (1 << bits) - 1
    while prod(out) <= product:
        if all(p % q for q in range(3, isqrt(p) + 1, 2)):
            out.append(p)
        p -= 2
    return out


def residue_scatter(x: np.ndarray, moduli: list[int], into: np.ndarray) -> None:
    """Adds the products of the columns of ``x`` (whole numbers) to ``into``, modulo each of the moduli."""
    for a in range(0, len(x), BLOCK):
        for k, p in enumerate(moduli):
            r = np.mod(x[a : a + BLOCK], p)
            r -= p * (r > p // 2)
            r = r.astype(np.float64)
            into[k] = np.mod(into[k] + (r.T @ r).astype(np.int64), p)


def remaindered(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Whole numbers (Python's) from their residues, of least size."""
    whole = prod(moduli)
    out = sum(r.astype(object) * (whole // p * pow(whole // p, -1, p)) for r, p in zip(residues, moduli, strict=True)) % whole
    return np.where(out > whole // 2, out - whole, out)


def extended(x: np.ndarray) -> np.ndarray:
    """Whole numbers in extended precision."""
    high = x.astype(np.float64)
    rest = np.frompyfunc(lambda a, h: a - int(h), 2, 1)(x, high)
    return high.astype(np.longdouble) + rest.astype(np.float64).astype(np.longdouble)


def eigen(v: np.ndarray, sweeps: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in extended
    precision: a double eigh, then plane rotations of what it leaves beside the diagonal."""
    x = np.linalg.eigh(v.astype(np.float64))[1].astype(np.longdouble)
    x = x @ (1.5 * np.eye(len(v), dtype=np.longdouble) - x.T @ x / 2)  # orthogonal beyond a double
    t = x.T @ v @ x
    least = np.finfo(np.longdouble).eps * np.abs(t).max(initial=0)
    for _ in range(sweeps):
        for i, j in np.argwhere(np.triu(np.abs(t), 1) > least):
            if abs(t[i, j]) <= least:
                continue
            half = (t[j, j] - t[i, i]) / (2 * t[i, j])
            tan = (1 if half >= 0 else -1) / (abs(half) + np.sqrt(half * half + 1))
            cos = 1 / np.sqrt(tan * tan + 1)
            turn = np.array([[cos, tan * cos], [-tan * cos, cos]])
            own = [i, j]
            t[:, own] = t[:, own] @ turn
            t[own] = turn.T @ t[own]
            x[:, own] = x[:, own] @ turn
    order = np.argsort(-np.diag(t), kind="stable")
    e, x = np.diag(t)[order], x[:, order]
    return e, x * np.where(x[np.abs(x).argmax(0), np.arange(len(v))] < 0, -1, 1)


@dataclass
class Whitening:
    """A fitted transformation. ``sums`` and ``n`` are of the fit list's whole numbers less ``shift``."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int
    shift: int
    identity_error: float | None = None

    @property
    def rates(self) -> np.ndarray:
        """Factors of the components, NaN of those without spread."""
        least = max(float(self.values.max(initial=0)) * len(self.sums) * 1e-18, 0.0)
        return np.array([1 / float(e) ** 0.5 if e > least else np.nan for e in self.values])

    @property
    def explained(self) -> list[float | None]:
        return [max(float(e), 0.0) / self.trace if self.trace else None for e in self.values]

    def centred(self, y: np.ndarray) -> np.ndarray:
        """y - sums / n: the whole part first, which is exact."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (y - whole).astype(np.float64) - np.array([s % self.n / self.n for s in self.sums])

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return self.centred(y) @ (self.vectors * self.rates)

    def deviations(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of (n * y - sums)**2 modulo 2**64, which is exact where they fit a long, and where they do."""
        n, sums = np.uint64(self.n % (1 << 64)), np.array([s % (1 << 64) for s in self.sums], np.uint64)
        d = y.astype(np.uint64) * n - sums
        about = ((self.centred(y) * float(self.n)) ** 2).sum(1)
        return (d * d).sum(1, dtype=np.uint64).view(np.int64), about < float(1 << 63) * (1 - 1e-9)


def whole_numbers(rows: DataFrame, vector: str, length: int, scale: int) -> DataFrame:
    """Distinct vectors of whole numbers (column ``y``, the shift left out)."""
    most = float(LARGEST)
    entry = lambda c: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(c.cast("double") * scale).cast("double"))).cast("long")
    return rows.select(F.transform(vector, entry).alias("y")).distinct()


def fit_scatter(fit: DataFrame, length: int) -> tuple[int, list[int], np.ndarray]:
    """Count, sums, and count * products - sums * sums of the vectors ``y``, all exact."""
    n, most = fit.agg(F.count("*"), F.max(F.array_max(F.transform("y", F.abs)))).first()
    moduli = primes(2 * max(n, 1) * max(most or 0, 1) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), length + 1, length + 1), np.int64)
        for b in batches:
            residue_scatter(np.hstack([np.ones((b.num_rows, 1), np.int64), matrix(b, "y", length)]), moduli, total)
        i, j = np.triu_indices(length + 1)
        for k in range(len(moduli)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[k][i, j])], names=["k", "i", "j", "r"])

    sums = fit.mapInArrow(run, "k int, i int, j int, r long").groupBy("k", "i", "j").agg(F.sum("r").alias("r")).toPandas()
    residues = [np.zeros((length + 1, length + 1), np.int64) for _ in moduli]
    for k, own in sums.groupby("k"):
        i, j, r = (own[c].to_numpy() for c in ("i", "j", "r"))
        residues[k][i, j] = residues[k][j, i] = np.mod(r, moduli[k])
    whole = remaindered(residues, moduli)
    first = whole[0, 1:]
    return int(whole[0, 0]), [int(s) for s in first], int(whole[0, 0]) * whole[1:, 1:] - np.outer(first, first)


def measured_error(fit: DataFrame, model: Whitening) -> float:
    """The greatest entry in size of the whitened fit list's covariance less the identity."""
    length, wide = len(model.sums), int(np.isfinite(model.rates).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide + 1, wide + 1))
        for b in batches:
            w = np.hstack([np.ones((b.num_rows, 1)), model.whitened(matrix(b, "y", length))[:, :wide]])
            total += w.T @ w
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    got = np.zeros((wide + 1, wide + 1))
    for r in fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        got[r.i, r.j] = r.v / model.n
    # Rows were centred before multiplying; what is left of their mean goes here.
    return float(np.abs(got[1:, 1:] - np.outer(got[0, 1:], got[0, 1:]) - np.eye(wide)).max(initial=0))


def fit_whitening(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The transformation of ``rows``, None if no vector is usable."""
    arrow_rows(rows.sparkSession, BLOCK)
    kept, length = usable(rows, vector)
    if not length:
        return None
    fit = stored(whole_numbers(kept, vector, length, scale), "whitening-fit")
    n, sums, scatter = fit_scatter(fit, length)
    values, vectors = eigen(extended(scatter) / np.longdouble(n) ** 2)
    model = Whitening(n, sums, values[:components], vectors[:, :components].astype(np.float64), int(sum(np.diag(scatter))) / n**2, scale, shift)
    model.identity_error = measured_error(fit, model)
    return model


def whiten(rows: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """``rows`` with usable vectors, and ``whitened`` (an array of the components' values) and ``deviation``."""
    arrow_rows(rows.sparkSession, BLOCK)
    kept, length = usable(rows, vector)
    length = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = scaled(matrix(b, vector, length), model.scale, LARGEST)
            w, (deviation, fits) = model.whitened(y), model.deviations(y)
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), flat)
            yield b.append_column("whitened", lists).append_column("deviation", pa.array(deviation, mask=~fits))


    schema = T.StructType([f for f in kept.schema.fields if f.name not in ("whitened", "deviation")] + [T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())])
    return kept.drop("whitened", "deviation").filter(F.size(vector) == length).mapInArrow(run, schema)


def components(rows: DataFrame) -> DataFrame:
    """A row for each usable row of ``rows`` (vec_id, embedding) and component."""
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    model = fit_whitening(own)
    if model is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    told = whiten(own, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*(F.lit(e).cast("double") for e in model.explained))
    return told.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
