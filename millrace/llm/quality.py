"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of a whole text (lengths, character classes, repetition) are transformed to be
nearly normal. Each class has a mean and a covariance; the covariance is mixed with the
pooled one and shrunk towards a multiple of the identity. The score compares Mahalanobis
distances and log determinants from Cholesky factors that are computed once.

The fit needs only counts, sums and sums of products per class, so it uses every labelled
row of the training folds and gathers a fixed number of values.

Defined cases: null and empty texts have the statistics of an empty text and a score; without
labels of both classes the score is the share of label 1 among them, or 0.5; labels of null
are ignored, repeated labels count each; rows with equal ids are scored each, equal rows alike; a
very long text's statistics are those of the whole text, in a batch of its own; an empty table
gives no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, stored
from .textops import code_points, shingles, slices, texts_of, words

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "upper", "digit", "space", "mark", "odd_mark", "stop_per_word", "comma_per_word", "other",
    "distinct_words", "top_word", "same_as_before", "repeated_shingles", "repeated_lines", "log_line_words", "line_end_stop", "char_entropy",
)
#: Chosen by four-fold cross-validation on training rows (README), but for the contract's ACCEPT.
SHRINKAGE, POOLING, TEMPERATURE, ACCEPT = 0.05, 0.9, 8.0, 0.7
_UPPER, _DIGIT, _SPACE, _STOP, _COMMA, _ODD, _LETTER = 1, 2, 3, 4, 5, 6, 7


@lru_cache(1)
def _classes() -> np.ndarray:
    kind = np.zeros(0x110000, np.int8)
    for i in range(0x3001):
        c = chr(i)
        kind[i] = _SPACE if c.isspace() else _UPPER if c.isupper() else _DIGIT if c.isdigit() else _LETTER if c.isalpha() else _STOP if c in ".!?" else _COMMA if c in ",;:'\"-()" else _ODD
    return kind


def statistics(texts: list[str]) -> np.ndarray:
    """A row of transformed statistics for each text."""
    n = len(texts)
    cp = code_points("\n".join(texts) + "\n")
    chars = np.fromiter(map(len, texts), np.float64, n)
    at = np.concatenate([[0], np.cumsum(chars + 1)]).astype(np.int64)[:-1]
    kind = _classes()[cp]
    share = {k: np.add.reduceat(kind == k, at, dtype=np.int64) for k in range(8)}
    share[_SPACE] -= 1
    h, o, start, end = words(texts)
    count = np.diff(o).astype(np.float64)
    length = (end - start).astype(np.float64)
    total = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v)])[o])
    some = np.maximum(count, 1)
    mean = total(length) / some
    spread = np.sqrt(np.maximum(total(length**2) / some - mean**2, 0))
    same = np.zeros(len(h))
    same[1:] = h[1:] == h[:-1]
    s, so = shingles(h, o)
    distinct, top, unique, lines, line_end, entropy = (np.zeros(n) for _ in range(6))
    n_lines = np.ones(n)
    for i, t in enumerate(texts):
        _, c = np.unique(h[o[i] : o[i + 1]], return_counts=True)
        distinct[i], top[i] = len(c), c.max(initial=0)
        unique[i] = len(np.unique(s[so[i] : so[i + 1]]))
        own = [x for x in t.split("\n") if x.strip()]
        n_lines[i] = max(1, len(own))
        lines[i] = 1 - len(set(own)) / len(own) if own else 0
        line_end[i] = sum(x.rstrip()[-1] in ".!?\"" for x in own) / n_lines[i]
        x = cp[at[i] : at[i] + int(chars[i])]
        p = np.bincount(np.minimum(x, 0x400)) if len(x) else np.zeros(1)
        p = p[p > 0] / max(1, len(x))
        entropy[i] = -(p * np.log2(p)).sum()
    some_chars, n_shingles = np.maximum(chars, 1), np.maximum(np.diff(so), 1)
    part = lambda v: np.sqrt(np.maximum(v, 0))  # noqa: E731  spreads shares near 0
    odd = share[_ODD]
    out = [
        np.log1p(chars), np.log1p(count), np.log1p(mean), np.log1p(spread), part(share[_UPPER] / some_chars), part(share[_DIGIT] / some_chars), share[_SPACE] / some_chars,
        part((share[_STOP] + share[_COMMA] + odd) / some_chars), part(odd / some_chars), part(share[_STOP] / some), part(share[_COMMA] / some), part(share[0] / some_chars),
        np.log((distinct + 1) / (some + 1)), part(top / some), part(total(same) / some), part(1 - unique / n_shingles), part(lines), np.log1p(count / n_lines), line_end, entropy,
    ]
    return np.column_stack(out)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(texts_of(part))
                at = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))], names=["doc_id", "stats"])

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class Discriminant:
    """Class means, Cholesky factors of inverse use, and log priors; ``constant`` if one class is missing."""

    scale: tuple[np.ndarray, np.ndarray] | None = None
    parts: tuple[tuple[np.ndarray, np.ndarray, float], ...] = ()
    constant: float = 0.5

    @classmethod
    def fit(cls, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE, pooling: float = POOLING) -> Discriminant:
        """``moments``: per class the count, sums and sums of products."""
        seen = {k: m for k, m in moments.items() if m[0] > 0}
        n = sum(m[0] for m in seen.values())
        if len(seen) < 2:
            return cls(constant=float(next(iter(seen))) if seen else 0.5)
        mean = sum(m[1] for m in seen.values()) / n
        spread = np.sqrt(np.maximum(np.diag(sum(m[2] for m in seen.values())) / n - mean**2, 1e-12)) + 1e-6
        cov, mu = {}, {}
        for k, (c, s, q) in seen.items():
            mu[k] = (s / c - mean) / spread
            cov[k] = (q / c - np.outer(s / c, s / c)) / np.outer(spread, spread)
        pooled = sum(seen[k][0] * cov[k] for k in seen) / n
        parts = []
        for k in (0, 1):
            d = len(mean)
            mixed = (1 - pooling) * cov[k] + pooling * pooled
            shrunk = (1 - shrinkage) * mixed + shrinkage * max(np.trace(mixed) / d, 1e-3) * np.eye(d)
            low = np.linalg.cholesky(shrunk)
            parts.append((mu[k], np.linalg.inv(low), float(np.log(seen[k][0] / n) - np.log(np.diag(low)).sum())))
        return cls((mean, spread), tuple(parts))

    def score(self, x: np.ndarray, temperature: float = TEMPERATURE) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.constant)
        z = (x - self.scale[0]) / self.scale[1]
        zero, one = (base - 0.5 * (((z - mu) @ inverse.T) ** 2).sum(1) for mu, inverse, base in self.parts)
        return 1 / (1 + np.exp(-np.clip((one - zero) / temperature, -700, 700)))


def moments(rows: DataFrame, label: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Counts, sums and sums of products of ``stats`` by label; partitions add theirs up first."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = b.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                v = x[y == k]
                acc[k] += np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])
        n = acc.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], n)), pa.array(np.tile(np.arange(n), 2)), pa.array(acc.ravel())], names=["k", "i", "v"])

    rows = rows.select(F.col(label).cast("long").alias("label"), "stats").filter("label in (0, 1)")
    got = rows.mapInArrow(run, "k long, i long, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    acc = np.zeros((2, 1 + d + d * d))
    for r in got:
        acc[r["k"], r["i"]] = r["v"]
    return {k: (acc[k, 0], acc[k, 1 : 1 + d], acc[k, 1 + d :].reshape(d, d)) for k in (0, 1)}


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; labels of held-out rows aren't read."""
    stats = stored(with_statistics(docs), "statistics")
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label).filter(~held_out() & F.col("doc_id").isNotNull())
    model = Discriminant.fit(moments(stats.join(train, "doc_id"), label))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
