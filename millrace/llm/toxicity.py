"""Toxicity by a classifier chain of linear models.

The chain predicts categories one after another; each later model also sees the earlier
categories' probabilities. In training these come from models that did not see the document
(out-of-fold), so a later model learns how far to trust them. Models are logistic, over
the presence of words whose counts depend on the label. A fold's words, facets and models are
chosen without the fold's labels; the last models use all of them.

Where the labels name one toxic flag only, the categories before it are facets: groups of
toxic words that occur together in toxic training documents (a language's words, say). They
say nothing that the flag does not (README compares with one plain model).

The fit uses at most about ``max_train`` labelled documents, chosen by a hash of their id; their ids
are broadcast under that bound. Of their words it keeps ``VOCABULARY`` by fold, and of groups of at
most ``FACET_WORDS`` words ``FACETS``. Scoring covers all documents.

Defined cases: null and empty texts get the score of no words; labels of null are ignored,
repeated ones count each; without labels of both kinds the score is the share of toxic ones,
or 0; words that tell alike are taken in the order of their hashes; rows with equal ids are
scored each, equal rows too; a very long text is scored whole, in a batch of its own; an empty
table gives no rows; other columns, of whatever name, are ignored by ``score_toxicity`` (but
those that it is asked to keep) and kept by ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows, stored
from .textops import U64, slices, texts_of, words

MAX_TRAIN, VOCABULARY, LEAST_GAIN, FACETS, FACET_WORDS, FOLDS, L2, REJECT = 40_000, 2048, 10.0, 4, 256, 3, 0.1, 0.5


class Rows:
    """Sparse binary rows: sorted column numbers one after another, and where rows start."""

    def __init__(self, columns: np.ndarray, offsets: np.ndarray):
        self.columns, self.offsets = columns, offsets
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.columns], len(self.offsets) - 1) if len(self.columns) else np.zeros(len(self.offsets) - 1)

    def transposed_times(self, v: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, v[self.row], width) if len(self.columns) else np.zeros(width)

    def only(self, allowed: np.ndarray) -> Rows:
        """The same rows, with the allowed columns' entries."""
        kept = allowed[self.columns] if len(self.columns) else np.zeros(0, bool)
        return Rows(self.columns[kept], np.concatenate([[0], np.cumsum(kept)])[self.offsets])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_logistic(x: Rows, extra: np.ndarray, y: np.ndarray, rows: np.ndarray, width: int, l2: float = L2, steps: int = 12) -> np.ndarray:
    """Weights of words, extra columns and a constant: Newton steps by conjugate gradients,
    halved while they don't lower the loss."""
    ridge = np.full(width + extra.shape[1] + 1, l2)
    ridge[-1] = 1e-6

    def forward(w: np.ndarray) -> np.ndarray:
        return x.times(w[:width]) + extra @ w[width:-1] + w[-1]

    def backward(v: np.ndarray) -> np.ndarray:
        return np.concatenate([x.transposed_times(v, width), extra.T @ v, [v.sum()]])

    def loss(w: np.ndarray, z: np.ndarray) -> float:
        return float(np.where(rows, np.logaddexp(0, z) - y * z, 0).sum() + 0.5 * (ridge * w * w).sum())

    w = np.zeros(len(ridge))
    z = forward(w)
    now = loss(w, z)
    for _ in range(steps):
        p = _sigmoid(z)
        curve = np.where(rows, p * (1 - p), 0)
        grad = backward(np.where(rows, p - y, 0)) + ridge * w
        move, r = np.zeros(len(w)), -grad
        q, rr = r.copy(), r @ r
        for _ in range(50):
            h = backward(curve * forward(q)) + ridge * q
            t = rr / max(q @ h, 1e-300)
            move, r = move + t * q, r - t * h
            rr, old = r @ r, rr
            if rr <= 1e-4 * (grad @ grad):
                break
            q = r + rr / old * q
        size = 1.0
        while size > 1e-3:
            z_new = forward(w + size * move)
            if (new := loss(w + size * move, z_new)) < now:
                break
            size /= 2
        if size <= 1e-3 or now - new < 1e-5 * abs(now):
            break
        w, z, now = w + size * move, z_new, new
    return w


@dataclass
class Chain:
    vocabulary: np.ndarray
    names: tuple[str, ...] = ()
    weights: list[np.ndarray] = field(default_factory=list)
    constant: float = 0.0
    unseen: np.ndarray | None = None  # the fit's out-of-fold probabilities

    @classmethod
    def fit(cls, vocabulary: np.ndarray, x: Rows, targets: dict[str, np.ndarray], fold: np.ndarray, own: list[tuple[np.ndarray, dict[str, np.ndarray]]], allowed: np.ndarray) -> Chain:
        """``targets`` in the chain's order; ``fold``: a number for each row; ``own``: for each fold
        the words that may be used without it, and the targets as they are known without it;
        ``allowed``: the words of the last models."""
        width, n = len(vocabulary), len(x.offsets) - 1
        seen, out = np.zeros((n, 0)), cls(vocabulary[allowed], tuple(targets))
        whole = x.only(allowed)
        for name, y in targets.items():
            unseen = np.zeros(n)
            for k, (words, known) in enumerate(own):
                view = x.only(words)
                w = fit_logistic(view, seen, known[name], fold != k, width)
                unseen[fold == k] = _sigmoid(view.times(w[:width]) + seen @ w[width:-1] + w[-1])[fold == k]
            w = fit_logistic(whole, seen, y, np.ones(n, bool), width)
            out.weights.append(np.concatenate([w[:width][allowed], w[width:]]))
            seen = np.column_stack([seen, unseen])
        out.unseen = seen
        return out

    def predict(self, x: Rows) -> np.ndarray:
        """A column of probabilities for each category."""
        n, width = len(x.offsets) - 1, len(self.vocabulary)
        seen = np.zeros((n, 0))
        for w in self.weights:
            seen = np.column_stack([seen, _sigmoid(x.times(w[:width]) + seen @ w[width:-1] + w[-1])])
        return seen if self.weights else np.full((n, 1), self.constant)


def present(hashes: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> Rows:
    """Which words of the (sorted) vocabulary each text has."""
    if not len(vocabulary) or not len(hashes):
        return Rows(np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[place] == hashes)
    row = np.searchsorted(offsets, hit, side="right") - 1
    both = np.unique(row * len(vocabulary) + place[hit])
    row, column = both // len(vocabulary), both % len(vocabulary)
    return Rows(column, np.searchsorted(row, np.arange(len(offsets))))


def facets(x: Rows, y: np.ndarray, rows: np.ndarray, width: int, most: int = FACETS, least_rows: int = 5) -> list[np.ndarray]:
    """Groups of telling words that occur together, by the toxic rows (of ``rows``) that have one of
    them."""
    toxic = (y > 0) & rows
    with_word = x.transposed_times(rows.astype(float), width)
    share = x.transposed_times(toxic.astype(float), width) / np.maximum(with_word, 1)
    telling = np.flatnonzero((share >= 0.9) & (with_word >= least_rows))
    telling = telling[np.argsort(-with_word[telling], kind="stable")][:FACET_WORDS]
    spot = np.full(width, -1)
    spot[telling] = np.arange(len(telling))
    own = toxic[x.row] & (spot[x.columns] >= 0)
    m = np.zeros((int(toxic.sum()), len(telling)), np.float32)
    m[(np.cumsum(toxic) - 1)[x.row[own]], spot[x.columns[own]]] = 1
    both = m.T @ m
    linked = both >= 0.1 * np.minimum.outer(np.diag(both), np.diag(both))
    group = np.arange(len(telling))
    for _ in range(len(telling)):
        new = np.array([group[linked[i]].min() if linked[i].any() else group[i] for i in range(len(group))])
        if (new == group).all():
            break
        group = new
    found = {g: int(m[:, group == g].any(1).sum()) for g in np.unique(group)}
    best = sorted((g for g in found if found[g] >= least_rows), key=lambda g: (-found[g], g))[:most]
    return [np.sort(telling[group == g]) for g in best]


def has_any(x: Rows, y: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """Which toxic rows have one of the words."""
    weights = np.zeros(width)
    weights[words] = 1
    return ((x.times(weights) > 0) & (y > 0)).astype(float)


def like(groups: list[np.ndarray], own: list[np.ndarray]) -> list[np.ndarray]:
    """For each of ``groups`` that one of ``own`` with most words in common; empty without any."""
    out = []
    for g in groups:
        shared = [len(np.intersect1d(g, o)) for o in own]
        out.append(own[int(np.argmax(shared))] if max(shared, default=0) else np.zeros(0, np.int64))
    return out


def telling_words(sample: DataFrame, most: int = VOCABULARY, least_gain: float = LEAST_GAIN, folds: int = FOLDS) -> tuple[list[np.ndarray], int, int]:
    """The words with the greatest log-likelihood ratio between the labels, sorted: over all rows
    of ``sample`` (label, fold, words), then without each fold; and the label counts."""
    totals = {(r["label"], r["fold"]): r["n"] for r in sample.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    counted = lambda label, without: sum(n for (y, k), n in totals.items() if y == label and k != without)
    n0, n1 = counted(0, None), counted(1, None)
    settings = [None, *range(folds)]
    if not n0 or not n1:
        return [np.zeros(0, U64)] * len(settings), n0, n1
    each = [c for k in range(folds) for c in (F.sum(F.when(F.col("fold") == k, F.col("label")).otherwise(0)).alias(f"a{k}"), F.count_if(F.col("fold") == k).alias(f"n{k}"))]
    counts = sample.select("label", "fold", F.explode("words").alias("w")).groupBy("w").agg(*each)

    def gain(without: int | None) -> Column:
        n0, n1 = counted(0, without), counted(1, without)
        if not n0 or not n1:
            return F.lit(0.0)
        kept = [k for k in range(folds) if k != without]
        a, n = (sum((F.col(f"{c}{k}") for k in kept), F.lit(0)).cast("double") for c in "an")
        part = lambda k, of, all_k: F.when(k > 0, k * F.log(k / (of * all_k / (n0 + n1)))).otherwise(F.lit(0.0))
        b, rest = n - a, F.lit(float(n0 + n1)) - n
        return 2 * (part(a, n, n1) + part(b, n, n0) + part(F.lit(float(n1)) - a, rest, n1) + part(F.lit(float(n0)) - b, rest, n0))

    names = ["g", *(f"g{k}" for k in range(folds))]
    gains = counts.select("w", *(gain(k).alias(n) for k, n in zip(settings, names, strict=True)))
    gains = stored(gains.filter(F.greatest(*names) >= least_gain), "telling-words")
    top = [gains.filter(F.col(name) >= least_gain).orderBy(F.desc(name), "w").limit(most).select(F.lit(i).alias("i"), "w") for i, name in enumerate(names)]
    got = reduce(DataFrame.unionByName, top).toPandas()
    return [np.sort(got["w"][got["i"] == i].to_numpy(np.int64)).view(U64) for i in range(len(names))], n0, n1


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", categories: tuple[str, ...] = (), max_train: int = MAX_TRAIN, most_facets: int = FACETS) -> Chain:
    """Fits the chain ``categories`` then ``label``; without categories, facets come first."""
    spark = docs.sparkSession
    columns = [*categories, label]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    share = min(1.0, max_train / max(1, known.count()))
    grain = 1 << 40
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < int(share * grain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, o, _, _ = words(texts_of(part))
                own = [np.unique(h[a:b]).view(np.int64) for a, b in zip(o[:-1], o[1:], strict=True)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                flat = np.concatenate(own) if own else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("doc_id", *columns)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["doc_id", *columns, "words"])

    arrow_rows(spark)
    # One text for each id, so that rows of the sample are as bounded as its ids.
    ids = chosen.select("doc_id").distinct()
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = one.join(F.broadcast(chosen.distinct()), "doc_id").select("doc_id", *(F.col(c).cast("long") for c in columns), "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in columns), T.StructField("words", T.ArrayType(T.LongType()))])
    sample = stored(texts.mapInArrow(run, schema).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")), "toxicity-sample")
    chosen_words, n0, n1 = telling_words(sample.select(F.col(label).alias("label"), "fold", "words"))
    if not n0 or not n1:
        return Chain(chosen_words[0], constant=n1 / max(1, n0 + n1))
    vocabulary = np.unique(np.concatenate(chosen_words))
    width = len(vocabulary)
    place = np.dtype("<u2" if width <= 1 << 16 else "<u4")
    kept_schema = T.StructType([sample.schema["doc_id"], *(sample.schema[c] for c in columns), sample.schema["fold"], T.StructField("places", T.BinaryType())])

    def known_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("words")
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            x = present(lists.flatten().to_numpy(zero_copy_only=False).view(U64), at, vocabulary)
            places = [x.columns[a:e].astype(place).tobytes() for a, e in zip(x.offsets[:-1], x.offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("doc_id", *columns, "fold")), pa.array(places, pa.binary())], names=kept_schema.names)

    # A row's words as places in the vocabulary, of two bytes each if it has no more: the driver holds no other copy.
    kept = sample.mapInArrow(known_words, kept_schema).toPandas().sort_values(["doc_id", *columns], kind="stable")
    offsets = np.concatenate([[0], np.cumsum(kept["places"].map(len).to_numpy(np.int64) // place.itemsize)])
    x = Rows(np.frombuffer(b"".join(kept.pop("places")), place).astype(np.int64), offsets)
    y, fold = kept[label].to_numpy(float), kept["fold"].to_numpy(np.int64)
    given = {c: np.nan_to_num(kept[c].to_numpy(float)) for c in categories}
    allowed = [np.isin(vocabulary, words) for words in chosen_words]
    groups = [] if categories else facets(x.only(allowed[0]), y, np.ones(len(y), bool), width, most_facets)
    own = []
    for k in range(FOLDS):
        view = x.only(allowed[1 + k])
        alike = like(groups, facets(view, y, fold != k, width, most_facets)) if groups else []
        own.append((allowed[1 + k], {**given, **{f"facet_{i}": has_any(view, y, g, width) for i, g in enumerate(alike)}, label: y}))
    before = given | {f"facet_{i}": has_any(x, y, g, width) for i, g in enumerate(groups)}
    return Chain.fit(vocabulary, x, {**before, label: y}, fold, own, allowed[0])


def score_toxicity(docs: DataFrame, chain: Chain, reject: float = REJECT, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted and the categories' probabilities of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(chain, unseen=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, o, _, _ = words(texts_of(part))
                p = shared.value.predict(present(h, o, shared.value.vocabulary))
                at = np.arange(len(p) + 1, dtype=np.int32) * (p.shape[1] - 1)
                own = pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(p[:, :-1]).ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(p[:, -1]), own], names=[*names, "__score", "__categories"])

    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), "text", *keep).select("__id", *keep, "text")
    names = ["__id", *keep]
    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField("__score", T.DoubleType()), T.StructField("__categories", T.ArrayType(T.DoubleType()))])
    scored = rows.mapInArrow(run, schema)
    return scored.select(F.col("__id").alias("doc_id"), *keep, F.col("__score").alias("score"), (F.col("__score") >= reject).cast("int").alias("predicted"), F.col("__categories").alias("categories"))


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT, **options) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic."""
    chain = fit_toxicity(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(replace(chain, unseen=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, o, _, _ = words(texts_of(part))
                yield part.filter(pa.array(shared.value.predict(present(h, o, shared.value.vocabulary))[:, -1] < reject))

    arrow_rows(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
