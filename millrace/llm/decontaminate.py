"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may be changed in k = floor(n * error_rate) places. Cut into k + 1
pieces, it keeps at least one of them whole, so the places where a piece occurs are all that could
match. They are found for a batch of documents at once: the hash of each piece's first characters
is looked up in a sorted array, then the hash of the whole piece is compared. Pieces come from
halving, a half taking its share of the budget: where an item matches, some piece's hit also matches
within the budget of each larger part that holds it. So Myers' bit-parallel algorithm
verifies short parts first, and whole items only where all parts around a hit agreed. Hashes only
find places; what counts as a match is a distance.

Item and document are compared in lower case with white space runs as one space; ``start`` and
``end`` of a match are places in that normalised text. Items go through in blocks of bounded
size, of which a Python process keeps the last one (some 20 bytes a character). One block is one pass over the documents. Several are a pass each: a block's matches are
written to the shared folder and its broadcast is freed before the next one is read, so memory
doesn't grow with the items; a document's result doesn't depend on the blocks.

Defined cases: null or empty texts have no matches; items without text match nothing; equal
items match each under their own id; rows with equal doc_ids match each, equal rows too; of
windows with equal distances the first is told; an item of few characters must occur exactly;
a very long text is searched whole, in linear time but for its matches; an empty table gives
no rows; other columns, of whatever name, are ignored by the report and kept by ``drop_leaks``.
"""

from __future__ import annotations

import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, fresh, stored
from .textops import _BASE, _BASE_INV, U64, _power, code_points, mix, slices, texts_of

ERROR_RATE, MIN_PIECE, BLOCK_CHARS = 0.1, 8, 4_000_000
FILTER_BITS, HASH_CHARS = 22, 1 << 20
HITS = "doc_id long, row_hash long, item_id long, distance long, start long, end long"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(n: int, error_rate: float = ERROR_RATE) -> int:
    """Edits that an item of ``n`` characters may have; pieces keep a least length."""
    return max(0, min(int(n * error_rate), n // MIN_PIECE - 1))


def halves(n: int, k: int) -> Iterator[tuple[int, int]]:
    """Bounds of the k + 1 pieces of n characters, in order."""
    todo = [(0, n, k)]
    while todo:
        a, b, k = todo.pop()
        if not k:
            yield a, b
            continue
        middle, left = _halved(a, b, k)
        todo += [(middle, b, k - 1 - left), (a, middle, left)]


def _halved(a: int, b: int, k: int) -> tuple[int, int]:
    """Where a part with k errors is halved, and the errors of its first half."""
    left = (k - 1) // 2
    return a + (b - a) * (left + 1) // (k + 1), left


def parts_around(n: int, k: int, at: int) -> list[tuple[int, int, int]]:
    """Bounds and errors of the parts that hold the piece at ``at``, from the smallest that may have an
    error to halves of the item."""
    out, a, b = [], 0, n
    while k:
        out.append((a, b, k))
        middle, left = _halved(a, b, k)
        a, b, k = (a, middle, left) if at < middle else (middle, b, k - 1 - left)
    return out[:0:-1]


@lru_cache(4096)
def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


def myers(pattern: str, text: str, k: int, masks: dict[str, int] | None = None, any_end: bool = False) -> tuple[int, int] | None:
    """Least edit distance (at most k) of ``pattern`` to a part of ``text``, and that part's end;
    with ``any_end`` the first distance of at most k."""
    masks = masks_of(pattern) if masks is None else masks
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = (m, 0) if m <= k else (k + 1, -1)
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
            if any_end:
                break
    return None if best > k else (best, end)


class Matcher:
    """The pieces of a block of items, by the hash of their first characters."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items: list[tuple[int, str, int]] = []
        rows, heads, wholes, held, size = array("i"), [], [], [], 0  # rows of each piece: item, start, characters
        done = 0
        for n, (item_id, raw) in enumerate(items, 1):
            if text := normal(raw or ""):
                k = budget(len(text), error_rate)
                for a, b in halves(len(text), k):
                    rows.extend((len(self.items), a, b - a))
                self.items.append((item_id, text, k))
                held.append(text)
                size += len(text) + 1
            if held and (size >= HASH_CHARS or n == len(items)):
                cp, base = _joined(held)
                acc, inverse = _prefix_sums(cp)
                own = np.array(rows[done:], np.int64).reshape(-1, 3)
                at = base[own[:, 0] - (len(self.items) - len(held))] + own[:, 1]
                wholes.append(_hashes(acc, inverse, at, own[:, 2]))
                heads.append(_hashes(acc, inverse, at, np.minimum(own[:, 2], MIN_PIECE)))
                done, held, size = len(rows), [], 0
        own = np.array(rows, np.int32).reshape(-1, 3)
        self.item, self.start, self.size = (np.ascontiguousarray(c) for c in own.T)
        self.hash = np.concatenate([np.zeros(0, U64), *wholes])
        head = np.concatenate([np.zeros(0, U64), *heads])
        # Pieces by the characters that are looked up: as many as any piece with errors has, or a short item's all.
        self.grams: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        width = np.minimum(self.size, MIN_PIECE)
        for w in np.unique(width).tolist():
            mine = np.flatnonzero(width == w)
            order = np.argsort(head[mine], kind="stable")
            first, start, count = np.unique(head[mine][order], return_index=True, return_counts=True)
            there = np.zeros(1 << FILTER_BITS, bool)
            there[first >> U64(64 - FILTER_BITS)] = True
            self.grams.append((w, there, first, start, count, mine[order].astype(np.int32)))

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place in it and piece wherever a piece occurs, by text and place."""
        cp, base = _joined(texts)
        acc, inverse = _prefix_sums(cp)
        found = [(np.zeros(0, np.int64),) * 2]
        for w, there, first, start, count, pieces in self.grams:
            if len(cp) < w:
                continue
            h = mix((acc[w:] - acc[:-w]) * inverse[: len(cp) - w + 1])
            at = np.flatnonzero(there[h >> U64(64 - FILTER_BITS)])
            k = np.searchsorted(first, h[at])
            known = first[np.minimum(k, len(first) - 1)] == h[at]
            at, k = at[known], k[known]
            n = count[k]
            piece = pieces[np.repeat(start[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            at = np.repeat(at, n)
            fits = at + self.size[piece] <= len(cp)
            at, piece = at[fits], piece[fits]
            same = _hashes(acc, inverse, at, self.size[piece]) == self.hash[piece]
            found.append((at[same], piece[same]))
        at, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((piece, at))
        at, piece = at[order], piece[order]
        text = np.searchsorted(base, at, side="right") - 1
        return text, at - base[text], piece

    def matches_of(self, raws: list[str]) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
        """``matches`` of those of several texts that have any, with their numbers."""
        texts = [normal(r) for r in raws]
        text, place, piece = self.hits(texts)
        bounds = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]])) if len(text) else np.zeros(1, np.int64)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if own := self._verified(texts[text[a]], place[a:b].tolist(), piece[a:b].tolist()):
                out.append((int(text[a]), own))
        return out

    def matches(self, raw: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each window that an item matches, in the
        normalised text; windows of one item that overlap are one."""
        found = self.matches_of([raw])
        return found[0][1] if found else []

    def _verified(self, text: str, places: list[int], pieces: list[int]) -> list[tuple[int, int, int, int]]:
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for first, piece in zip(places, pieces, strict=True):
            i, at = int(self.item[piece]), int(self.start[piece])
            _, item, k = self.items[i]
            x = first - at
            if not all(myers(item[a:b], text[max(0, x + a - e) : max(0, x + b + e)], e, None, True) for a, b, e in parts_around(len(item), k, at)):
                continue
            a, b = max(0, x - k), min(len(text), x + len(item) + k)
            if windows[i] and a <= windows[i][-1][1]:
                windows[i][-1][1] = max(b, windows[i][-1][1])
                windows[i][-1][0] = min(a, windows[i][-1][0])
            else:
                windows[i].append([a, b])
        out = []
        for i, own in windows.items():
            item_id, item, k = self.items[i]
            for a, b in own:
                if got := myers(item, text[a:b], k):
                    back = myers(item[::-1], text[a : a + got[1]][::-1], got[0])
                    out.append((item_id, got[0], a + got[1] - back[1], a + got[1]))
        return out


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a line break after each (normalised texts have none), and where they start."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return code_points("\n".join([*texts, ""])), np.cumsum(size) - size


def _prefix_sums(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    acc = np.zeros(len(cp) + 1, U64)
    np.cumsum((cp.astype(U64) + U64(1)) * _power(_BASE, len(cp)), out=acc[1:])
    return acc, _power(_BASE_INV, max(1, len(cp)))


def _hashes(acc: np.ndarray, inverse: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the characters from ``at`` on."""
    return mix((acc[at + size] - acc[at]) * inverse[at])


_last: list = [None, None]


def _matcher(key: int, items: list[tuple[int, str]], error_rate: float) -> Matcher:
    """The matcher of a block; a process keeps the last one, which its next tasks use."""
    if _last[0] != (key, error_rate):
        _last[:] = [None, None]  # let go of the one before first
        _last[:] = [(key, error_rate), Matcher(items, error_rate)]
    return _last[1]


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``most`` characters; the driver holds one at a time."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), "text").orderBy("item_id").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each place of a document that matches a test item."""
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_hash"), "text")

    def hits(block: list[tuple[int, str]]) -> tuple[DataFrame, Broadcast]:
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().int

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, shared.value, error_rate)
            for batch in batches:
                for part in slices(batch, "text"):
                    ids, hashes = part.column("doc_id"), part.column("row_hash")
                    found = [(ids[i].as_py(), hashes[i].as_py(), *m) for i, own in matcher.matches_of(texts_of(part)) for m in own]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "row_hash", "item_id", "distance", "start", "end"])

        return rows.mapInArrow(run, HITS), shared

    blocks = _blocks(items, block_chars)
    block, first = next(blocks, []), True
    out = spark.createDataFrame([], HITS)
    while block:
        (found, shared), following = hits(block), next(blocks, [])
        if first and not following:
            return found
        out, first = out.unionByName(stored(found, "leaks")), False
        shared.destroy()
        block = following
    return out


def leak_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, distance (least), n_places, start and end of each leaked pair."""
    best = F.min(F.struct("distance", "start", "end")).alias("b")
    return find_leaks(docs, items, **options).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_places"), best).select("doc_id", "item_id", "n_places", "b.distance", "b.start", "b.end")


def drop_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that match no test item."""
    i, h, j = fresh(docs, "__id", "__hash", "__own_hash")
    hit = find_leaks(docs, items, **options).select(F.col("doc_id").alias(i), F.col("row_hash").alias(h)).distinct()
    return docs.withColumn(j, F.xxhash64("text")).join(hit, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(j) == F.col(h)), "left_anti").select(*docs.columns)
