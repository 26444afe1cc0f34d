"""Near copies by SimHash: fingerprints that differ in few bits, found by pigeonring filtering.

A text's fingerprint takes a bit by majority of the XXH64 hashes of its three-word shingles.
Fingerprints are cut into a ring of segments. If two differ in at most ``most`` bits, some chain of
consecutive segments around the ring keeps within its share of them from its start on: its first
l segments differ in at most l * most / segments bits, for each l. So

1. the segments at the start of a chain whose share is below one bit are equal: they are the key
   that candidates meet by, once for each place where a chain may start;
2. within a key, the chain is carried on segment by segment, and candidates that go beyond its
   share leave; the whole ring is the Hamming check;
3. a key's links are given as a tree, so their number stays below that of its fingerprints.

Keys are found among different fingerprints, so copies cost nothing, and keys with one fingerprint
are left out. A key that more than ``KEY_MOST`` fingerprints share (a cluster of near copies) isn't
compared pair by pair: its fingerprints meet at the points that one changed bit leads to. Two within
two bits have such a point in common, and points in common prove two bits, so this is exact, with 65
rows a fingerprint however large the cluster. Four bits take two changed ones, and so on.

Defined cases: a null text is empty; texts without words have fingerprint zero and link like any
other; texts of one or two words have one shingle, of all of them; rows with equal doc_ids are rows
of their own; a component in which all ids are null has a null id; very long texts are hashed in
blocks; an empty table gives no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch, arrow_rows, fresh, join_salted, join_skewed, stored
from .textops import U64, slices

SHINGLE, SEED, MOST, SEGMENTS = 3, 42, 2, 7
#: Fingerprints of a key beyond which they meet at changed bits instead of pair by pair.
KEY_MOST = 64
HASH_BLOCK = 1 << 18


def shingle_hashes(data: bytes, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, in blocks."""
    words = data.lower().split()  # of bytes: A-Z, and the six white space characters of ASCII
    if not words:
        return
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n]
    end = end[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, HASH_BLOCK):
        b = min(n, a + HASH_BLOCK)
        yield np.fromiter((digest(joined[x:y], SEED) for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)), U64, b - a)


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """A fingerprint each: bits that are set in over half of a text's hashes."""
    out = np.zeros(len(texts), U64)
    for i, data in enumerate(texts):
        ones, n = np.zeros(64, np.int64), 0
        for h in shingle_hashes(data):
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
        out[i] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint's bits as a long) of each row."""
    arrow_rows(docs.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "data"):
                fp = fingerprints_of(pc.fill_null(part.column("data"), b"").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data")).mapInArrow(run, "doc_id long, fp long")


def ring(segments: int = SEGMENTS) -> list[int]:
    """Masks of the segments of 64 bits, whose widths differ by one at most."""
    bounds = [64 * i // segments for i in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]


def chains(most: int = MOST, segments: int = SEGMENTS) -> list[list[tuple[int, int]]]:
    """For each start, masks of its chains and the bits that they may differ in: first the longest
    chain that has to be equal, then one segment more each, to the whole ring."""
    masks, equal = ring(segments), -(-segments // most) - 1 if most else segments
    if not equal:
        raise ValueError("there must be more segments than bits that may differ")
    out = []
    for start in range(segments if most else 1):
        turn = [masks[(start + k) % segments] for k in range(segments)]
        out.append([(sum(turn[:n]), n * most // segments) for n in range(equal, segments + 1)])
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n nodes, the least one that it reaches by the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(fp: np.ndarray, size: np.ndarray, start: np.ndarray, most: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of fingerprints that lie one after another, as a tree for each component.
    ``size`` and ``start``: each group's fingerprints and the segment that its chain starts at."""
    group, told, n = np.repeat(np.arange(len(size)), size), chains(most, segments), len(fp)
    masks = np.array([[m for m, _ in c] for c in told], U64)
    budgets = [b for _, b in told[0]]
    found = []
    for apart in range(1, int(size.max(initial=1))):
        a = np.flatnonzero(group[apart:] == group[:-apart])
        b = a + apart
        differ, own = fp[a] ^ fp[b], masks[start[group[a]]]
        for k, budget in enumerate(budgets):
            near = np.bitwise_count(differ & own[:, k]) <= budget
            a, b, differ, own = a[near], b[near], differ[near], own[near]
        found.append((a, b))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    root = _roots(n, a, b)
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def _points(fp: Column, most: int) -> Column:
    """The points that at most half of ``most`` changed bits lead to."""
    changes = [_signed(sum(1 << i for i in own)) for k in range(most // 2 + 1) for own in combinations(range(64), k)]
    return F.transform(F.array(*map(F.lit, changes)), lambda c: fp.bitwiseXOR(c))


def links(fps: DataFrame, most: int = MOST, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b) between different fingerprints (column ``fp``) that connect all that differ in at most ``most`` bits."""
    if most % 2:  # points in common prove an even number of bits
        raise ValueError("the number of bits must be even")
    keys = F.array(*(F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(c[0][0])).cast("long")).alias("bits")) for s, c in enumerate(chains(most, segments))))
    rows = fps.select("fp", F.explode(keys).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(join_salted(rows, sizes, "key", "fp"), "simhash-keys")
    few = met.filter(F.col("n") <= KEY_MOST).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, start = b.column("own"), b.column("start").to_numpy()
            fp = own.flatten().to_numpy().view(U64)
            x, y = linked(fp, np.diff(own.offsets.to_numpy()), start, most, segments)
            yield pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)), pa.array(fp[y].view(np.int64))], names=["a", "b"])

    near = few.select("own", "key.start").mapInArrow(run, "a long, b long")
    # A point's fingerprints are those within its changed bits, so a list has a bounded number of them.
    crowd = met.filter(F.col("n") > KEY_MOST).select("fp").distinct()
    points = crowd.select("fp", F.explode(_points(F.col("fp"), most)).alias("point"))
    meet = points.groupBy("point").agg(F.collect_list("fp").alias("own")).filter("size(own) > 1")
    far = meet.select(F.array_min("own").alias("b"), F.explode("own").alias("a")).filter("a != b").select("a", "b").distinct()
    return near.unionByName(far)


def components(docs: DataFrame, most: int = MOST, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fingerprint, component_id (the least id that is reachable) and component_size (its rows) of each row."""
    spark = docs.sparkSession
    own = stored(fingerprints(docs), "fingerprints")
    fps = stored(own.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "simhash-texts")
    scratch = Scratch(spark)
    found = connected_components(links(fps.select("fp"), most, segments), scratch, "simhash-components")
    rooted = scratch.stored(fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    whole = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"))
    told = stored(join_salted(rooted, whole, "root", "fp").select("fp", "n", "component_id", "component_size"), "simhash-told")
    scratch.clear()
    return join_skewed(own, told, "fp", "n", own.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def deduplicate(docs: DataFrame, most: int = MOST, segments: int = SEGMENTS) -> DataFrame:
    """``docs`` with, of each component, the rows of its least id only."""
    (own,) = fresh(docs, "__kept")
    kept = components(docs.select("doc_id", "text"), most, segments).filter("doc_id <=> component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left_semi")
