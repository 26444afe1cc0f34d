"""N-gram Jaccard self-join: a MinHash LSH forest, then exact verification.

1. Signatures: a document's set of five-word shingles gives ``trees * depth`` MinHash values
   of 16 bits: a label of ``depth`` values in each tree. Documents with equal shingle sets are
   one class representative with a count from here on.
2. Tries: each tree's labels are dealt out by prefix and sorted, so the labels below a trie's node
   lie next to each other. A search at some depth pairs the sets below each node there.
3. Shortening: the first search is at the full depth. From the agreement of the pairs found, and
   the chance that a pair of such an agreement meets at that depth, follows how many pairs there
   are, and what share of them each shorter prefix would find. Prefixes are shortened, the search
   is repeated, until the share found reaches the target recall; they are never shorter than
   where a pair at the threshold itself meets with that chance.
4. Candidates: below a node, signatures that agree on clearly less than the threshold
   are no candidates (the margin is six standard deviations). Nodes are dealt out in blocks
   of bounded size; a block returns a spanning forest of its candidate pairs, never the pairs.
5. Verification: candidate components are dealt out in blocks bounded by shingles, each pair
   of chunks one block. A block computes the exact Jaccard similarity of all its pairs by an
   incidence product, and returns each representative's number of links and a spanning forest
   of the links. Classes are the components of those.

So no link between different texts is lost once its component is found, rows stay linear in
documents times chunks, and the work within one group of different near copies is quadratic
in arithmetic only (README).

Defined cases: a null text is empty; texts without words are copies of each other; a text of
one to four words has one shingle of all its words; rows with equal ids are separate rows, and
so are equal rows; of rows that tie for a class's place the least text hash counts; very long
texts are compared whole, one that has a block's shingles is a chunk of its own; an empty table
gives no rows; other columns, of whatever name, are ignored and ``deduplicate`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch, arrow_rows, fresh, join_skewed, stored
from .textops import U64, shingles, slices, texts_of, words

THRESHOLD, TARGET_RECALL, TREES, DEPTH = 0.8, 0.9995, 20, 8
MARGIN, SIG_BLOCK, BLOCK_SHINGLES = 0.2, 2048, 1_000_000


def chance(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """That two sets share a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix that finds a pair at the threshold itself with the target's chance."""
    while depth > 1 and chance(threshold, depth, trees) < target:
        depth -= 1
    return depth


def expected_recall(found: dict[int, int], searched: int, depth: int, threshold: float, trees: int, full_depth: int) -> float | None:
    """The share of all pairs at the threshold or above that a search at ``depth`` finds, judged by
    the pairs found at ``searched`` (how many agree in how many values): each stands for as
    many as its chance of being found says. None where none was found."""
    agree = np.array([a for a in sorted(found) if a >= threshold * trees * full_depth], float)
    if not len(agree):
        return None
    similarity = agree / (trees * full_depth)
    there = np.array([found[int(a)] for a in agree], float) / chance(similarity, searched, trees)
    return float((there * chance(similarity, depth, trees)).sum() / there.sum())


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a, b = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
    return a * U64(2) + U64(1), b


def signatures(docs: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, row_hash, set_id (digest of the shingle set), shingles, sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _permutations(trees * depth)
        for batch in batches:
            for part in slices(batch, "text"):
                h, at, _, _ = words(texts_of(part))
                s, at = shingles(h, at)
                n = len(at) - 1
                sets = [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                size = np.fromiter(map(len, sets), np.int64, n)
                ids = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                sig = np.zeros((n, len(mul)), np.uint16)
                full = np.flatnonzero(size)
                if len(full):
                    flat, starts = np.concatenate(sets), (np.cumsum(size) - size)[full]
                    value = np.empty_like(flat)
                    for k in range(len(mul)):
                        np.multiply(flat, mul[k], out=value)
                        value += add[k]
                        value >>= U64(32)
                        low = np.minimum.reduceat(value, starts)
                        sig[full, k] = (low * U64(0x9E3779B97F4A7C15)) >> U64(48)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row_hash"), pa.array(ids, pa.binary()), pa.array(size), pa.array([r.tobytes() for r in sig], pa.binary())],
                    names=["doc_id", "row_hash", "set_id", "shingles", "sig"],
                )

    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("row_hash"))
    return rows.mapInArrow(run, "doc_id long, row_hash long, set_id binary, shingles long, sig binary")


class _Forest:
    """Union-find over a block's rows."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = self.root(i), self.root(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.edges.append((i, j))


def _chunked(df: DataFrame, key: str, chunks) -> DataFrame:
    """Deals the rows of a key to its chunks, and each chunk to the blocks that pair it."""
    pairs = F.expr("transform(sequence(0, chunks - 1), k -> struct(least(k, chunk) as ci, greatest(k, chunk) as cj))")
    return df.withColumn("chunks", chunks.cast("int")).withColumn("chunk", F.expr("cast(pmod(xxhash64(set_id), chunks) as int)")).withColumn("pair", F.explode(pairs)).select("*", "pair.ci", "pair.cj").drop("pair", "chunks")


def search_forest(reps: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL, scratch: Scratch | None = None) -> tuple[DataFrame, int, float | None]:
    """Candidate pairs as a spanning forest (a, b, agree), the depth of the search that found them,
    and the recall that its pairs tell. Starts at the full depth and shortens until the target."""
    floor, at, scratch = least_depth(threshold, trees, depth, target), depth, scratch or Scratch(reps.sparkSession)
    while True:
        near = scratch.stored(_candidates(reps, at, trees, depth, threshold), "candidates")
        found = {r["agree"]: r["n"] for r in near.groupBy("agree").agg(F.count("*").alias("n")).collect()}
        recall = lambda d: expected_recall(found, at, d, threshold, trees, depth)  # noqa: B023, E731
        if at == floor or (recall(at) or 0) >= target:
            return near, at, recall(at)
        at = next((d for d in range(at - 1, floor, -1) if (recall(d) or 0) >= target), floor)


def _candidates(reps: DataFrame, depth: int, trees: int, full_depth: int, threshold: float) -> DataFrame:
    """A spanning forest (a, b, agree) of candidate pairs below the nodes at ``depth`` of each trie."""
    labels = F.expr(f"transform(sequence(0, {trees - 1}), t -> struct(t, substring(sig, 1 + t * {2 * full_depth}, {2 * depth}) as prefix))")
    keyed = reps.select("set_id", F.explode(labels).alias("k")).select("set_id", F.col("k.t").alias("tree"), F.xxhash64("k").alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = keyed.join(groups, "key")
    blocks = _chunked(rows, "key", F.expr(f"ceil(n / {SIG_BLOCK})")).drop("n").join(reps.select("set_id", "sig"), "set_id")
    blocks = blocks.withColumn("label", F.expr(f"substring(sig, 1 + tree * {2 * full_depth}, {2 * full_depth})"))
    least = int(np.ceil((threshold - MARGIN) * trees * full_depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def forest(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            """Edges of all groups but the last one, which may go on; or of that, too."""
            key, ci, cj, chunk = (table.column(n).to_numpy() for n in ("key", "ci", "cj", "chunk"))
            new = np.flatnonzero((key[1:] != key[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])) + 1
            start = np.concatenate([[0], new])
            end = np.append(new, len(key))
            if not last:
                start, end = start[:-1], end[:-1]
            done = int(end[-1]) if len(end) else 0
            if not done:
                return None, table
            whole = table.slice(0, done).combine_chunks()
            sig = np.frombuffer(b"".join(whole.column("sig").to_pylist()), np.uint16).reshape(done, -1)
            two = start[end - start == 2]
            agree = (sig[two] == sig[two + 1]).sum(1)
            near = (agree >= least) & ((ci[two] == cj[two]) | (chunk[two] != chunk[two + 1]))
            edges = list(zip(two[near].tolist(), (two[near] + 1).tolist(), agree[near].tolist(), strict=True))
            for x, y in zip(start[end - start > 2].tolist(), end[end - start > 2].tolist(), strict=True):
                edges += [(x + i, x + j, n) for i, j, n in _spanning(sig[x:y], chunk[x:y] == ci[x], ci[x] == cj[x], least)]
            ids = whole.column("set_id").to_pylist()
            out = pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i, _, _ in edges], pa.binary()), pa.array([ids[j] for _, j, _ in edges], pa.binary()), pa.array([n for _, _, n in edges], pa.int32())], names=["a", "b", "agree"]
            )
            return out, table.slice(done)

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= 4 * SIG_BLOCK:
                out, rest = forest(pa.Table.from_batches(held), False)
                held, rows = rest.to_batches(), rest.num_rows
                if out is not None:
                    yield out
        if rows:
            yield forest(pa.Table.from_batches(held), True)[0]

    arrow_rows(reps.sparkSession, SIG_BLOCK)
    dealt = blocks.repartition("key", "ci", "cj").sortWithinPartitions("key", "ci", "cj", "label").select("key", "ci", "cj", "chunk", "set_id", "sig")
    return dealt.mapInArrow(run, "a binary, b binary, agree int")


def _spanning(sig: np.ndarray, side: np.ndarray, same: bool, least: int) -> list[tuple[int, int, int]]:
    """A spanning forest of the rows that agree in ``least`` values (and in how many), across sides
    unless ``same``. Rows come sorted, so those that share longer prefixes are met first."""
    left, edges = np.ones(len(sig), bool), []
    for seed in range(len(sig)):
        if not left[seed]:
            continue
        left[seed], queue = False, [seed]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(left if same else left & (side != side[i]))
            agree = (sig[rest] == sig[i]).sum(1)
            near = rest[agree >= least]
            edges += zip([i] * len(near), near.tolist(), agree[agree >= least].tolist(), strict=True)
            left[near] = False
            queue += near.tolist()
    return edges


def exact_links(texts: list[str], copies: np.ndarray, side: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of a block's texts: rows that each links to (copies counted), and a forest of links.
    ``side``: rows of the first chunk; pairs lie across, or anywhere if ``same``."""
    flat, at = [], [0]
    for a in range(0, len(texts), 256):
        s, o = shingles(*words(texts[a : a + 256])[:2])
        own = [np.unique(s[x:y]) for x, y in zip(o[:-1], o[1:], strict=True)]
        flat += own
        at += [len(x) for x in own]
    size = np.array(at[1:], np.int64)
    _, column, count = np.unique(np.concatenate(flat), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(texts)), size)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    left = np.arange(len(texts)) if same else np.flatnonzero(side)
    right = left if same else np.flatnonzero(~side)
    links, forest = np.zeros(len(texts), np.int64), _Forest(len(texts))
    place = np.full(len(texts), -1)
    place[right] = np.arange(len(right))
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    width = 2048
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
    for a in range(0, len(left), 512):
        own = left[a : a + 512]
        spot = np.full(len(texts), -1)
        spot[own] = np.arange(len(own))
        inter = np.zeros((len(own), len(right)), np.float32)
        for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            r, c = row[x:y], column[x:y] - k * width
            mine, other = spot[r] >= 0, place[r] >= 0
            used = np.unique(c[mine])
            if not len(used):
                continue
            slot = np.full(width, -1)
            slot[used] = np.arange(len(used))
            other &= slot[c] >= 0
            p, q = np.zeros((len(own), len(used)), np.float32), np.zeros((len(right), len(used)), np.float32)
            p[spot[r[mine]], slot[c[mine]]] = 1
            q[place[r[other]], slot[c[other]]] = 1
            inter += p @ q.T
        union = size[own][:, None] + size[right][None, :] - inter
        hit = inter >= threshold * union - 1e-6
        if same:
            hit[np.arange(len(own)), place[own]] = False
        links[own] += hit @ copies[right]
        if not same:
            links[right] += copies[own] @ hit
        for i in range(len(own)):
            forest.join(int(own[i]), right[np.flatnonzero(hit[i])])
    return links, forest.edges


def ngram_classes(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, row_hash, class_key, class_id (least doc_id of the class), n_links, class_size of every
    row. Classes are told apart by class_key: rows with equal doc_ids may lie in different ones.

    ``n_links`` counts the other rows whose shingle sets have at least the threshold's Jaccard
    similarity with this row's; ``row_hash`` is xxhash64 of the text.
    """
    sigs = stored(signatures(docs, trees, depth), "signatures")
    reps = sigs.groupBy("set_id").agg(F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("shingles").alias("shingles"), F.min_by(F.struct("doc_id", "row_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")).alias("at"))
    scratch = Scratch(docs.sparkSession)
    reps = scratch.stored(reps, "representatives")
    full = reps.filter("shingles > 0")
    near, _, _ = search_forest(full, threshold, trees, depth, target_recall, scratch)
    arrow_rows(docs.sparkSession)
    groups = connected_components(near, scratch).withColumnsRenamed({"node": "set_id", "root": "group"})
    members = scratch.stored(groups.join(reps, "set_id").select("set_id", "group", "copies", "shingles", "at"), "members")
    n_members = members.count()
    total = scratch.stored(members.groupBy("group").agg(F.sum("shingles").alias("n"), F.count("*").alias("m")), "groups")
    dealt = _chunked(join_skewed(members, total, "group", "m", n_members), "group", F.expr(f"least(m, ceil(n / {BLOCK_SHINGLES}))"))
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_hash"), F.coalesce("text", F.lit("")).alias("text"))
    own = members.select("set_id", F.col("at.doc_id").alias("doc_id"), F.col("at.row_hash").alias("row_hash"))
    # Always by a shuffle of both: a broadcast at small sizes only would hide what large ones move.
    fetched = texts.alias("t").join(own.hint("merge").alias("o"), F.expr("t.doc_id <=> o.doc_id and t.row_hash = o.row_hash")).select("set_id", "text").dropDuplicates(["set_id"])

    def verify(g: pd.DataFrame) -> pd.DataFrame:
        side = (g["chunk"] == g["ci"].iloc[0]).to_numpy()
        links, edges = exact_links(g["text"].tolist(), g["copies"].to_numpy(np.int64), side, g["ci"].iloc[0] == g["cj"].iloc[0], threshold)
        ids = g["set_id"].to_numpy()
        out = [(ids[i], None, int(links[i])) for i in np.flatnonzero(links)] + [(ids[i], ids[j], 0) for i, j in edges]
        return pd.DataFrame(out, columns=["a", "b", "links"])

    blocks = dealt.select("group", "ci", "cj", "chunk", "set_id", "copies").join(fetched, "set_id")
    found = scratch.stored(blocks.groupBy("group", "ci", "cj").applyInPandas(verify, "a binary, b binary, links long"), "links")
    classes = connected_components(found.filter("b is not null").select("a", "b"), scratch)
    links = found.filter("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("links"))
    n_rows, n_sets = reps.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    ids = (
        reps.select("set_id", "copies", F.col("at.doc_id").alias("least"))
        .join(classes.withColumnRenamed("node", "set_id"), "set_id", "left")
        .join(links, "set_id", "left")
        .select("set_id", "copies", "least", F.coalesce("root", "set_id").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    ids = scratch.stored(ids, "sets")
    named = ids.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("sets"))
    named = scratch.stored(named, "names")
    per_set = join_skewed(ids, named, "root", "sets", n_sets).selectExpr("set_id", "copies", "root as class_key", "class_id", "class_size", "links + copies - 1 as n_links")
    per_set = stored(per_set, "classes")
    scratch.clear()
    return join_skewed(sigs.select("doc_id", "row_hash", "set_id"), per_set, "set_id", "copies", n_rows).select("doc_id", "row_hash", "class_key", "class_id", "n_links", "class_size")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One row of each class: the one with the least doc_id, then the least text hash."""
    least = F.min(F.struct(F.col("doc_id").isNotNull().cast("int"), "doc_id", "row_hash")).alias("k")
    i, h, j = fresh(docs, "__id", "__hash", "__own_hash")
    kept = ngram_classes(docs, **options).groupBy("class_key").agg(least).select(F.col("k.doc_id").alias(i), F.col("k.row_hash").alias(h))
    joined = docs.withColumn(j, F.xxhash64("text")).join(kept, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(j) == F.col(h)))
    return joined.dropDuplicates([i, h]).select(*docs.columns)
