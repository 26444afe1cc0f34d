"""Suffix-array deduplication of repeated byte strings, across all documents.

The suffix array is built by linear grouping: suffixes are grouped by their Lyndon prefix,
groups are processed in descending order with pointers to the previous smaller suffix, and a
second pass emits each group's order; nothing is renamed or recursed into.

Distribution. Every window of ``length`` bytes has an anchor: its leftmost 50-byte string of
least hash. Consecutive windows with one anchor are a run; equal windows have equal anchors,
at equal places in them, so only runs with equal anchor hashes can share a window.

1. A map task finds its runs; of runs with equal contents it sends on the first only, and the
   others are repeats at once. So a string that is in most documents costs one row a task.
2. Runs are dealt out by anchor, sorted, and read as a stream. Again all but the first of equal
   contents are repeats. First runs of anchors with several contents go on.
3. Their bytes are fetched and dealt out by anchor; windows that no other content can share are
   cut off, and a suffix array over what is left puts equal windows next to each other.
4. The repeats of each document are united, and the rest of its bytes is kept.

Hot anchors (a phrase that many documents hold, each with other neighbours) are split. A bounded
sample of documents names those that would fill a task of step 2; their runs are dealt out by
content there. Step 2 marks them, and all others with over ``HOT_CONTENTS`` contents. Before step
3 a marked run is cut into runs of at most two windows, and the ``length - 1`` bytes that both
windows share are the new anchor: its contents differ in a byte before and a byte after, so
there are less than 2**17 of them, whatever the table. The sample decides where rows go, never
what is equal.

Steps 1 and 2 compare runs by a BLAKE2 digest of their bytes (128 bits) and their length; step 3
compares bytes. The hashes that choose anchors only decide where rows go.

Defined cases: null texts are empty; rows with equal doc_id and text are one document and get
equal results; other rows with equal doc_ids are ordered by their text's hash; null ids come
first; documents shorter than ``length`` keep all bytes; very long texts are cut into runs
like others, in one task; an empty table gives no rows; other columns, of whatever name, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, stored
from .textops import _BASE, _BASE_INV, U64, _power, mix, slices

LENGTH, ANCHOR = 100, 50
SEND_ROWS, ARRAY_BYTES = 500_000, 250_000
#: Contents of an anchor beyond which it is split; sampled documents, and the contents of an
#: anchor in them that make it hot; anchors named hot at most.
HOT_CONTENTS, SAMPLE_DOCS, SAMPLE_CONTENTS, MOST_HOT = 20_000, 8_000, 40, 16_384
RUN = "kind int, anchor long, content long, content2 long, doc_id long, row_hash long, start long, n long"
NAMES = ["kind", "anchor", "content", "content2", "doc_id", "row_hash", "start", "n"]
REPEAT, ONE, HOT = 0, 1, 2  # kinds of runs: known repeats, first of its content, that of a hot anchor
NULL_ID = -(1 << 63)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of non-negative integers, by linear grouping construction."""
    n = len(text) + 1
    s = np.empty(n, np.int64)
    s[:-1] = text
    s[:-1] += 1
    s[-1] = 0
    order = np.argsort(s, kind="stable")
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    new = np.concatenate([[True], np.diff(s[order]) != 0])
    first = np.flatnonzero(new)
    group_np = np.empty(n, np.int64)
    group_np[order] = np.repeat(first, np.diff(np.append(first, n)))
    sizes = np.zeros(n, np.int64)
    sizes[first] = np.diff(np.append(first, n))
    sa, place, group, size = order.tolist(), inverse.tolist(), group_np.tolist(), sizes.tolist()
    previous = [-1] * n
    end = n
    while end > 1:
        last = sa[end - 1]
        start = group[last]
        count: dict[int, int] = {}
        if end - start == 1:
            p = last - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[last] = p
            if p >= 0:
                g = group[p]
                if size[g] > 1:
                    # One suffix moves to the end of its group and is a group of its own.
                    back = g + size[g] - 1
                    q, at = sa[back], place[p]
                    sa[at], place[q], sa[back], place[p] = q, at, p, back
                    group[p] = back
                    size[back] = 1
                    size[g] -= 1
            end = start
            continue
        for i in sorted(sa[start:end]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        parents: dict[int, list] = {}
        for p, c in count.items():
            parents.setdefault(group[p], []).append((c, p))
        for g, own in parents.items():
            back = g + size[g]
            own.sort(reverse=True)
            k, total = 0, len(own)
            if total == size[g] and own[0][0] == own[-1][0]:
                continue
            while k < total:
                c, j = own[k][0], k
                while j < total and own[j][0] == c:
                    p = own[j][1]
                    back -= 1
                    q, at = sa[back], place[p]
                    sa[at], place[q], sa[back], place[p] = q, at, p, back
                    j += 1
                for i in range(k, j):
                    group[own[i][1]] = back
                size[back] = j - k
                k = j
            if back > g:
                size[g] = back - g
        end = start
    # Second pass: each emitted suffix emits the not yet emitted ones that it ends.
    out, slot, done = [0] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not done[p]:
            done[p] = 1
            g = group[p]
            out[slot[g]] = p
            slot[g] += 1
            p = previous[p]
    return np.array(out[1:], np.int64)


def digests_of(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two longs (a row) that tell the bytes of each part of ``data`` from all others."""
    parts = memoryview(data)
    found = b"".join([blake2b(parts[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)])
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def runs(datas: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one anchor: document, first window, number of windows, the
    hash of its anchor and the digest of all its bytes."""
    joined = b"".join(datas)
    text = np.frombuffer(joined, np.uint8)
    n, spread = len(text), length - anchor + 1
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, U64), np.zeros((0, 2), np.int64))
    size = np.fromiter(map(len, datas), np.int64, len(datas))
    ends = np.cumsum(size)
    acc = np.zeros(n + 1, U64)
    np.cumsum((text.astype(U64) + U64(1)) * _power(_BASE, n), out=acc[1:])
    inverse = _power(_BASE_INV, n)
    h = mix((acc[anchor:] - acc[:-anchor]) * inverse[: n - anchor + 1])
    low = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    step = 1
    while 2 * step <= spread:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    windows = n - length + 1
    low = np.minimum(low[:windows], low[spread - step : spread - step + windows])
    out = np.zeros(n + 1, np.int32)
    np.add.at(out, np.maximum(ends - length + 1, ends - size), 1)
    np.add.at(out, ends, -1)
    inside = np.flatnonzero(np.cumsum(out)[:windows] == 0)
    at = (low[inside] & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    start, count = inside[first], np.diff(np.append(first, len(at)))
    doc = np.searchsorted(ends, start, side="right")
    return doc, start - (ends - size)[doc], count, h[at[first]], digests_of(joined, start, count + length - 1)


def _later(*keys: np.ndarray) -> np.ndarray:
    """Which sorted rows differ from the row before in any of the keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _split_repeats(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows by content and place, which of them are the first of their content, and
    which are repeats (a second copy of one and the same row is neither)."""
    order = np.lexsort((c["start"], c["row_hash"], c["doc_id"], c["content2"], c["content"]))
    o = {k: v[order] for k, v in c.items()}
    first = _later(o["content"], o["content2"], o["anchor"], o["n"])
    head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(order) else np.zeros(0, np.int64)
    same = (o["doc_id"] == o["doc_id"][head]) & (o["row_hash"] == o["row_hash"][head]) & (o["start"] == o["start"][head])
    return order, first, ~first & ~same


def _merged(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Runs of a document that follow each other as one."""
    order = np.lexsort((c["start"], c["row_hash"], c["doc_id"]))
    o = {k: v[order] for k, v in c.items()}
    end = o["start"] + o["n"]
    new = _later(o["doc_id"], o["row_hash"])
    new[1:] |= o["start"][1:] > end[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(end)) - 1 if len(head) else head
    return {k: v[head] for k, v in o.items()} | {"n": end[last] - o["start"][head]}


def _batch(c: dict[str, np.ndarray], kind: int | np.ndarray, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Runs as batches; repeats, which nothing is compared with, go without their digests."""
    n = len(c["start"])
    if np.isscalar(kind) and kind == REPEAT:
        c = {**c, "content": (none := np.zeros(n, np.int64)), "content2": none}
    kinds = np.full(n, kind, np.int32) if np.isscalar(kind) else kind.astype(np.int32)
    for a in range(0, n, most):
        m = min(most, n - a)
        yield pa.RecordBatch.from_arrays([pa.array(kinds[a : a + m]), *(pa.array(c[k][a : a + m].astype(np.int64, copy=False)) for k in NAMES[1:])], names=NAMES)


def _found(part: pa.RecordBatch, length: int) -> dict[str, np.ndarray]:
    doc, start, count, anchor, content = runs(pc.fill_null(part.column("data"), b"").to_pylist(), length)
    ids, hashes = part.column("doc_id").to_numpy(), part.column("row_hash").to_numpy()
    return {"anchor": anchor.view(np.int64), "content": content[:, 0], "content2": content[:, 1], "doc_id": ids[doc], "row_hash": hashes[doc], "start": start, "n": count}


def hot_anchors(docs: DataFrame, length: int, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Anchors with many contents in a sample of about ``sample_docs`` documents, chosen by a hash
    of their id and text; at most ``MOST_HOT``, sorted."""
    grain = 1 << 40
    share = min(1.0, sample_docs / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "data"):
                c = _found(part, length)
                yield pa.RecordBatch.from_arrays([pa.array(c["anchor"]), pa.array(c["content"])], names=["anchor", "content"])

    own = docs.filter(F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(grain)) < int(share * grain)).select("doc_id", "row_hash", "data")
    seen = own.mapInArrow(run, "anchor long, content long").distinct().groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") >= SAMPLE_CONTENTS)
    return np.sort(np.array([r[0] for r in seen.orderBy(F.desc("n"), "anchor").limit(MOST_HOT).collect()], np.int64))


def find_runs(docs: DataFrame, length: int, hot: np.ndarray = np.zeros(0, np.int64)) -> DataFrame:
    """Step 1: runs to compare (``ONE``, or ``HOT`` if their anchor is) and repeats."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            c = {k: np.concatenate([h[k] for h in held]) for k in NAMES[1:]}
            order, first, again = _split_repeats(c)
            own = {k: v[order[first]] for k, v in c.items()}
            yield from _batch(own, np.where(np.isin(own["anchor"], shared.value), HOT, ONE))
            yield from _batch(_merged({k: v[order[again]] for k, v in c.items()}), REPEAT)

        for batch in batches:
            for part in slices(batch, "data"):
                held.append(_found(part, length))
                rows += len(held[-1]["start"])
            if rows >= SEND_ROWS:
                yield from send()
                held, rows = [], 0
        if held:
            yield from send()

    return docs.select("doc_id", "row_hash", "data").mapInArrow(run, RUN)


class _Meeting:
    """Reads runs sorted by anchor, content, length and place; holds the first run of the
    last content, and the first runs of the last anchor until their number tells their kind."""

    def __init__(self, hot_contents: int):
        self.hot_contents = hot_contents
        self.head: dict[str, np.ndarray] | None = None
        self.held: list[dict[str, np.ndarray]] = []
        self.count, self.sent = 0, False

    def _send(self) -> Iterator[pa.RecordBatch]:
        own = {k: np.concatenate([h[k] for h in self.held]) for k in NAMES}
        if self.sent or self.count > 1 or (own["kind"] == HOT).any():
            yield from _batch(own, np.where(self.sent | (self.count > self.hot_contents) | (own["kind"] == HOT), HOT, ONE))
        self.held = []

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield from self._send()
        self.count, self.sent = 0, False

    def add(self, c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        known = self.head is not None
        if known:
            c = {k: np.concatenate([self.head[k], c[k]]) for k in NAMES}
        first = _later(c["anchor"], c["content"], c["content2"], c["n"])
        at = np.flatnonzero(first)
        head = at[np.cumsum(first) - 1]
        same = (c["doc_id"] == c["doc_id"][head]) & (c["row_hash"] == c["row_hash"][head]) & (c["start"] == c["start"][head])
        again = np.flatnonzero(~first & ~same)
        yield from _batch({k: v[again] for k, v in c.items()}, REPEAT)
        self.head = {k: v[at[-1] : at[-1] + 1] for k, v in c.items()}
        new = at[1:] if known else at  # the head was counted when it came
        anchor = c["anchor"]
        starts = np.flatnonzero(_later(anchor[new])) if len(new) else np.zeros(0, np.int64)
        # Of the anchors, the first may go on from the batch before, and the last into the next one.
        goes_on = known and len(new) > 0 and anchor[new[0]] == anchor[0]
        if goes_on:
            stop = starts[1] if len(starts) > 1 else len(new)
            yield from self._hold({n: v[new[:stop]] for n, v in c.items()}, int(stop))
            starts = starts[1:]
        if not len(starts):
            return
        yield from self.end()
        size = np.diff(np.append(starts, len(new)))
        inner = np.repeat(size[:-1], size[:-1])
        own = {n: v[new[starts[0] : starts[-1]]] for n, v in c.items()}
        hot = (inner > self.hot_contents) | (own["kind"] == HOT)
        told = hot | (inner > 1)
        yield from _batch({n: v[told] for n, v in own.items()}, np.where(hot, HOT, ONE)[told])
        yield from self._hold({n: v[new[starts[-1] :]] for n, v in c.items()}, int(size[-1]))

    def _hold(self, own: dict[str, np.ndarray], count: int) -> Iterator[pa.RecordBatch]:
        self.held.append(own)
        self.count += count
        if self.count > self.hot_contents:
            yield from self._send()
            self.sent = True


def meet(found: DataFrame, hot_contents: int | None = None) -> DataFrame:
    """Step 2: repeats, and first runs of anchors with several contents (``HOT`` where the anchor
    is known to be hot or has over ``hot_contents`` contents)."""
    most = HOT_CONTENTS if hot_contents is None else hot_contents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = _Meeting(most)
        for b in batches:
            known = pc.equal(b.column("kind"), REPEAT)
            if (done := b.filter(known)).num_rows:
                yield done
            if done.num_rows < b.num_rows:
                rest = b.filter(pc.invert(known))
                yield from meeting.add({k: rest.column(k).to_numpy() for k in NAMES})
        yield from meeting.end()

    # Repeats stay where they are dealt to; a row of them goes by its place, one of a hot anchor by its content.
    key = F.when(F.col("kind") == ONE, F.col("anchor")).when(F.col("kind") == HOT, F.xxhash64("anchor", "content")).otherwise(F.xxhash64("doc_id", "start"))
    dealt = found.withColumn("key", key).repartition("key").drop("key")
    # An anchor has one kind but for repeats, which are passed on as they come.
    return dealt.sortWithinPartitions("anchor", "content", "content2", "n", "doc_id", "row_hash", "start").mapInArrow(run, RUN)


def split_hot(data: list[bytes], length: int, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of at most two windows that make up the runs of ``data``: row, first window in it,
    number of windows, the hash of the bytes that both windows have and the digest of all bytes."""
    joined = b"".join(data)
    text = np.frombuffer(joined, np.uint8)
    size = np.fromiter(map(len, data), np.int64, len(data))
    base = np.cumsum(size) - size
    acc = np.zeros(len(text) + 1, U64)
    np.cumsum((text.astype(U64) + U64(1)) * _power(_BASE, len(text)), out=acc[1:])
    inverse = _power(_BASE_INV, len(text))
    spread = length - anchor + 1
    grams = base[:, None] + np.arange(spread)
    h = mix((acc[grams + anchor] - acc[grams]) * inverse[grams])
    place = ((h & U64(0xFFFFFFFF00000000)) | np.arange(spread, dtype=U64)).argmin(1)  # of the anchor in the first window
    pairs = np.arange((spread + 1) // 2)
    first = np.maximum(place[:, None] - 2 * pairs - 1, 0)
    last = np.minimum(place[:, None] - 2 * pairs, (size - length)[:, None])
    row, pair = np.nonzero(last >= first)
    first, last, shared = first[row, pair], last[row, pair], place[row] - 2 * pairs[pair]
    at, start, n = base[row] + shared, base[row] + first, last - first + 1
    key = mix(mix((acc[at + length - 1] - acc[at]) * inverse[at]) + pair.astype(U64))
    return row, first, n, key, digests_of(joined, start, n + length - 1)


def split(contents: DataFrame, length: int) -> DataFrame:
    """Contents of hot anchors (``HOT``) as finer runs (``ONE``) or repeats; others as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def send() -> Iterator[pa.RecordBatch]:
            own = pa.Table.from_batches(held).to_pydict()
            row, first, n, key, content = split_hot(own["data"], length)
            ids, hashes, start = (np.array(own[k], np.int64)[row] for k in ("doc_id", "row_hash", "start"))
            c = {"anchor": key.view(np.int64), "content": content[:, 0], "content2": content[:, 1], "doc_id": ids, "row_hash": hashes, "start": start + first, "n": n}
            order, one, again = _split_repeats(c)
            for b in _batch({k: v[order[again]] for k, v in c.items()}, REPEAT):
                yield b.append_column("data", pa.nulls(b.num_rows, pa.binary()))
            at, made = order[one], 0
            for b in _batch({k: v[at] for k, v in c.items()} | dict.fromkeys(("content", "content2"), np.zeros(len(at), np.int64)), ONE, 10_000):
                mine = at[made : made + b.num_rows]
                cut = [own["data"][r][f : f + m + length - 1] for r, f, m in zip(row[mine].tolist(), first[mine].tolist(), n[mine].tolist(), strict=True)]
                made += b.num_rows
                yield b.append_column("data", pa.array(cut, pa.binary()))

        for b in batches:
            hot = pc.equal(b.column("kind"), HOT)
            if (others := b.filter(pc.invert(hot))).num_rows:
                yield pa.RecordBatch.from_arrays(others.columns, names=[*NAMES, "data"])
            if others.num_rows < b.num_rows:
                held.append(b.filter(hot))
            if sum(h.num_rows for h in held) >= SEND_ROWS // 50:
                yield from send()
                held = []
        if held:
            yield from send()

    return contents.select(*NAMES, "data").mapInArrow(run, RUN + ", data binary")


def shared_windows(content: list[bytes], doc_id: np.ndarray, row_hash: np.ndarray, start: np.ndarray, anchor: np.ndarray, length: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Windows (row and offset) that occur earlier among the contents. Only windows that share a hash
    are looked at; those of one hash stay together, so where their bytes are over ``most``
    (``ARRAY_BYTES``) they are compared in parts of about as much."""
    most = ARRAY_BYTES if most is None else most
    text = np.frombuffer(b"".join(content), np.uint8)
    size = np.fromiter(map(len, content), np.int64, len(content))
    base = np.cumsum(size) - size
    acc = np.zeros(len(text) + 1, U64)
    np.cumsum((text.astype(U64) + U64(1)) * _power(_BASE, len(text)), out=acc[1:])
    count = size - length + 1
    row = np.repeat(np.arange(len(content)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = base[row] + offset
    h = mix((acc[at + length] - acc[at]) * _power(_BASE_INV, len(text))[at])
    _, back, times = np.unique(h, return_inverse=True, return_counts=True)
    maybe = times[back] > 1
    row, offset, at, back = row[maybe], offset[maybe], at[maybe], back[maybe]
    places = (start[row] + offset, row_hash[row], doc_id[row])
    new = _later(row, at - np.arange(len(at)))
    if len(at) + int(new.sum()) * length <= most:
        again = _repeated(text, at, new, places, length)
    else:
        ends = np.cumsum(np.where(times > 1, times, 0)) * length
        part = (ends // most)[back]
        order = np.argsort(part, kind="stable")
        found = [np.zeros(0, np.int64)]
        for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            found.append(own[_repeated(text, at[own], _later(row[own], at[own] - np.arange(len(own))), tuple(p[own] for p in places), length)])
        again = np.concatenate(found)
    return row[again], offset[again]


def _repeated(text: np.ndarray, at: np.ndarray, new: np.ndarray, places: tuple[np.ndarray, ...], length: int) -> np.ndarray:
    """Which of the windows at ascending places ``at`` of ``text`` equal one that is earlier by the keys
    ``places`` (the last one first); ``new`` tells where one doesn't follow the one before."""
    if not len(at):
        return np.zeros(0, np.int64)
    # Stretches of windows that follow each other, each with an end mark of its own rank.
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    n = at[tail] - at[head] + length
    out_base = np.cumsum(n + 1) - (n + 1)
    joined = np.zeros(int((n + 1).sum()), np.int64)
    stretch = np.repeat(np.arange(len(head)), n)
    inner = np.arange(len(stretch)) - np.repeat(np.cumsum(n) - n, n)
    joined[out_base[stretch] + inner] = text[at[head][stretch] + inner].astype(np.int64) + 1
    of = np.full(len(joined), -1)
    own = np.repeat(np.arange(len(head)), tail - head + 1)
    of[out_base[own] + at - at[head][own]] = np.arange(len(at))
    order = suffix_array(joined)
    w = of[order[of[order] >= 0]]
    same = np.zeros(len(w), bool)
    for a in range(1, len(w), 20_000):
        k = np.arange(a, min(a + 20_000, len(w)))
        span = np.arange(length)
        same[k] = (text[at[w[k]][:, None] + span] == text[at[w[k - 1]][:, None] + span]).all(1)
    group = np.cumsum(~same)
    rank = np.lexsort((*(p[w] for p in places), group))
    return w[rank][~_later(group[rank])]


def compare(contents: DataFrame, length: int) -> DataFrame:
    """Step 3: repeats among the contents of each anchor, and the repeats known before. Contents
    come sorted by anchor; whole anchors of about ``ARRAY_BYTES`` share a suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole anchors, then rows of the last one

        def send(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = {k: np.concatenate([b.column(k).to_numpy() for b in rows]) for k in ("anchor", "doc_id", "row_hash", "start")}
            data = [x for b in rows for x in b.column("data").to_pylist()]
            # Equal contents that several tasks sent: the first one stays.
            order, seen, again = np.lexsort((c["start"], c["row_hash"], c["doc_id"])), {}, []
            for i in order.tolist():
                j = seen.setdefault((int(c["anchor"][i]), data[i]), i)
                if j != i:
                    again.append(i)
            if again:
                o = {k: v[again] for k, v in c.items()}
                n = np.array([len(data[i]) - length + 1 for i in again])
                yield from _batch({**o, "n": n}, REPEAT)
                kept = np.sort(np.array(list(seen.values())))
                c, data = {k: v[kept] for k, v in c.items()}, [data[i] for i in kept.tolist()]
            row, offset = shared_windows(data, c["doc_id"], c["row_hash"], c["start"], c["anchor"], length)
            yield from _batch({"anchor": c["anchor"][row], "doc_id": c["doc_id"][row], "row_hash": c["row_hash"][row], "start": c["start"][row] + offset, "n": np.ones(len(row))}, REPEAT)

        size = 0
        for b in batches:
            known = pc.equal(b.column("kind"), REPEAT)
            if (done := b.filter(known)).num_rows:
                yield done.select(NAMES)
            b = b.filter(pc.invert(known))
            if not b.num_rows:
                continue
            anchor = b.column("anchor").to_numpy()
            bytes_in = np.cumsum(pc.binary_length(b.column("data")).to_numpy(zero_copy_only=False))
            ends = np.flatnonzero(_later(anchor))  # where an anchor that is new to the batch starts
            if held and held[-1].column("anchor")[held[-1].num_rows - 1].as_py() == anchor[0]:
                ends = ends[1:]
            a = 0
            for e in ends.tolist():
                here = int((bytes_in[e - 1] if e else 0) - (bytes_in[a - 1] if a else 0))
                if size + here > ARRAY_BYTES and (held or e > a):
                    if e > a:
                        held.append(b.slice(a, e - a))
                    yield from send(held)
                    held, size, a = [], 0, e
            if a < b.num_rows:
                held.append(b.slice(a))
                size += int(bytes_in[-1] - (bytes_in[a - 1] if a else 0))
        if held:
            yield from send(held)

    key = F.when(F.col("kind") == ONE, F.col("anchor")).otherwise(F.xxhash64("doc_id", "start"))
    dealt = contents.withColumn("key", key).repartition("key").drop("key")
    return dealt.sortWithinPartitions("anchor").mapInArrow(run, RUN)


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (doc_id, row_hash, data) with ``spans``: maximal removed runs of bytes as a list
    of starts and ends, in turn; null where nothing is removed."""
    spark = docs.sparkSession
    arrow_rows(spark, 10_000)
    met = stored(meet(find_runs(docs, length, hot_anchors(docs, length))).drop("content", "content2"), "runs")
    own = F.struct("kind", "anchor", "start", "n")
    of_doc = met.filter(F.col("kind") != REPEAT).groupBy("doc_id", "row_hash").agg(F.collect_list(own).alias("own"))
    cut = docs.dropDuplicates(["doc_id", "row_hash"]).join(of_doc, ["doc_id", "row_hash"]).select("doc_id", "row_hash", "data", F.explode("own").alias("r"))
    none = [F.lit(0).cast("long").alias(c) for c in ("content", "content2")]  # told apart by their bytes from here on
    contents = cut.select("r.kind", "r.anchor", *none, "doc_id", "row_hash", "r.start", "r.n", F.expr(f"substring(data, cast(r.start + 1 as int), cast(r.n + {length - 1} as int))").alias("data"))
    compared = stored(compare(split(contents, length), length), "compared")
    repeats = met.filter("kind = 0").select("doc_id", "row_hash", "start", "n").unionByName(compared.select("doc_id", "row_hash", "start", "n"))
    grouped = repeats.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("start", "n")).alias("own"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("own")
            flat, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            out = []
            for x, y in zip(at[:-1], at[1:], strict=True):
                o = np.argsort(start[x:y], kind="stable")
                s = start[x:y][o]
                e = np.maximum.accumulate(s + n[x:y][o] + length - 1)
                new = np.concatenate([[True], s[1:] > e[:-1]])
                out.append(np.column_stack([s[new], e[np.append(np.flatnonzero(new)[1:], len(s)) - 1]]).ravel())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_hash"), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "row_hash", "spans"])

    spans = grouped.mapInArrow(unite, "doc_id long, row_hash long, spans array<long>")
    return docs.join(spans, ["doc_id", "row_hash"], "left")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (never null), row_hash and bytes of each row."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("row_hash"), F.col("text").cast("binary").alias("data"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans and kept (the remaining bytes) of each row."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "data", 1 << 22):
                out = []
                for data, spans in zip(pc.fill_null(b.column("data"), b"").to_pylist(), b.column("spans").to_pylist(), strict=True):
                    spans = spans or []
                    bounds = [0, *spans, len(data)]
                    out.append((len(data), spans, b"".join(data[x:y] for x, y in zip(bounds[::2], bounds[1::2], strict=True))))
                n, spans, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    found = removed_spans(keyed(docs), length).mapInArrow(keep, "doc_id long, n_bytes long, spans array<long>, kept binary")
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def digests(docs: DataFrame) -> DataFrame:
    found = remove_repeats(docs)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.expr("cast(size(spans) div 2 as long)").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


