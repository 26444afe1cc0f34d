"""Vectorised text primitives on numpy: words, word hashes, five-word shingles.

A word is a maximal run of letters and digits (with their combining marks) of the
lower-cased text. A word's hash is a sum of products of its code points' keys and its places'
keys (a multilinear hash, both tables made by a rule), so equal words have equal hashes on
every machine and no structure of long words makes them collide; arithmetic wraps modulo 2**64.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_CODE_MUL = 0xD1B54A32D192ED03
SHINGLE = 5
_SHINGLE_MUL = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], U64)


@lru_cache(1)
def _word_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() or unicodedata.combining(chr(i)) > 0 for i in range(0x110000)), bool, 0x110000)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 20), base, U64)
        p[0] = 1
        _powers[base] = have = np.multiply.accumulate(p)
    return have[:n]


_places: list[np.ndarray] = [np.zeros(0, U64)]


def _place_keys(n: int) -> np.ndarray:
    """Keys of places in a piece of text: mixed counters, as many as are asked for."""
    if len(_places[0]) < n:
        _places[0] = mix(np.arange(1, max(2 * n, 1 << 12) + 1, dtype=U64) * U64(_BASE)) | U64(1)
    return _places[0][:n]


def piece_hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the non-empty pieces ``start`` to ``end`` (in order, apart) of code points."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    at = np.cumsum(size) - size
    place = np.arange(at[-1] + size[-1]) - np.repeat(at, size)
    own = cp[place + np.repeat(start, size)].astype(U64)
    own += U64(1)
    own *= U64(_CODE_MUL)
    own ^= own >> U64(32)
    own *= _place_keys(int(size.max()))[place]
    return mix(np.add.reduceat(own, at) + size.astype(U64) * U64(_BASE))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes (in place)."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, the texts' offsets into them (one more than
    texts), and the words' first and end positions in ``"\\n".join(texts).lower()``."""
    low = [t.lower() for t in texts]
    cp = code_points("\n".join(low))
    n = len(cp)
    is_word = np.zeros(n + 2, np.int8)
    is_word[1:-1] = _word_table()[cp]
    edge = np.diff(is_word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lens = np.fromiter(map(len, low), np.int64, len(low)) + 1
    at = np.concatenate([[0], np.cumsum(lens)])
    return piece_hashes(cp, start, end), np.searchsorted(start, at), start, end


def shingles(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of five-word shingles and the texts' offsets into them. A text of one to four
    words has one shingle, of all its words; one without words has none."""
    n = np.diff(offsets)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(offsets[:-1] - out_at[:-1], count) + np.arange(out_at[-1])
    padded = np.concatenate([hashes, np.zeros(SHINGLE, U64)])
    h = np.zeros(len(first), U64)
    for k in range(SHINGLE):
        h += padded[first + k] * _SHINGLE_MUL[k]
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        w = hashes[offsets[i] : offsets[i + 1]]
        h[out_at[i]] = np.sum(w * _SHINGLE_MUL[: len(w)], dtype=U64) + U64(len(w))
    return mix(h), out_at


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each with about ``most`` bytes of text or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return pc.fill_null(batch.column(column), "").to_pylist()
