"""Exact tokenizer encoding with a compact cache of encoded chunks.

A text is cut where the byte-level pre-tokenizer cuts it too: white space is divided by
its two rules, one space goes with what follows, and a Latin letter never joins an ASCII
mark other than the apostrophe. So a text's ids are the ids of its chunks, one after
another, and each distinct chunk goes through the tokenizers library once per worker. The
cache is looked up by a hash and holds the chunks themselves: each use is compared with the
chunk that was encoded, code point by code point, and a text with a chunk that differs goes
to the library whole. So do texts that hold a special token's string.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from .textops import U64, code_points, piece_hashes

# Bounds of the cache: chunks, and code points of chunks for each.
CACHE_CHUNKS, CACHE_CHARS = 1_000_000, 16
_SPACE, _LETTER, _MARK = 1, 2, 3


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def _kinds() -> np.ndarray:
    kind = np.zeros(0x110000, np.int8)
    for i in range(0x3001):
        c = chr(i)
        if c.isspace():
            kind[i] = _SPACE
        elif c.isalpha() and i < 0x250:
            kind[i] = _LETTER
        elif i < 0x80 and not c.isalnum() and c != "'":
            kind[i] = _MARK
    return kind


def chunk_starts(cp: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions where chunks start in the code points of texts that follow each other."""
    n = len(cp)
    kind = _kinds()[cp]
    space = kind == _SPACE
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    before, after = kind[:-1], kind[1:]
    cut = first[:n]
    cut[1:] |= ((before == _LETTER) & (after == _MARK)) | ((before == _MARK) & (after == _LETTER))
    inner = ~first[1:n]
    cut[1:] |= ~space[:-1] & space[1:] & inner  # a run of white space starts
    to_word = np.zeros(n, bool)  # the last white space before a word
    to_word[:-1] = space[:-1] & ~space[1:] & inner
    cut |= to_word
    blank = cp == 0x20
    cut[1:] |= to_word[:-1] & ~blank[:-1]
    return np.flatnonzero(cut)


class CachedEncoder:
    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # in byte-level vocabularies a character stands for a byte
            self.bytes_of[i] = len(token)
        self.cache_chunks = cache_chunks
        self._reset()

    def _reset(self) -> None:
        self.keys, self.slots = np.zeros(0, U64), np.zeros(0, np.int32)
        self.first, self.count, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.int32)
        self.chars_at, self.size, self.chars = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, "<u4")
        self.known = self.used = self.used_chars = 0

    _keys = staticmethod(piece_hashes)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, len(a) * 3 // 2) - len(a), a.dtype)])

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one after another, and how many each has. The library gets one text:
        a chunk that starts with a space starts a pre-token there; before any other goes a
        line break, whose one id is taken out again. White space goes one by one."""
        plain = np.fromiter((not c[-1].isspace() for c in chunks), bool, len(chunks))
        told = [c if c[0] == " " else "\n" + c for c, ok in zip(chunks, plain.tolist(), strict=True) if ok]
        count = np.zeros(len(chunks), np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(told)], add_special_tokens=False)[0].ids, np.int32)
        if told:
            size = np.fromiter((len(c.encode("utf-8", "surrogatepass")) for c in told), np.int64, len(told))
            broken = np.fromiter((c[0] == "\n" for c in told), bool, len(told))
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(size)) + 1
            starts = np.concatenate([[0], ends[:-1]])
            ids = np.delete(ids, starts[broken])
            count[plain] = ends - starts - broken
        blanks = {int(i): np.array(self.tokenizer.encode(chunks[i], add_special_tokens=False).ids, np.int32) for i in np.flatnonzero(~plain)}
        if blanks:
            ends, parts, a = np.cumsum(count), [], 0
            for i, got in blanks.items():
                parts += [ids[a : ends[i]], got]
                a, count[i] = ends[i], len(got)
            ids = np.concatenate([*parts, ids[a:]])
        return ids, count

    def _slots(self, text: str, cp: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The cache's slots of chunks; chunks that it lacks are encoded first."""
        own, at, back = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, own)
        found = np.zeros(len(own), bool)
        inside = place < len(self.keys)
        found[inside] = self.keys[place[inside]] == own[inside]
        new = np.flatnonzero(~found)
        if len(new):
            where = at[new]
            size = end[where] - start[where]
            total = int(size.sum())
            if self.known and (self.known + len(new) > self.cache_chunks or self.used_chars + total > CACHE_CHARS * self.cache_chunks):
                self._reset()
                return self._slots(text, cp, start, end, key)
            ids, count = self._encode_chunks([text[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            n = self.known + len(new)
            self.first, self.count, self.ids = self._room(self.first, n), self._room(self.count, n), self._room(self.ids, self.used + len(ids))
            self.first[self.known : n], self.count[self.known : n] = self.used + np.cumsum(count) - count, count
            self.ids[self.used : self.used + len(ids)] = ids
            self.chars_at, self.size, self.chars = self._room(self.chars_at, n), self._room(self.size, n), self._room(self.chars, self.used_chars + total)
            own_at = np.cumsum(size) - size
            self.chars_at[self.known : n], self.size[self.known : n] = self.used_chars + own_at, size
            self.chars[self.used_chars : self.used_chars + total] = cp[np.arange(total) + np.repeat(start[where] - own_at, size)]
            self.used_chars += total
            self.keys = np.insert(self.keys, place[new], own[new])
            self.slots = np.insert(self.slots, place[new], np.arange(self.known, n, dtype=np.int32))
            self.known, self.used = n, self.used + len(ids)
            place = np.searchsorted(self.keys, own)
        return self.slots[place][back]

    def _differ(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The places in ``start`` of chunks that aren't what their slot holds. The chunks
        follow each other without gaps."""
        size = end - start
        wrong = size != self.size[slot]
        if wrong.any():
            return np.flatnonzero(wrong | ~self._equal(cp, start, np.minimum(size, self.size[slot]), slot))
        ok = self._equal(cp, start, size, slot)
        return np.flatnonzero(~ok)

    def _equal(self, cp: np.ndarray, start: np.ndarray, size: np.ndarray, slot: np.ndarray) -> np.ndarray:
        at = np.cumsum(size) - size
        inner = np.arange(int(size.sum()))
        unlike = self.chars[inner + np.repeat(self.chars_at[slot] - at, size)] != cp[inner + np.repeat(start - at, size)]
        if not unlike.any():
            return np.ones(len(start), bool)
        return np.add.reduceat(unlike.astype(np.int64), at) == 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the texts' offsets into them."""
        whole = {i: self.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if any(s in t for s in self.special)}
        kept = ["" if i in whole else t for i, t in enumerate(texts)] if whole else texts
        text = "".join(kept)
        sizes = np.fromiter(map(len, kept), np.int64, len(kept))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if text:
            cp = code_points(text)
            start = chunk_starts(cp, offsets[:-1][sizes > 0])
            end = np.append(start[1:], len(cp))
            slot = self._slots(text, cp, start, end, self._keys(cp, start, end))
            for i in np.unique(np.searchsorted(offsets, start[self._differ(cp, start, end, slot)], side="right") - 1).tolist():
                whole[i] = self.tokenizer.encode(texts[i], add_special_tokens=False).ids
            count = self.count[slot].astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(count)])
            ids = self.ids[np.repeat(self.first[slot] - ends[:-1], count) + np.arange(ends[-1])]
            offsets = ends[np.searchsorted(start, offsets)]
        else:
            ids = np.zeros(0, np.int32)
        if whole:
            parts = [np.array(whole[i], np.int32) if i in whole else ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets


@lru_cache(2)
def encoder(path: str) -> CachedEncoder:
    return CachedEncoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends ``end_id`` to each text's ids."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
