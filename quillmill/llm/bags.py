"""Bags of tokens as sorted element arrays, with token-union bitmaps.

The n-th occurrence of a token in a text is an element of its own, so that the sum of smaller counts over the sum of larger
counts of two texts is the Jaccard similarity of their element sets. Elements are 32-bit hashes; two different elements of one
pair of texts coincide with probability below 1e-5.

Everything works on whole Arrow batches with numpy; nothing is computed per row in Python but the split into tokens.
"""

from __future__ import annotations

from operator import add

import numpy as np
import pyarrow as pa
import xxhash

from .common import HAN_RUN, WORD4

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: 64-bit words of a bitmap: sets of a hundred elements leave it sparse enough to tell unlike sets apart.
BITMAP_WORDS = 6
_memo: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def token_hash(token: str) -> int:
    h = _memo.get(token)
    if h is None:
        if len(_memo) > 1_000_000:
            _memo.clear()
        h = _memo[token] = xxhash.xxh64_intdigest(token)
    return h


def word_tokens(text: str) -> list[str]:
    """Words of four or more letters or digits, and pairs of adjacent Han characters, of a lower-cased text."""
    out = WORD4.findall(text)
    for run in HAN_RUN.findall(text):
        out += map(add, run, run[1:])
    return out


class Bags:
    """Element sets of a batch of texts: ``flat`` holds them one after the other, sorted within each; ``starts`` has n + 1 places."""

    def __init__(self, doc: np.ndarray, hashes: np.ndarray, counts: np.ndarray | None, n: int):
        if counts is None:
            order = np.lexsort((hashes, doc))
            doc, hashes = doc[order], hashes[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
            first = np.flatnonzero(new)
            nth = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
        else:
            doc, hashes = np.repeat(doc, counts), np.repeat(hashes, counts)
            ends = np.cumsum(counts)
            nth = np.arange(len(doc)) - np.repeat(ends - counts, counts)
        elements = (mix(hashes + nth.astype(np.uint64) * GOLDEN) >> np.uint64(32)).astype(np.uint64)
        both = np.sort((doc.astype(np.uint64) << np.uint64(32)) | elements)
        self.flat = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.starts = np.searchsorted(both >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
        self.n = n

    @classmethod
    def of_texts(cls, texts: list[list[str]]) -> Bags:
        sizes = np.array([len(t) for t in texts], np.int64)
        get = _memo.get
        hashes = np.array([get(t) or token_hash(t) for ts in texts for t in ts], np.uint64)
        return cls(np.repeat(np.arange(len(texts)), sizes), hashes, None, len(texts))

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def keys(self) -> np.ndarray:
        """A 64-bit key of each element set: equal sets have equal keys."""
        h = mix(self.flat.astype(np.uint64) + GOLDEN)
        total = np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)])
        return mix(total[self.starts[1:]] - total[self.starts[:-1]] + self.sizes().astype(np.uint64)).view(np.int64)

    def binary(self) -> pa.Array:
        """The sets as Arrow binaries, four bytes an element."""
        offsets = (self.starts * 4).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(self.flat).tobytes())])


class Sets:
    """Element sets read back from Arrow binaries."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        wide = pa.types.is_large_binary(column.type)
        offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        self.flat = data[offsets[0] : offsets[-1]].view(np.uint32) if len(column) else np.empty(0, np.uint32)
        self.starts = ((offsets - offsets[0]) // 4).astype(np.int64)

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)


def bitmaps(flat: np.ndarray, starts: np.ndarray, words: int = BITMAP_WORDS) -> np.ndarray:
    """(sets, words) union bitmaps of the elements: one bit an element, by hash."""
    place = mix(flat.astype(np.uint64) * GOLDEN) % np.uint64(64 * words)
    out = np.zeros((len(starts) - 1, words), np.uint64)
    for w in range(words):
        bits = np.where(place // np.uint64(64) == w, np.uint64(1) << (place % np.uint64(64)), np.uint64(0))
        out[:, w] = np.bitwise_or.reduceat(bits, starts[:-1])
    return out


def intersections(a: Sets, b: Sets) -> np.ndarray:
    """Sizes of the pairwise intersections of two columns of sets of equal length."""
    n = len(a.starts) - 1
    row = lambda s: np.repeat(np.arange(n, dtype=np.uint64), s.sizes())
    both = np.concatenate([(row(a) << np.uint64(32)) | a.flat, (row(b) << np.uint64(32)) | b.flat])
    both.sort()
    same = both[1:][both[1:] == both[:-1]]
    return np.bincount((same >> np.uint64(32)).astype(np.int64), minlength=n)
