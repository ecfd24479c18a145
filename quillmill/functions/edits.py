"""Edit distances of many texts at once, on bits: a column of the table of distances is two 64-bit words, which all pairs advance together.

Texts are cells of a larger comparison: whole blocks against each other, or the pairs of blocks that pass exact bounds. Distances count
characters. Pairs that don't fit the words (the text that stands as bits has over 64 characters) come out as -1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bits of a word; characters from which on a pair is left to the caller, so that a similarity rounds the same way everywhere.
WORD, LONGEST = 64, 1024
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
#: Pairs that advance together, and texts and bitmaps of a tile: they stay in the cache.
_TOGETHER, _TILE = 8_192, 1_024
_BITMAP = 4


class Texts:
    """Texts as one array of characters with starts and lengths."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.size = pa.compute.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)

    def __len__(self) -> int:
        return len(self.size)

    def padded(self, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(rows, longest) of the codes of characters, 0 behind the end."""
        size = self.size[rows]
        out = np.zeros((len(rows), int(size.max(initial=0))), codes.dtype)
        inside = np.arange(out.shape[1]) < size[:, None]
        out[inside] = codes[np.repeat(self.at[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        return out


def _masks(texts: Texts, rows: np.ndarray, codes: np.ndarray, letters: int) -> np.ndarray:
    """(rows, letters) the places of each letter in each text as bits; texts that don't fit have none."""
    out = np.zeros((len(rows), letters), np.uint64)
    grid = texts.padded(rows, codes)[:, :WORD]
    at = np.arange(len(rows))
    for k in range(grid.shape[1]):
        there = texts.size[rows] > k
        out[at[there], grid[there, k]] |= _ONE << np.uint64(k)
    return out


def _lengths(bits: np.ndarray) -> np.ndarray:
    """The lowest so many bits."""
    return np.where(bits >= WORD, _ALL, (_ONE << np.minimum(bits, WORD - 1).astype(np.uint64)) - _ONE)


def _step(eq: np.ndarray, pv: np.ndarray, mv: np.ndarray, new_pv: np.ndarray, new_mv: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """One character further; ``x`` and ``y`` are room. ``new_pv`` and ``new_mv`` may be ``pv`` and ``mv``."""
    np.bitwise_and(eq, pv, out=x)
    np.add(x, pv, out=x)
    np.bitwise_xor(x, pv, out=x)
    np.bitwise_or(x, eq, out=x)  # horizontal
    np.bitwise_or(x, pv, out=y)
    np.invert(y, out=y)
    np.bitwise_or(y, mv, out=y)  # plus
    np.bitwise_and(x, pv, out=x)  # minus
    np.left_shift(x, _ONE, out=x)
    np.left_shift(y, _ONE, out=y)
    np.bitwise_or(y, _ONE, out=y)
    np.bitwise_or(eq, mv, out=new_mv)  # vertical
    np.bitwise_or(new_mv, y, out=new_pv)
    np.invert(new_pv, out=new_pv)
    np.bitwise_or(new_pv, x, out=new_pv)
    np.bitwise_and(new_mv, y, out=new_mv)


def all_distances(patterns: Texts, texts: Texts) -> Iterator[tuple[int, np.ndarray]]:
    """(row of texts, its distances to all patterns); beginnings that texts share are walked once, so sorted texts are cheap."""
    rows = np.arange(len(patterns))
    fits = patterns.size <= WORD
    known, codes = np.unique(patterns.chars, return_inverse=True)
    # letter 0 is one that no pattern has
    masks = np.ascontiguousarray(_masks(patterns, rows, (codes + 1).astype(np.int64), len(known) + 1).T)
    found = np.searchsorted(known, texts.chars)
    found[found == len(known)] = 0
    letters = np.where(known[found] == texts.chars, found + 1, 0) if len(known) else np.zeros(len(texts.chars), np.int64)
    low = _lengths(patterns.size)
    x, y = np.empty(len(rows), np.uint64), np.empty(len(rows), np.uint64)
    pv, mv = [np.full(len(rows), _ALL)], [np.zeros(len(rows), np.uint64)]
    before = letters[:0]
    for k in range(len(texts)):
        own = letters[texts.at[k] : texts.at[k + 1]]
        same = min(len(own), len(before))
        differ = np.flatnonzero(own[:same] != before[:same])
        for depth in range(int(differ[0]) if len(differ) else same, len(own)):
            if len(pv) < depth + 2:
                pv.append(np.empty(len(rows), np.uint64))
                mv.append(np.empty(len(rows), np.uint64))
            _step(masks[own[depth]], pv[depth], mv[depth], pv[depth + 1], mv[depth + 1], x, y)
        before = own
        n = len(own)
        distance = n + np.bitwise_count(pv[n] & low).astype(np.int64) - np.bitwise_count(mv[n] & low)
        yield k, np.where(fits, distance, -1)


class Pairs:
    """Distances of pairs of rows of two sides; ``a`` holds the bits."""

    def __init__(self, a: Texts, b: Texts):
        self.a, self.b = a, b
        known, codes = np.unique(a.chars, return_inverse=True)
        self.codes, self.letters = codes.astype(np.int64) + 1, len(known) + 1
        found = np.minimum(np.searchsorted(known, b.chars), max(0, len(known) - 1))
        # letter 0 is one that ``a`` lacks
        letters = np.where(known[found] == b.chars, found + 1, 0) if len(known) else np.zeros(len(b.chars), np.int64)
        self.grid = np.ascontiguousarray(b.padded(np.arange(len(b)), letters.astype(np.int64)).T)

    def distances(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = self.a, self.b
        out = np.full(len(left), -1, np.int64)
        size = b.size[right]
        # by tiles of ``a``, longer texts first, so that those that go on are always a prefix
        order = np.flatnonzero(a.size[left] <= WORD)
        order = order[np.argsort((size[order].max(initial=0) - size[order]).astype(np.uint16 if size.max(initial=0) < 65_536 else np.int64), kind="stable")]
        tile = left[order] // _TILE
        order = order[np.argsort(tile.astype(np.uint16 if len(a) < 65_536 * _TILE else np.int64), kind="stable")]
        tile = left[order] // _TILE
        for first in np.unique(tile):
            take = order[np.searchsorted(tile, first) : np.searchsorted(tile, first, side="right")]
            rows = np.arange(first * _TILE, min(len(a), (first + 1) * _TILE))
            masks = _masks(a, rows, self.codes, self.letters).ravel()
            low_bits = _lengths(a.size[rows])
            for at in range(0, len(take), _TOGETHER):
                own = take[at : at + _TOGETHER]
                own_left, to, size_of = left[own] - rows[0], right[own], size[own]
                base = own_left * self.letters
                going = np.searchsorted(-size_of, -np.arange(int(size_of[0])), side="left")
                pv, mv = np.full(len(own), _ALL), np.zeros(len(own), np.uint64)
                x, y = np.empty(len(own), np.uint64), np.empty(len(own), np.uint64)
                for k, n in enumerate(going):
                    eq = masks.take(base[:n] + self.grid[k].take(to[:n]))
                    _step(eq, pv[:n], mv[:n], pv[:n], mv[:n], x[:n], y[:n])
                low = low_bits[own_left]
                out[own] = size_of + np.bitwise_count(pv & low).astype(np.int64) - np.bitwise_count(mv & low)
        return out


def _bitmaps(sides: list[Texts], grams: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each side, bitmaps of the texts' n-grams, the n-th occurrence of one counting as its own, and how many more n-grams than bits there
    are: two texts share at most the bits that they share and either one's surplus. Common n-grams have bits of their own."""
    keys, rows, texts = [], [], []
    for side in sides:
        starts = np.repeat(side.at[:-1], np.maximum(side.size - grams + 1, 0))
        row = np.repeat(np.arange(len(side)), np.maximum(side.size - grams + 1, 0))
        place = starts + np.arange(len(row)) - np.searchsorted(row, row)
        key = np.zeros(len(row), np.uint64)
        for g in range(grams):
            key = (key << np.uint64(21)) | side.chars[place + g].astype(np.uint64)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
        keys.append((key << np.uint64(10)) ^ (np.minimum(np.arange(len(row)) - first, 1023).astype(np.uint64)) if grams == 1 else key * np.uint64(0x9E3779B97F4A7C15) + (np.arange(len(row)) - first).astype(np.uint64))
        rows.append(row)
        texts.append(side)
    known, code, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    bits = _BITMAP * WORD
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(known))
    own = bits * 3 // 4
    bit = np.where(rank < own, rank, own + rank % (bits - own))[code]
    out, at = [], 0
    for side, row in zip(texts, rows, strict=True):
        mine = bit[at : at + len(row)]
        at += len(row)
        held = np.zeros((len(side), bits), bool)
        held[row, mine] = True
        words = np.packbits(held, axis=1).view(np.uint64)
        out.append((np.ascontiguousarray(words.T), np.bincount(row, minlength=len(side)) - held.sum(1)))
    return out


def close_pairs(a: Texts, b: Texts, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, distances): all pairs whose similarity may be ``least`` or more and the distances of those that fit, -1 for the
    others; with ``same``, ``a`` is ``b`` and pairs count once. No pair is lost.

    An edit touches one character and two pairs of neighbours at most, so texts of up to n characters have least * n characters and
    (2 * least - 1) * n - 1 neighbours in common. Bitmaps bound both.
    """
    sorted_a, sorted_b = np.argsort(a.size, kind="stable"), np.argsort(b.size, kind="stable")
    (pairs_a, more_a), (pairs_b, more_b) = _bitmaps([a, b], 2)
    (bag_a, over_a), (bag_b, over_b) = _bitmaps([a, b], 1)
    pairs = Pairs(a, b)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    sizes_b = b.size[sorted_b]
    words_b = pairs_b[:, sorted_b]
    for at in range(0, len(sorted_a), 16):
        rows = sorted_a[at : at + 16]
        start = np.searchsorted(sizes_b, np.ceil(least * a.size[rows[0]] - 1e-9))
        stop = np.searchsorted(sizes_b, np.floor(a.size[rows[-1]] / least + 1e-9), side="right")
        start = max(start, at) if same else start  # the longer one stands to the right
        for low in range(start, stop, 4 * _TILE):
            high = min(stop, low + 4 * _TILE)
            shared = np.bitwise_count(pairs_a[0, rows][:, None] & words_b[0, low:high])
            for w in range(1, _BITMAP):
                shared += np.bitwise_count(pairs_a[w, rows][:, None] & words_b[w, low:high])
            others = sorted_b[low:high]
            # the demand of the shorter of both, a little too low, in one byte; the exact one follows
            demand = np.maximum((2 * least - 1) * np.maximum(b.size[others], a.size[rows].min()) - 1 - more_b[others], 0)
            passed = np.flatnonzero((shared >= np.minimum(np.ceil(demand - 1e-6), 255).astype(np.uint8)).ravel())
            i, j = np.divmod(passed, high - low)
            x, y = rows[i], others[j]
            common = shared.ravel()[passed]
            longest = np.maximum(a.size[x], b.size[y])
            ok = (np.minimum(a.size[x], b.size[y]) >= least * longest - 1e-9) & (common + np.minimum(more_a[x], more_b[y]) >= (2 * least - 1) * longest - 1 - 1e-6)
            if same:
                ok &= at + i < low + j
            x, y, longest = x[ok], y[ok], longest[ok]
            bag = np.minimum(over_a[x], over_b[y])
            for w in range(_BITMAP):
                bag += np.bitwise_count(bag_a[w, x] & bag_b[w, y])
            ok = bag >= least * longest - 1e-6
            if ok.any():
                kept.append((x[ok], y[ok]))
                waiting += int(ok.sum())
        if waiting > 500_000 or at + 16 >= len(sorted_a) and kept:
            x, y = (np.concatenate(side) for side in zip(*kept, strict=True))
            distance = pairs.distances(x, y)
            longest = np.maximum(a.size[x], b.size[y])
            distance[longest >= LONGEST] = -1
            ok = (distance < 0) | (1 - distance / longest >= least - 1e-9)
            yield x[ok], y[ok], distance[ok]
            kept, waiting = [], 0


def similarities(distance: np.ndarray, longest: np.ndarray) -> pa.Array:
    """Similarities, null where the distance isn't known."""
    return pa.array(1 - distance / longest, mask=(distance < 0) | (longest >= LONGEST))


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first so many columns, which the batches are sorted by."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in batch.columns[:keys]:
            change[1:] |= pa.compute.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            key = [c[at].as_py() for c in batch.columns[:keys]]
            if waiting and key != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            last = key
            waiting.append(batch.slice(at, to - at))
    if waiting:
        yield pa.Table.from_batches(waiting)
