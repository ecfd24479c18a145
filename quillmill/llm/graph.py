"""Navigable small-world graphs over token bitmaps: one graph per segment of a history, searched with a beam.

A node is a class of equal element sets; its vector is the bitmap of its elements, and two nodes are as close as the Jaccard similarity of
their bitmaps. Nodes are inserted in blocks: each new node is linked to the nearest nodes that a search of the graph so far finds, and to
the nearest of its own block; the links of the first nodes stay and make the graph navigable, later ones give way to nearer ones. A search
keeps a beam of the best nodes seen and opens the best unopened ones until none is left. Blocks of queries walk together, so everything is
array work.

The beam is not fixed: ``tuned`` widens it until a sample of queries finds, in the candidates that come out, the share asked for of what an
exhaustive search over the same segment finds. Candidates are exact only after ``near_dups.compared``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Links of a node, of which the first half stay where they are; nodes inserted or searched together; nodes opened at once.
LINKS, BLOCK, OPENED = 16, 256, 4
#: Nodes from which every search starts.
ENTRIES = 32
BEAMS = (16, 32, 64, 128, 256, 512)


def closeness(a: np.ndarray, b: np.ndarray, ones_a: np.ndarray, ones_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of bitmaps along the last axis."""
    common = np.bitwise_count(a & b).sum(axis=-1, dtype=np.int32)
    return common / np.maximum(1, ones_a + ones_b - common).astype(np.float32)


@dataclass
class Graph:
    """``bits`` are the nodes' bitmaps, ``links`` their neighbours (-1 where there is none), ``keys`` what they stand for."""

    bits: np.ndarray
    keys: np.ndarray
    links: np.ndarray
    ones: np.ndarray

    @classmethod
    def build(cls, bits: np.ndarray, keys: np.ndarray, beam: int = 48, seed: int = 7) -> Graph:
        order = np.random.default_rng(seed).permutation(len(bits))
        bits, keys = bits[order], keys[order]
        ones = np.bitwise_count(bits).sum(axis=1).astype(np.int32)
        links = np.full((len(bits), LINKS), -1, np.int32)
        graph = cls(bits, keys, links, ones)
        for at in range(0, len(bits), BLOCK):
            new = np.arange(at, min(len(bits), at + BLOCK))
            own = closeness(bits[new][:, None], bits[new][None], ones[new][:, None], ones[new][None])
            np.fill_diagonal(own, -1)
            near = np.broadcast_to(new, own.shape)
            if at:
                found, close = graph.search(bits[new], ones[new], beam, size=at)
                near, own = np.concatenate([near, found], axis=1), np.concatenate([own, close], axis=1)
            k = min(LINKS, own.shape[1])
            best = np.argsort(-own, axis=1)[:, :k]
            chosen, close = np.take_along_axis(near, best, 1), np.take_along_axis(own, best, 1)
            chosen = np.where(close >= 0, chosen, -1)
            links[new, :k] = chosen
            graph._backwards(new, chosen, close)
        return graph

    def _backwards(self, new: np.ndarray, chosen: np.ndarray, close: np.ndarray) -> None:
        """Link the chosen nodes back: to a free place, else in the place of the farthest of the later half, if the new node is nearer."""
        source = np.repeat(new, chosen.shape[1])
        target, near = chosen.ravel(), close.ravel()
        good = target >= 0
        source, target, near = source[good], target[good], near[good]
        order = np.lexsort((-near, target))
        source, target, near = source[order], target[order], near[order]
        # one new link of each target at a time
        turn = np.arange(len(target)) - np.searchsorted(target, target)
        half = LINKS // 2
        for t in range(int(turn.max(initial=-1)) + 1):
            s, g, c = (x[turn == t] for x in (source, target, near))
            there = (self.links[g] == s[:, None]).any(axis=1)
            s, g, c = s[~there], g[~there], c[~there]
            if not len(g):
                continue
            old = self.links[g]
            value = np.where(old >= 0, closeness(self.bits[g][:, None], self.bits[old], self.ones[g][:, None], self.ones[old]), -1.0)
            value[:, :half] = np.where(old[:, :half] >= 0, 2.0, -1.0)
            place = value.argmin(axis=1)
            better = value[np.arange(len(g)), place] < c
            self.links[g[better], place[better]] = s[better]

    def search(self, bits: np.ndarray, ones: np.ndarray, beam: int, size: int | None = None, entries: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, closeness) of the best ``beam`` nodes that each query's walk saw; -1 where it saw fewer. ``entries`` adds starts of each query."""
        size = len(self.bits) if size is None else size
        n = len(bits)
        start = np.broadcast_to(np.linspace(0, size - 1, min(size, ENTRIES)).astype(np.int64), (n, min(size, ENTRIES)))
        if entries is not None:
            start = np.concatenate([start, entries], axis=1)
        seen = np.zeros((n, size), bool)
        row = np.arange(n)[:, None]
        ids, close = self._look(bits, ones, start, seen, row)
        opened = ids < 0
        ids, close, opened = self._best(ids, close, opened, beam)
        live = np.arange(n)
        while len(live):
            waiting = np.where(opened[live], -2.0, close[live])
            k = min(OPENED, waiting.shape[1])
            pick = np.argpartition(-waiting, k - 1, axis=1)[:, :k]
            going = np.take_along_axis(waiting, pick, 1) > -1
            some = going.any(axis=1)
            live, pick, going = live[some], pick[some], going[some]
            if not len(live):
                break
            opened[live[:, None], pick] = True
            nodes = np.where(going, ids[live[:, None], pick], -1)
            around = np.where(nodes[:, :, None] >= 0, self.links[nodes], -1).reshape(len(live), -1).astype(np.int64)
            found, value = self._look(bits[live], ones[live], around, seen, live[:, None])
            merged = self._best(np.concatenate([ids[live], found], axis=1), np.concatenate([close[live], value], axis=1), np.concatenate([opened[live], found < 0], axis=1), beam)
            width = merged[0].shape[1]
            if width > ids.shape[1]:
                grow = lambda x, v: np.concatenate([x, np.full((n, width - x.shape[1]), v, x.dtype)], axis=1)  # noqa: E731, B023
                ids, close, opened = grow(ids, -1), grow(close, -1), grow(opened, True)
            ids[live], close[live], opened[live] = merged
        return ids, close

    def _look(self, bits: np.ndarray, ones: np.ndarray, nodes: np.ndarray, seen: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that a query hasn't seen, with their closeness; others become -1."""
        nodes = np.sort(nodes, axis=1)
        fresh = nodes >= 0
        fresh[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
        fresh &= nodes < seen.shape[1]
        fresh &= ~seen[np.broadcast_to(row, nodes.shape), np.where(fresh, nodes, 0)]
        r, c = np.nonzero(fresh)
        seen[np.broadcast_to(row, nodes.shape)[r, c], nodes[r, c]] = True
        close = np.full(nodes.shape, -1, np.float32)
        close[r, c] = closeness(bits[r], self.bits[nodes[r, c]], ones[r], self.ones[nodes[r, c]])
        return np.where(fresh, nodes, -1), close

    @staticmethod
    def _best(ids: np.ndarray, close: np.ndarray, opened: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if ids.shape[1] <= beam:
            return ids, close, opened
        best = np.argpartition(-close, beam - 1, axis=1)[:, :beam]
        return tuple(np.take_along_axis(x, best, 1) for x in (ids, close, opened))

    def exhaustive(self, bits: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """(queries, nodes) closeness of all to all, for tuning."""
        return closeness(bits[:, None], self.bits[None], ones[:, None], self.ones[None])


def tuned(graph: Graph, bits: np.ndarray, least: float, recall: float = 0.98) -> tuple[int, float]:
    """(beam, share found): the narrowest beam at which the queries find ``recall`` of the nodes as close as ``least``."""
    ones = np.bitwise_count(bits).sum(axis=1).astype(np.int32)
    truth = [set(np.flatnonzero(graph.exhaustive(bits[k : k + 1], ones[k : k + 1])[0] >= least).tolist()) for k in range(len(bits))]
    total = sum(map(len, truth))
    share = 1.0
    for beam in BEAMS:
        found, _ = graph.search(bits, ones, beam)
        share = sum(len(t & set(f.tolist())) for t, f in zip(truth, found, strict=True)) / max(1, total)
        if share >= recall:
            break
    return beam, share
