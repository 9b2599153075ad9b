"""Hierarchical navigable small-world graphs over unit vectors, built and searched many vectors at a time.

A graph lives in numpy arrays.  Vectors are added in batches: a batch searches the graph as it stands, its
members also see each other, and all of them are linked at once.  A search keeps a beam for each query and
moves all beams one step at a time, so the loops of Python run over steps, not over vectors.
"""

from __future__ import annotations

import numpy as np

#: Links of a node on upper levels; level 0 has twice as many.
WIDTH = 12
#: Beams on upper levels, and when linking.
UPPER, LINKING = 4, 40
#: Vectors of a batch, nodes whose links are chosen at once, and beam entries that one step expands.
BATCH, CHOSEN_AT_ONCE, EXPANDED = 256, 512, 2


class Graph:
    """Vectors by number; ``links[level]`` holds each node's neighbours, -1 for none."""

    def __init__(self, capacity: int, dimensions: int) -> None:
        self.data = np.zeros((capacity, dimensions), np.float32)
        self.n, self.entry, self.links = 0, -1, []
        rng = np.random.Generator(np.random.PCG64(capacity))
        self.levels = (-np.log(1 - rng.random(capacity)) / np.log(WIDTH)).astype(np.int64)

    def state(self) -> dict:
        return {"data": self.data[: self.n], "links": [x[: self.n] for x in self.links], "entry": self.entry}

    @classmethod
    def of(cls, state: dict) -> Graph:
        self = cls.__new__(cls)
        self.data, self.links, self.entry, self.n = state["data"], state["links"], state["entry"], len(state["data"])
        return self

    # --- search

    def beam(self, level: int, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of each query's ``width`` best, best first; -1 where there are fewer."""
        links, n = self.links[level], len(queries)
        width = max(width, entries.shape[1])
        row = np.arange(n)[:, None]
        seen = np.zeros((n, self.n + 1), bool)  # the last column stands for no node
        nodes, near, open_ = np.full((n, width), -1, np.int64), np.full((n, width), -3, np.float32), np.zeros((n, width), bool)
        first = entries.shape[1]
        nodes[:, :first], open_[:, :first] = entries, entries >= 0
        near[:, :first] = np.where(entries >= 0, np.einsum("qd,qed->qe", queries, self.data[entries]), -3)
        seen[row, entries] = True
        active = np.arange(n)
        while len(active):
            able = np.where(open_[active], near[active], -4)
            picked = np.argpartition(-able, EXPANDED - 1, axis=1)[:, :EXPANDED] if width > EXPANDED else np.argsort(-able, axis=1)[:, :EXPANDED]
            good = np.take_along_axis(able, picked, 1) > -4
            going = good.any(axis=1)
            active, picked, good = active[going], picked[going], good[going]
            if not len(active):
                break
            at = active[:, None]
            best = np.where(good, nodes[at, picked], -1)
            open_[at, picked] = False
            around, fresh = [], []
            for k in range(best.shape[1]):
                next_ = np.where(best[:, k, None] >= 0, links[best[:, k]], -1)
                fresh.append((next_ >= 0) & ~seen[at, next_])
                seen[at, next_] = True
                around.append(next_)
            next_, new = np.concatenate(around, axis=1), np.concatenate(fresh, axis=1)
            a, c = np.nonzero(new)
            found = np.full(next_.shape, -3, np.float32)
            found[a, c] = np.einsum("id,id->i", queries[active[a]], self.data[next_[a, c]])
            all_near = np.concatenate([near[active], found], axis=1)
            keep = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
            nodes[active] = np.take_along_axis(np.concatenate([nodes[active], next_], axis=1), keep, 1)
            open_[active] = np.take_along_axis(np.concatenate([open_[active], new], axis=1), keep, 1)
            near[active] = np.take_along_axis(all_near, keep, 1)
        nodes[near <= -3] = -1
        order = np.argsort(-near, axis=1, kind="stable")
        return np.take_along_axis(nodes, order, 1), np.take_along_axis(near, order, 1)

    def descent(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Beams on the levels above 0, lowest first."""
        entries, found = np.full((len(queries), 1), self.entry), []
        for level in range(len(self.links) - 1, 0, -1):
            found.append(self.beam(level, queries, entries, UPPER))
            entries = found[-1][0]
        return found[::-1]

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``beam``, from the entry down to level 0; queries are taken in batches."""
        out = []
        for at in range(0, len(queries), BATCH):
            part = queries[at : at + BATCH]
            found = self.descent(part)
            entries = found[0][0] if found else np.full((len(part), 1), self.entry)
            out.append(self.beam(0, part, entries, width))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros((0, width), np.int64), np.zeros((0, width), np.float32))

    # --- building

    def add(self, vectors: np.ndarray) -> None:
        """Adds vectors, in batches no larger than what is there."""
        at = 0
        while at < len(vectors):
            to = at + min(BATCH, max(self.n, 32))
            self._add(vectors[at:to])
            at = to

    def _add(self, vectors: np.ndarray) -> None:
        first, vectors = self.n, vectors.astype(np.float32)
        levels = self.levels[first : first + len(vectors)]
        found: list = []
        if first:
            found = self.descent(vectors)
            entries = found[0][0] if found else np.full((len(vectors), 1), self.entry)
            found = [self.beam(0, vectors, entries, LINKING), *found]
        self.data[first : first + len(vectors)] = vectors
        self.n += len(vectors)
        peers = vectors @ vectors.T
        np.fill_diagonal(peers, -3)
        for level in range(levels.max(initial=0) + 1):
            width = 2 * WIDTH if level == 0 else WIDTH
            if level == len(self.links):
                self.links.append(np.full((len(self.data), width), -1, np.int64))
            own = np.flatnonzero(levels >= level)
            most = min(LINKING // 2, len(own))
            among = peers[np.ix_(own, own)]
            close = np.argpartition(-among, most - 1, axis=1)[:, :most]
            near = np.take_along_axis(among, close, 1)
            nodes = np.where(near > -3, first + own[close], -1)
            if level < len(found):
                nodes, near = (np.concatenate([x[own], y], axis=1) for x, y in zip(found[level], (nodes, near), strict=True))
            self._link(level, first + own, nodes, near)
        highest = first + int(levels.argmax())
        if self.entry < 0 or self.levels[highest] > self.levels[self.entry]:
            self.entry = highest

    def _diverse(self, nodes: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
        """Of each row's candidates those nearer to it than to any chosen before; what room is left goes to the nearest others."""
        order = np.argsort(-near, axis=1, kind="stable")
        nodes, near = np.take_along_axis(nodes, order, 1), np.take_along_axis(near, order, 1)
        there = self.data[nodes]
        between = there @ there.transpose(0, 2, 1)
        taken = np.zeros(nodes.shape, bool)
        for k in range(nodes.shape[1]):
            taken[:, k] = (nodes[:, k] >= 0) & (taken.sum(axis=1) < width) & ~(taken & (between[:, k] > near[:, k, None])).any(axis=1)
        worth = np.where(nodes < 0, -9, near + 4 * taken)
        best = np.argsort(-worth, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(nodes, best, 1)

    def _chosen(self, level: int, owners: np.ndarray, nodes: np.ndarray, near: np.ndarray, width: int) -> None:
        """Sets the links of ``owners`` to a choice of candidates."""
        for at in range(0, len(owners), CHOSEN_AT_ONCE):
            part = slice(at, at + CHOSEN_AT_ONCE)
            kept = self._diverse(nodes[part], near[part], width)
            self.links[level][owners[part]] = -1
            self.links[level][owners[part], : kept.shape[1]] = kept

    def _link(self, level: int, new: np.ndarray, nodes: np.ndarray, near: np.ndarray) -> None:
        """Links new nodes to a choice of candidates, and these back to them."""
        self._chosen(level, new, nodes, near, WIDTH)
        to = self.links[level][new, :WIDTH]
        source, target = np.repeat(new, WIDTH)[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        width = self.links[level].shape[1]
        while len(target):
            owners, first, counts = np.unique(target, return_index=True, return_counts=True)
            place = np.arange(len(target)) - np.repeat(first, counts)
            now = place < width  # more links to one node wait for the next turn
            extra = np.full((len(owners), min(width, int(counts.max()))), -1, np.int64)
            extra[np.repeat(np.arange(len(owners)), counts)[now], place[now]] = source[now]
            held = self.links[level][owners]
            extra = np.where((extra[:, :, None] == held[:, None, :]).any(axis=2), -1, extra)
            for at in range(0, len(owners), CHOSEN_AT_ONCE):
                part = slice(at, at + CHOSEN_AT_ONCE)
                both = np.concatenate([held[part], extra[part]], axis=1)
                similar = np.where(both >= 0, np.einsum("od,oed->oe", self.data[owners[part]], self.data[both]), -3)
                self._chosen(level, owners[part], both, similar, width)
            source, target = source[~now], target[~now]
