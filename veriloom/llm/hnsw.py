"""Hierarchical navigable small-world graphs over unit vectors, in numpy, for many queries at a time.

Vectors within a tight angle of a graph's node join it as members and are not inserted: a group of
copies is one node with a list, so that it neither crowds the graph nor hides its neighbours.
"""

from __future__ import annotations

import numpy as np

#: Links of a node on the upper layers; the lowest has twice as many.
LINKS = 8
#: Beam while building.
BUILD_BEAM = 24
#: A vector with at least this cosine to a node joins it.
TIGHT = 0.98


class Graph:
    """`vectors` in the order given: rows of unit length, as float64."""

    def __init__(self, vectors: np.ndarray, seed: int = 3):
        self.x = vectors
        n = len(vectors)
        self.fast = vectors.astype(np.float32)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 6)
        self.links: list[np.ndarray] = []
        self.near: list[np.ndarray] = []
        self.nodes: list[int] = []
        self.owner = np.full(n, -1, np.int64)
        self.entry = -1
        self.top = -1
        at, step = 0, 1
        while at < n:
            self._insert(np.arange(at, min(n, at + step)))
            at += step
            step = min(256, max(1, at // 2))

    def _layer(self, l: int) -> None:
        while len(self.links) <= l:
            width = LINKS * (2 if not self.links else 1)
            self.links.append(np.full((len(self.x), width), -1, np.int32))
            self.near.append(np.full((len(self.x), width), -2.0, np.float32))

    def _insert(self, batch: np.ndarray) -> None:
        q = self.fast[batch]
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if self.top >= 0:
            start = np.full(len(batch), self.entry, np.int32)
            for l in range(self.top, -1, -1):
                found[l] = self.beam(q, start, l, BUILD_BEAM if l == 0 else 4)
                start = found[l][0][:, 0].copy()
            best = self._exact(batch, found[0][0][:, 0])
            self.owner[batch] = np.where(best >= TIGHT, found[0][0][:, 0], -1)
        # Those of the batch that found no node: the earlier ones are nodes for the later ones.
        fresh = batch[self.owner[batch] < 0]
        if not len(fresh):
            return
        within = self.x[fresh] @ self.x[fresh].T
        open_ = np.ones(len(fresh), bool)
        kept = []
        for i in range(len(fresh)):
            if open_[i]:
                kept.append(i)
                joins = open_ & (within[i] >= TIGHT)
                joins[: i + 1] = False
                self.owner[fresh[joins]] = fresh[i]
                open_ &= ~joins
        rows = {int(v): r for r, v in enumerate(batch)}
        for n_kept, i in enumerate(kept):
            v = int(fresh[i])
            self.owner[v] = v
            self.nodes.append(v)
            earlier = np.array(kept[:n_kept], int)
            for l in range(min(int(self.level[v]), max(self.top, 0)), -1, -1):
                self._layer(l)
                ids, sims = (a[rows[v]] for a in found[l]) if l in found else (np.empty(0, np.int32), np.empty(0, np.float32))
                if len(earlier):
                    e = earlier[self.level[fresh[earlier]] >= l]
                    e = e[np.argsort(-within[i, e])[: 2 * LINKS]]
                    ids, sims = np.concatenate([ids, fresh[e]]), np.concatenate([sims, within[i, e]])
                good = ids >= 0
                self._connect(v, ids[good].astype(np.int64), sims[good], l)
        for i in kept:
            v = int(fresh[i])
            if self.level[v] > self.top:
                self._layer(int(self.level[v]))
                self.top, self.entry = int(self.level[v]), v

    def _select(self, ids: np.ndarray, sims: np.ndarray, n: int) -> np.ndarray:
        """Positions of up to n neighbours: near ones first, those nearer to a chosen one than to the node only where room is left."""
        order = np.argsort(-sims, kind="stable")
        if len(order) <= n:
            return order
        order = order[: 4 * n]
        between = self.fast[ids[order]] @ self.fast[ids[order]].T
        chosen: list[int] = []
        spare = []
        for i in range(len(order)):
            if not chosen or between[i, chosen].max() < sims[order[i]]:
                chosen.append(i)
                if len(chosen) == n:
                    break
            else:
                spare.append(i)
        return order[(chosen + spare)[:n]]

    def _connect(self, v: int, ids: np.ndarray, sims: np.ndarray, l: int) -> None:
        links, near = self.links[l], self.near[l]
        width = links.shape[1]
        keep = self._select(ids, sims, width // 2 if l == 0 else width)
        ids, sims = ids[keep], sims[keep]
        links[v, : len(ids)], near[v, : len(ids)] = ids, sims
        for u, s in zip(ids.tolist(), sims.tolist(), strict=True):
            row = links[u]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]], near[u, free[0]] = v, s
                continue
            all_ids, all_sims = np.append(row, v).astype(np.int64), np.append(near[u], np.float32(s))
            keep = self._select(all_ids, all_sims, width)
            row[:], near[u] = -1, -2.0
            row[: len(keep)], near[u, : len(keep)] = all_ids[keep], all_sims[keep]

    def _exact(self, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.x[rows], self.x[nodes])

    def beam(self, q: np.ndarray, start: np.ndarray, l: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best nodes a beam finds on a layer for each query, best first: ids (-1: none) and cosines."""
        b, links, fast = len(q), self.links[l], self.fast
        ids = np.full((b, width), -1, np.int32)
        sims = np.full((b, width), -3.0, np.float32)
        todo = np.zeros((b, width), bool)
        seen = np.zeros((b, len(fast)), bool)
        every = np.arange(b)
        ids[:, 0], sims[:, 0], todo[:, 0] = start, np.einsum("ij,ij->i", fast[start], q), True
        seen[every, start] = True
        active = every
        while len(active):
            waiting = np.where(todo[active], sims[active], -4.0)
            at = waiting.argmax(axis=1)
            live = waiting[np.arange(len(active)), at] > -4.0
            active, at = active[live], at[live]
            if not len(active):
                break
            todo[active, at] = False
            nb = links[ids[active, at]]
            good = nb >= 0
            good &= ~seen[active[:, None], np.where(good, nb, 0)]
            r, c = np.nonzero(good)
            hit = nb[r, c]
            seen[active[r], hit] = True
            s = np.full(nb.shape, -3.0, np.float32)
            s[r, c] = np.einsum("ij,ij->i", fast[hit], q[active[r]])
            all_s = np.concatenate([sims[active], s], axis=1)
            all_i = np.concatenate([ids[active], np.where(good, nb, -1)], axis=1)
            all_t = np.concatenate([todo[active], good], axis=1)
            keep = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
            sims[active], ids[active], todo[active] = np.take_along_axis(all_s, keep, 1), np.take_along_axis(all_i, keep, 1), np.take_along_axis(all_t, keep, 1)
        ids[sims <= -3.0] = -1
        return ids, sims

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best nodes a beam finds for each query, from the top layer down."""
        q = q.astype(np.float32)
        start = np.full(len(q), self.entry, np.int32)
        for l in range(self.top, 0, -1):
            start = self.beam(q, start, l, 1)[0][:, 0].copy()
        return self.beam(q, start, 0, width)

    def dump(self) -> bytes:
        import io

        out = io.BytesIO()
        np.savez(out, owner=self.owner, nodes=np.array(self.nodes, np.int64), entry=self.entry, top=self.top, x=self.x, **{f"links{l}": a for l, a in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        import io

        z = np.load(io.BytesIO(data))
        g = cls.__new__(cls)
        g.x, g.owner, g.nodes, g.entry, g.top = z["x"], z["owner"], z["nodes"].tolist(), int(z["entry"]), int(z["top"])
        g.fast = g.x.astype(np.float32)
        g.links = [z[f"links{l}"] for l in range(g.top + 1)]
        return g
