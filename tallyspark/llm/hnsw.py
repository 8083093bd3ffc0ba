"""A hierarchical navigable small-world graph whose searches run many queries at once in numpy."""

from __future__ import annotations

import numpy as np


def unit(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """vectors: unit rows. near[0] has the neighbours of all nodes, near[k] those of the nodes of level k and above;
    rows are padded with -1. Nodes are numbered in order of insertion."""

    def __init__(self, vectors: np.ndarray, links: int = 16, beam: int = 64, seed: int = 1) -> None:
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.order = rng.permutation(n)
        self.x = np.ascontiguousarray(vectors[self.order], np.float32)
        level = np.minimum((-np.log(rng.random(n)) / np.log(links)).astype(int), 6)
        self.near, self.members = [], []
        for k in range(int(level.max(initial=0)) + 1):
            members = np.flatnonzero(level >= k)
            self.members.append(members)
            self.near.append(np.full((n if k == 0 else len(members), 2 * links if k == 0 else links), -1, np.int32))
        self.size = 0
        step = 64
        while self.size < n:
            self._insert(min(step, n - self.size), links, beam)
            step = min(2 * step, 1024)

    def _rows(self, k: int, nodes: np.ndarray) -> np.ndarray:
        return nodes if k == 0 else np.searchsorted(self.members[k], nodes)

    def _insert(self, count: int, links: int, beam: int) -> None:
        new = np.arange(self.size, self.size + count)
        entry = self._entries(self.x[new]) if self.size else None
        within = self.x[new] @ self.x[new].T
        np.fill_diagonal(within, -2)
        for k in range(len(self.near)):
            at = np.flatnonzero(np.isin(new, self.members[k])) if k else np.arange(count)
            if not len(at):
                continue
            ids, sims = np.full((len(at), 0), -1, np.int32), np.zeros((len(at), 0), np.float32)
            if entry is not None and entry[k] is not None:
                ids, sims = self._beam(k, self.x[new[at]], entry[k][at], beam)
            mine = within[np.ix_(at, at)]
            few = min(2 * links, len(at) - 1)
            if few > 0:
                top = np.argpartition(-mine, few - 1, axis=1)[:, :few]
                ids = np.concatenate([ids, new[at][top].astype(np.int32)], 1)
                sims = np.concatenate([sims, np.take_along_axis(mine, top, 1)], 1)
            if not ids.shape[1]:
                continue
            width = self.near[k].shape[1]
            chosen = self._diverse(ids, sims, links)
            self.near[k][self._rows(k, new[at])] = np.pad(chosen, ((0, 0), (0, width)), constant_values=-1)[:, :width]
            self._back(k, new[at], chosen)
        self.size += count

    def _back(self, k: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Ties chosen neighbours back to ``nodes``; full rows are chosen anew."""
        a, b = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        targets, first, counts = np.unique(b[o := np.argsort(b, kind="stable")], return_index=True, return_counts=True)
        a = a[o]
        width = self.near[k].shape[1]
        most = int(min(counts.max(initial=0), 4 * width))
        extra = np.full((len(targets), most), -1, np.int32)
        place = np.arange(len(a)) - np.repeat(first, counts)
        keep = place < most
        extra[np.repeat(np.arange(len(targets)), counts)[keep], place[keep]] = a[keep]
        rows = self._rows(k, targets)
        both = np.concatenate([self.near[k][rows], extra], 1)
        for i in range(0, len(rows), 512):
            part = both[i : i + 512]
            sims = np.einsum("bmd,bd->bm", self.x[part], self.x[targets[i : i + 512]])
            sims[part < 0] = -2
            order = np.argsort(-sims, axis=1, kind="stable")
            part, sims = np.take_along_axis(part, order, 1), np.take_along_axis(sims, order, 1)
            again = np.zeros(part.shape, bool)
            again[:, 1:] = (part[:, 1:] == part[:, :-1]) & (part[:, 1:] >= 0)
            sims[again], part[again] = -2, -1
            if (sims > -2).sum(1).max(initial=0) > width:
                part = self._diverse(part[:, : 3 * width], sims[:, : 3 * width], width)
            else:
                order = np.argsort(-sims, axis=1, kind="stable")
                part = np.take_along_axis(part, order, 1)
            part = np.pad(part, ((0, 0), (0, width)), constant_values=-1)[:, :width]
            self.near[k][rows[i : i + 512]] = part

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` neighbours each, nearest first, passing over those nearer to one chosen than to the node;
        what room is left goes to the nearest passed over."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        out = np.full((len(ids), min(most, ids.shape[1])), -1, np.int32)
        for i in range(0, len(ids), 256):
            part, own = ids[i : i + 256], sims[i : i + 256]
            x = self.x[part]
            pair = np.matmul(x, x.transpose(0, 2, 1))
            taken = np.zeros(part.shape, bool)
            for j in range(part.shape[1]):
                closest = np.where(taken[:, :j], pair[:, j, :j], -2).max(1, initial=-2)
                taken[:, j] = (own[:, j] > -2) & (closest < own[:, j]) & (taken.sum(1) < most)
            rank = np.where(own > -2, np.where(taken, 0, 1), 2)
            best = np.argsort(rank, axis=1, kind="stable")[:, : out.shape[1]]
            out[i : i + 256] = np.where(np.take_along_axis(rank, best, 1) < 2, np.take_along_axis(part, best, 1), -1)
        return out

    def _entries(self, queries: np.ndarray) -> list:
        """Where to begin on each level: from the top down, the nearest node found above."""
        out: list = [None] * len(self.near)
        at = None
        for k in range(len(self.near) - 1, -1, -1):
            here = self.members[k][: np.searchsorted(self.members[k], self.size)]
            if not len(here):
                continue
            if at is None:
                at = np.full((len(queries), 1), here[0], np.int32)
            out[k] = at
            if k:
                at = self._beam(k, queries, at, 1)[0]
        return out

    def _beam(self, k: int, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` nodes found for each query, nearest first, and their similarities."""
        n = len(queries)
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -2, np.float32)
        ids[:, : entry.shape[1]] = entry
        sims[:, : entry.shape[1]] = np.einsum("bmd,bd->bm", self.x[entry], queries)
        seen = np.zeros((n, max(self.size, 1) if self.size else len(self.x)), bool)
        np.put_along_axis(seen, entry.astype(np.int64), True, 1)
        fresh = ids >= 0
        live = np.arange(n)
        while len(live):
            s = np.where(fresh[live], sims[live], -3)
            best = s.argmax(1)
            going = s[np.arange(len(live)), best] > -3
            live, best = live[going], best[going]
            if not len(live):
                break
            now = ids[live, best]
            fresh[live, best] = False
            near = self.near[k][self._rows(k, now)]
            ok = near >= 0
            near0 = np.where(ok, near, 0)
            ok &= ~seen[live[:, None], near0]
            r, c = np.nonzero(ok)
            seen[live[r], near0[r, c]] = True
            got = np.full(near.shape, -2, np.float32)
            got[r, c] = np.einsum("nd,nd->n", self.x[near0[r, c]], queries[live[r]])
            some = np.flatnonzero((got > sims[live].min(1)[:, None]).any(1))
            if not len(some):
                continue
            rows = live[some]
            all_ids = np.concatenate([ids[rows], near[some]], 1)
            all_sims = np.concatenate([sims[rows], got[some]], 1)
            all_fresh = np.concatenate([fresh[rows], got[some] > -2], 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[rows] = np.take_along_axis(all_ids, top, 1)
            sims[rows] = np.take_along_axis(all_sims, top, 1)
            fresh[rows] = np.take_along_axis(all_fresh, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, beam: int, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """For each query the numbers, in the order given at the start, of the nearest found, and similarities; -1, -2: none."""
        ids, sims = [], []
        for i in range(0, len(queries), step):
            q = np.ascontiguousarray(queries[i : i + step], np.float32)
            a, b = self._beam(0, q, self._entries(q)[0], min(beam, len(self.x)))
            ids.append(np.where(a >= 0, self.order[a], -1))
            sims.append(b)
        return np.concatenate(ids), np.concatenate(sims)
