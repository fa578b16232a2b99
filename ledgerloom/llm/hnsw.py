"""A hierarchical navigable small-world graph as flat neighbour arrays, in numpy.

Nodes enter in batches, those of high levels first; a whole batch walks the graph
in lockstep, so each step is one gather and one product for all its members.
Distances are Euclidean after one coordinate has been added that makes all vectors
equally long: nearest then means largest inner product.
"""

from __future__ import annotations

import numpy as np

LINKS, WIDTH, BATCH, STEP = 16, 80, 512, 4


def lengthened(x: np.ndarray) -> np.ndarray:
    """float32 vectors with the coordinate that makes their lengths equal."""
    norms = np.einsum("ij,ij->i", x, x, dtype=np.float64)
    extra = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))
    return np.column_stack([x, extra]).astype(np.float32)


class Graph:
    def __init__(self, vectors: np.ndarray, seed: int = 0):
        """``vectors`` are lengthened; building starts at once."""
        self.x = vectors
        n = len(vectors)
        draw = np.random.default_rng(seed)
        levels = np.floor(-np.log(1 - draw.random(n)) / np.log(LINKS)).astype(int)
        order = np.argsort(-levels, kind="stable")
        self.level, self.entry = levels, int(order[0]) if n else -1
        # flat[l][i] holds the neighbours of node i on level l, -1 where there is none.
        self.flat = [np.full((n, LINKS * (2 if l == 0 else 1)), -1, np.int32)
                     for l in range(int(levels.max(initial=0)) + 1)]
        done, size = 1, 1
        while done < n:
            batch = order[done:done + size]
            self._insert(batch)
            done, size = done + len(batch), min(BATCH, done + len(batch))

    # ------------------------------------------------------------- search

    def _near(self, q: np.ndarray, start: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes found from ``start`` (one row each), nearest first."""
        rows = np.arange(len(q))
        seen = np.zeros((len(q), len(self.x)), bool)
        ids = np.full((len(q), width), -1, np.int64)
        far = np.full((len(q), width), np.inf, np.float32)
        open_ = np.zeros((len(q), width), bool)
        ids[:, 0] = start
        far[:, 0] = self._far(q, start[:, None])[:, 0]
        open_[:, 0] = True
        seen[rows, start] = True
        flat = self.flat[level]
        active = rows
        step = min(STEP, width)
        while len(active):
            order = np.argsort(~open_[active], axis=1, kind="stable")[:, :step]  # nearest open ones
            chosen = np.take_along_axis(ids[active], order, 1)
            really = np.take_along_axis(open_[active], order, 1)
            part = open_[active]
            np.put_along_axis(part, order, False, 1)
            open_[active] = part
            near = np.where(really[:, :, None], flat[chosen], -1).reshape(len(active), -1)
            new = near >= 0
            new &= ~seen[active[:, None], near]
            # A neighbour of two of the chosen nodes counts once.
            near = np.where(new, near, -1)
            near.sort(1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            a, b = np.nonzero(new)
            seen[active[a], near[a, b]] = True
            distance = np.full(near.shape, np.inf, np.float32)
            delta = self.x[near[a, b]] - q[active[a]]
            distance[a, b] = np.einsum("ij,ij->i", delta, delta)
            all_far = np.concatenate([far[active], distance], 1)
            all_ids = np.concatenate([ids[active], np.where(new, near, -1)], 1)
            all_open = np.concatenate([open_[active], new], 1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            far[active] = np.take_along_axis(all_far, best, 1)
            ids[active] = np.take_along_axis(all_ids, best, 1)
            open_[active] = np.take_along_axis(all_open, best, 1)
            active = active[open_[active].any(1)]
        return ids, far

    def _far(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        delta = self.x[nodes] - q[:, None, :]
        out = np.einsum("ijk,ijk->ij", delta, delta)
        return np.where(nodes >= 0, out, np.inf).astype(np.float32)

    def search(self, q: np.ndarray, width: int, at_once: int = 1024) -> np.ndarray:
        """Nodes nearest to the (lengthened) queries, nearest first, -1 where none is left."""
        out = np.full((len(q), width), -1, np.int64)
        if self.entry < 0:
            return out
        for at in range(0, len(q), at_once):
            part = q[at:at + at_once]
            start = np.full(len(part), self.entry)
            for level in range(len(self.flat) - 1, 0, -1):
                start = self._near(part, start, level, 1)[0][:, 0]
            out[at:at + at_once] = self._near(part, start, 0, width)[0]
        return out

    # ------------------------------------------------------------- building

    def _insert(self, batch: np.ndarray) -> None:
        q = self.x[batch]
        start = np.full(len(batch), self.entry)
        for level in range(len(self.flat) - 1, -1, -1):
            enters = self.level[batch] >= level
            passing = ~enters
            if passing.any():
                start[passing] = self._near(q[passing], start[passing], level, 1)[0][:, 0]
            if not enters.any():
                continue
            who, x = batch[enters], q[enters]
            ids, far = self._near(x, start[enters], level, WIDTH)
            start[enters] = ids[:, 0]
            # Members of the batch do not see one another in the graph yet.
            square = np.einsum("ij,ij->i", x, x)
            own = np.maximum(square[:, None] + square[None, :] - 2 * (x @ x.T), 0)
            np.fill_diagonal(own, np.inf)
            few = np.argsort(own, axis=1)[:, :LINKS]
            ids = np.concatenate([ids, np.where(np.isinf(np.take_along_axis(own, few, 1)), -1, who[few])], 1)
            far = np.concatenate([far, np.take_along_axis(own, few, 1)], 1)
            chosen = self._spread(ids, far, LINKS)
            self.flat[level][who, :LINKS] = chosen
            self._link_back(who, chosen, level)

    def _spread(self, ids: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each row's nodes: near ones, but none that is nearer to a
        node already taken; free places go to the nearest others."""
        far = np.where(ids >= 0, far, np.inf)
        order = np.argsort(far, axis=1, kind="stable")[:, :3 * most]
        ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        out = np.full((len(ids), most), -1, np.int64)
        for at in range(0, len(ids), 256):
            i, f = ids[at:at + 256], far[at:at + 256]
            x = self.x[i]
            square = np.einsum("abc,abc->ab", x, x)
            apart = square[:, :, None] + square[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
            taken = np.zeros(i.shape, bool)
            for c in range(i.shape[1]):
                shadow = ((apart[:, c, :] < f[:, c, None]) & taken).any(1)
                taken[:, c] = ~shadow & (i[:, c] >= 0) & (taken.sum(1) < most)
            # Taken ones first, then the rest by distance.
            rank = np.argsort(np.where(taken, 0, 1) * 1000 + np.arange(i.shape[1]) + 10_000 * (i < 0),
                              axis=1, kind="stable")[:, :most]
            best = np.take_along_axis(i, rank, 1)
            out[at:at + 256, :best.shape[1]] = best
        return out

    def _link_back(self, who: np.ndarray, chosen: np.ndarray, level: int) -> None:
        flat = self.flat[level]
        target, source = chosen.ravel(), np.repeat(who, chosen.shape[1])
        target, source = target[target >= 0], source[target >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for some in np.array_split(np.arange(len(nodes)), max(1, len(nodes) // 1024)):
            if not len(some):
                continue
            wide = np.full((len(some), int(count[some].max())), -1, np.int64)
            row = np.repeat(np.arange(len(some)), count[some])
            place = np.arange(len(row)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            wide[row, place] = source[np.repeat(first[some], count[some]) + place]
            both = np.concatenate([flat[nodes[some]], wide], 1)
            used = (both >= 0).sum(1)
            fits = used <= flat.shape[1]
            if fits.any():
                packed = np.argsort(both[fits] < 0, axis=1, kind="stable")[:, :flat.shape[1]]
                flat[nodes[some][fits]] = np.take_along_axis(both[fits], packed, 1)
            if (~fits).any():
                x = self.x[nodes[some][~fits]]
                flat[nodes[some][~fits]] = self._spread(both[~fits], self._far(x, both[~fits]), flat.shape[1])

    # ------------------------------------------------------------- flat form

    def arrays(self) -> dict[str, bytes | int | list[bytes]]:
        return {"entry": self.entry, "flat": [f.tobytes() for f in self.flat], "vectors": self.x.tobytes(),
                "width": self.x.shape[1]}

    @classmethod
    def of(cls, entry: int, flat: list[bytes], vectors: bytes, width: int) -> "Graph":
        graph = cls.__new__(cls)
        graph.x = np.frombuffer(vectors, np.float32).reshape(-1, width)
        graph.entry = entry
        graph.flat = [np.frombuffer(f, np.int32).reshape(len(graph.x), -1) for f in flat]
        return graph
