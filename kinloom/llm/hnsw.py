"""Hierarchical navigable small-world graphs in numpy, many vectors at a time.

A layer is a list of neighbours per node; layer l + 1 holds about one in ``M`` of the nodes of layer l. Nodes enter a layer in the
order of their levels (highest first), in batches that at most double it; each node links to a diverse choice of the nearest found by
a beam search over the layer so far and among its own batch, and the links back are thinned by the same rule.
"""

from __future__ import annotations

import io

import numpy as np

M = 12
BUILD_BEAM = 40
BATCH = 512
STEP = 4


def _search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines of a beam per query, best first (-1 where the beam isn't full). Only nodes below ``limit`` exist yet."""
    m, n = len(queries), len(links) if limit is None else limit
    seen = np.zeros((m, n), bool)
    ids = np.full((m, beam), -1, np.int32)
    sims = np.full((m, beam), -np.inf, np.float32)
    done = np.ones((m, beam), bool)
    rows = np.arange(m)
    for c in range(min(entries.shape[1], beam)):
        e = entries[:, c]
        fresh = (e >= 0) & (e < n)
        fresh[fresh] = ~seen[rows[fresh], e[fresh]]
        r = rows[fresh]
        seen[r, e[fresh]] = True
        ids[r, c], done[r, c] = e[fresh], False
        sims[r, c] = np.einsum("qd,qd->q", queries[r], x[e[fresh]])
    active = rows
    step = min(STEP, beam)
    while len(active):
        open_sims = np.where(done[active], -np.inf, sims[active])
        pick = np.argpartition(-open_sims, step - 1, axis=1)[:, :step] if step < beam else np.broadcast_to(np.arange(beam), (len(active), beam))
        valid = np.take_along_axis(open_sims, pick, 1) > -np.inf
        going = valid.any(axis=1)
        active, pick, valid = active[going], pick[going], valid[going]
        if not len(active):
            break
        done[active[:, None], pick] |= valid
        near = links[ids[active[:, None], pick]]
        near = np.where(valid[:, :, None], near, -1).reshape(len(active), -1)
        near.sort(axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[active[:, None], near]
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        # dense rows of the fresh neighbours only
        count = fresh.sum(axis=1)
        most = int(count.max(initial=0))
        if not most:
            continue
        slot = np.cumsum(fresh, axis=1)[r, c] - 1
        new_ids = np.full((len(active), most), -1, np.int32)
        new_sims = np.full((len(active), most), -np.inf, np.float32)
        new_ids[r, slot] = near[r, c]
        new_sims[r, slot] = np.einsum("ed,ed->e", queries[active[r]], x[near[r, c]])
        all_ids = np.concatenate([ids[active], new_ids], axis=1)
        all_sims = np.concatenate([sims[active], new_sims], axis=1)
        all_done = np.concatenate([done[active], new_ids < 0], axis=1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        sims[active] = np.take_along_axis(all_sims, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` of the candidates (best first, -1 for none): those nearer to the node than to any chosen before, then the nearest others."""
    m, c = ids.shape
    if not m:
        return np.full((0, degree), -1, np.int32)
    v = x[ids]
    between = np.einsum("mcd,med->mce", v, v, optimize=True)
    chosen = np.zeros((m, c), bool)
    count = np.zeros(m, np.int64)
    for j in range(c):
        ok = (ids[:, j] >= 0) & (count < degree) & ~(chosen & (between[:, j] > sims[:, j, None])).any(axis=1)
        chosen[:, j] = ok
        count += ok
    rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :degree]
    out = np.full((m, degree), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(ids, order, 1)
    return out


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, most: int = 24) -> None:
    degree = links.shape[1]
    child, slot = np.nonzero(links[new] >= 0)
    parent, child = links[new][child, slot], new[child]
    sim = np.einsum("ed,ed->e", x[parent], x[child])
    order = np.lexsort((-sim, parent))
    parent, child, sim = parent[order], child[order], sim[order]
    nodes, first, size = np.unique(parent, return_index=True, return_counts=True)
    place = np.arange(len(parent)) - np.repeat(first, size)
    kept = place < most
    width = int(min(most, size.max(initial=0)))
    added = np.full((len(nodes), width), -1, np.int32)
    added[np.repeat(np.arange(len(nodes)), size)[kept], place[kept]] = child[kept]
    ids = np.concatenate([links[nodes], added], axis=1)
    ids.sort(axis=1)  # a link may be there already
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    sims = np.einsum("nd,ncd->nc", x[nodes], x[ids])
    sims[ids < 0] = -np.inf
    order = np.argsort(-sims, axis=1)
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    crowded = (ids >= 0).sum(axis=1) > degree
    easy = np.full((len(nodes), degree), -1, np.int32)
    w = min(degree, ids.shape[1])
    easy[:, :w] = ids[:, :w]
    links[nodes] = easy
    if crowded.any():
        links[nodes[crowded]] = _diverse(x, ids[crowded], sims[crowded], degree)


class Graph:
    """An index over unit vectors (float32). Nodes are in the order of ``order``, levels falling."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        self.order = np.arange(len(x))
        u = np.random.default_rng(seed).random(len(x))
        level = np.minimum(np.floor(-np.log(1 - u) / np.log(M)).astype(int), 12)
        self.order = np.argsort(-level, kind="stable")
        self.x = np.ascontiguousarray(x[self.order], np.float32)
        level = level[self.order]
        sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]  # layer k has the first sizes[k] nodes
        self.layers: list[np.ndarray] = [np.empty((0, 0), np.int32)] * len(sizes)
        for k in range(len(sizes) - 1, -1, -1):
            self._build(k, sizes[k])

    def _build(self, k: int, n: int) -> None:
        degree = 2 * M if k == 0 else M
        links = np.full((n, degree), -1, np.int32)
        self.layers[k] = links
        at = 0
        while at < n:
            to = min(n, at + min(BATCH, max(1, at)))
            new = np.arange(at, to)
            v = self.x[new]
            among = v @ v.T
            np.fill_diagonal(among, -np.inf)
            w = min(16, len(new))
            pick = np.argpartition(-among, w - 1, axis=1)[:, :w]
            ids, sims = new[pick].astype(np.int32), np.take_along_axis(among, pick, 1)
            ids[sims == -np.inf] = -1
            if at:
                old, old_sims = _search(self.x, links, v, self._entries(v, k + 1, at), BUILD_BEAM, limit=at)
                ids, sims = np.concatenate([old, ids], axis=1), np.concatenate([old_sims, sims], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            links[new] = _diverse(self.x, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), degree)
            _link_back(self.x, links, new)
            at = to

    def _entries(self, v: np.ndarray, down_to: int, limit: int | None = None) -> np.ndarray:
        """Where to enter the layer below ``down_to``: the nearest nodes found in the layers above, and the first node."""
        first = np.zeros((len(v), 1), np.int32)
        found = first
        for k in range(len(self.layers) - 1, down_to - 1, -1):
            ids, _ = _search(self.x, self.layers[k], v, found, 8)
            found = np.concatenate([ids[:, :3], first], axis=1)
        if limit is not None:
            found = np.where(found < limit, found, 0)
        return found

    def search(self, v: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the vectors given at the start, and cosines, best first."""
        ids, sims = _search(self.x, self.layers[0], v, self._entries(v, 1), min(beam, max(1, len(self.x))))
        return np.where(ids >= 0, self.order[ids], -1), sims

    def dump(self) -> bytes:
        """The links; the vectors are kept apart."""
        out = io.BytesIO()
        np.savez(out, order=self.order.astype(np.int32), **{f"layer{k}": a for k, a in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, x: np.ndarray) -> Graph:
        """A dumped graph over the vectors, in the order in which they were given."""
        held = np.load(io.BytesIO(data))
        self = cls.__new__(cls)
        self.order = held["order"]
        self.x = np.ascontiguousarray(x[self.order], np.float32)
        self.layers = [held[f"layer{k}"] for k in range(len(held.files) - 1)]
        return self
