"""A robust-pruned directed graph over the vectors of one shard, in numpy; all steps work on blocks of points at once."""
from __future__ import annotations

import io

import numpy as np


class PrunedGraph:
    """``vecs`` (n, d) in their original type, ``nbrs`` (n, degree) padded with -1, and ``ids``: of every distinct vector
    the smallest row ids that carry it."""

    def __init__(self, vecs: np.ndarray, nbrs: np.ndarray, entry: int, ids: np.ndarray, starts: np.ndarray):
        self.vecs, self.nbrs, self.entry, self.ids, self.starts = vecs, nbrs, entry, ids, starts
        self.x = vecs.astype(np.float32)
        self.norms = np.einsum("ij,ij->i", self.x, self.x)

    @classmethod
    def build(cls, vecs: np.ndarray, ids: np.ndarray, starts: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, block: int = 256, seed: int = 1) -> "PrunedGraph":
        """Two passes in random order: a greedy search from the entry proposes what it met, pruning keeps near and
        diverse neighbours (``alpha`` 1, then relaxed), and every edge is offered back to its target."""
        n, rng = len(vecs), np.random.default_rng(seed)
        d = min(degree, n - 1)
        nbrs = np.full((n, degree), -1, np.int64)
        if d > 0:
            picks = rng.integers(0, n - 1, (n, d)) if n - 1 > degree else np.tile(np.arange(n - 1), (n, 1))
            nbrs[:, :d] = picks + (picks >= np.arange(n)[:, None])
        g = cls(vecs, nbrs, 0, ids, starts)
        g.entry = int(np.argmin(((g.x - g.x.mean(axis=0)) ** 2).sum(axis=1))) if n else 0
        if n - 1 > degree:
            for a in (1.0, alpha):
                order = rng.permutation(n)
                for at in range(0, n, block):
                    p = order[at:at + block]
                    near, _, met = g._greedy(g.x[p], beam)
                    g._link(p, np.concatenate([near, met, g.nbrs[p]], axis=1), a)
        return g

    def _dist(self, q: np.ndarray, qn: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of q (b, d) to points at (b, m)."""
        return np.maximum(qn[:, None] + self.norms[at] - 2 * np.matmul(self.x[at], q[:, :, None])[:, :, 0], 0)

    def _greedy(self, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beam search of every row of ``q`` in step: the beam (ids, squared distances, nearest first, -1 beyond the
        points found) and all points that were expanded."""
        b, n = len(q), len(self.x)
        qn = np.einsum("ij,ij->i", q, q)
        ids, dist = np.full((b, beam), -1, np.int64), np.full((b, beam), np.inf, np.float32)
        done, seen = np.ones((b, beam), bool), np.zeros((b, n), bool)
        ids[:, 0], done[:, 0], seen[:, self.entry] = self.entry, False, True
        dist[:, 0] = self._dist(q, qn, np.full((b, 1), self.entry))[:, 0]
        met = []
        while True:
            live = np.flatnonzero(~done.all(axis=1))
            if not len(live):
                break
            pick = np.argsort(done[live], axis=1, kind="stable")[:, :width]
            r = live[:, None]
            fresh = ~done[r, pick]
            cur = np.where(fresh, ids[r, pick], -1)
            done[r, pick] = True
            step = np.full((b, width), -1, np.int64)
            step[live] = cur
            met.append(step)
            new = np.where(cur[:, :, None] >= 0, self.nbrs[cur], -1).reshape(len(live), -1)
            new[(new >= 0) & seen[r, new]] = -1
            new = -np.sort(-new, axis=1)  # a point that two expanded ones propose counts once
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            rows, cols = np.nonzero(new >= 0)
            seen[live[rows], new[rows, cols]] = True
            dn = np.where(new >= 0, self._dist(q[live], qn[live], new), np.inf).astype(np.float32)
            all_d, all_i = np.concatenate([dist[live], dn], axis=1), np.concatenate([ids[live], new], axis=1)
            all_done = np.concatenate([done[live], new < 0], axis=1)
            top = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            top = np.take_along_axis(top, np.argsort(np.take_along_axis(all_d, top, 1), axis=1, kind="stable"), 1)
            dist[live], ids[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_d, all_i, all_done))
        return ids, dist, np.concatenate(met, axis=1)

    def _prune(self, p: np.ndarray, cand: np.ndarray, alpha: float) -> np.ndarray:
        """Neighbours for ``p`` from ``cand`` (b, m; -1 is none): nearest first, each removing those it is nearer to by
        ``alpha`` than ``p`` is."""
        cand = np.where(cand == p[:, None], -1, -np.sort(-cand, axis=1) if cand.shape[1] > 1 else cand)
        cand = -np.sort(-cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        d = np.where(cand >= 0, self._dist(self.x[p], self.norms[p], cand), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
        used = max(1, int((cand >= 0).sum(axis=1).max()))
        cand, d = cand[:, :used], d[:, :used]
        v = self.x[cand]
        vn = self.norms[cand]
        between = vn[:, :, None] + vn[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive, out, rows = cand >= 0, np.full((len(p), self.nbrs.shape[1]), -1, np.int64), np.arange(len(p))
        for k in range(out.shape[1]):
            first = alive.argmax(axis=1)
            ok = alive[rows, first]
            if not ok.any():
                break
            out[ok, k] = cand[rows, first][ok]
            alive &= alpha * alpha * between[rows, first] > d
            alive[rows, first] = False
        return out

    def _link(self, p: np.ndarray, cand: np.ndarray, alpha: float) -> None:
        self.nbrs[p] = self._prune(p, cand, alpha)
        src, tgt = np.repeat(p, self.nbrs.shape[1]), self.nbrs[p].ravel()
        src, tgt = src[tgt >= 0], tgt[tgt >= 0]
        order = np.argsort(tgt, kind="stable")
        src, tgt = src[order], tgt[order]
        into, start, count = np.unique(tgt, return_index=True, return_counts=True)
        # Offers in groups of like size, so that one hub does not widen the block of all.
        by = np.argsort(count, kind="stable")
        for at in range(0, len(by), 256):
            own = by[at:at + 256]
            offer = np.full((len(own), int(count[own].max())), -1, np.int64)
            for i, j in enumerate(own):
                offer[i, :count[j]] = src[start[j]:start[j] + count[j]]
            t = into[own]
            both = np.concatenate([self.nbrs[t], offer], axis=1)
            offer[(offer[:, :, None] == self.nbrs[t][:, None, :]).any(axis=2)] = -1
            total = (self.nbrs[t] >= 0).sum(axis=1) + (offer >= 0).sum(axis=1)
            fits = total <= self.nbrs.shape[1]
            if fits.any():
                merged = np.concatenate([self.nbrs[t[fits]], offer[fits]], axis=1)
                self.nbrs[t[fits]] = -np.sort(-merged, axis=1)[:, :self.nbrs.shape[1]]
            if (~fits).any():
                self.nbrs[t[~fits]] = self._prune(t[~fits], both[~fits], alpha)

    def search(self, q: np.ndarray, k: int, beam: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of every query the ``k`` nearest row ids found and their Euclidean distances in double precision."""
        near, _, _ = self._greedy(q.astype(np.float32), max(beam, k))
        out = []
        for row, v in zip(near, q.astype(np.float64)):
            at = row[row >= 0]
            d = np.sqrt(((self.vecs[at].astype(np.float64) - v) ** 2).sum(axis=1))
            n = self.starts[at + 1] - self.starts[at]
            ids = np.concatenate([self.ids[self.starts[i]:self.starts[i + 1]] for i in at])
            d = np.repeat(d, n)
            best = np.lexsort((ids, d))[:k]
            out.append((ids[best], d[best]))
        return out

    def dumps(self) -> bytes:
        buf = io.BytesIO()
        np.savez(buf, vecs=self.vecs, nbrs=self.nbrs.astype(np.int32), entry=np.int64(self.entry), ids=self.ids, starts=self.starts)
        return buf.getvalue()

    @classmethod
    def loads(cls, blob: bytes) -> "PrunedGraph":
        x = np.load(io.BytesIO(blob))
        return cls(x["vecs"], x["nbrs"].astype(np.int64), int(x["entry"]), x["ids"], x["starts"])
