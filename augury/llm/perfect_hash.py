"""Minimal perfect hash of a shard of 128-bit keys, with fingerprint and count arrays, in numpy."""
from __future__ import annotations

import io

import numpy as np

_U = np.uint64
_GAMMA = 2.0


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a + _U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) ^ (b * _U(0xD6E8FEB86659FD93))
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class PerfectHash:
    """Levels of bit arrays: a key sits at the first level where no other key shares its bit; its slot is the number of
    bits set before it. A fingerprint of 32 bits per slot turns away keys that were never indexed."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.words, self.starts, self.prints, self.counts = words, starts, prints, counts
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> "PerfectHash":
        """From distinct keys (a, b)."""
        levels, left = [], np.arange(len(a))
        while len(left):
            size = max(1, int(np.ceil(_GAMMA * len(left) / 64))) * 64
            at = (_mix(a[left], b[left], len(levels)) % _U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys repeat")
        starts = np.concatenate([[0], np.cumsum([len(x) for x in levels])]).astype(np.int64)
        out = cls(np.concatenate(levels) if levels else np.empty(0, np.uint64), starts, np.empty(0, np.uint32), np.empty(0, np.uint8))
        slot = out.slots(a, b)
        most = int(counts.max(initial=0))
        out.prints, out.counts = np.empty(len(a), np.uint32), np.empty(len(a), np.min_scalar_type(most))
        out.prints[slot], out.counts[slot] = cls._print(a, b), counts
        return out

    @staticmethod
    def _print(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (_mix(b, a, 1000) >> _U(32)).astype(np.uint32)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of every key; -1 where no level has its bit."""
        slot, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level in range(len(self.starts) - 1):
            if not len(left):
                break
            lo, n = self.starts[level], self.starts[level + 1] - self.starts[level]
            at = (_mix(a[left], b[left], level) % _U(n * 64)).astype(np.int64)
            word, bit = lo + (at >> 6), (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & _U(1) == 1
            w, i = word[hit], bit[hit]
            slot[left[hit]] = self.rank[w] + np.bitwise_count(self.words[w] & ((_U(1) << i) - _U(1)))
            left = left[~hit]
        return slot

    def count(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Count of every key, 0 for keys that were not indexed."""
        slot = self.slots(a, b)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == self._print(a[known], b[known])
        out = np.zeros(len(a), np.int64)
        out[known] = self.counts[slot[known]]
        return out

    def dumps(self) -> bytes:
        buf = io.BytesIO()
        np.savez(buf, words=self.words, starts=self.starts, prints=self.prints, counts=self.counts)
        return buf.getvalue()

    @classmethod
    def loads(cls, blob: bytes) -> "PerfectHash":
        x = np.load(io.BytesIO(blob))
        return cls(x["words"], x["starts"], x["prints"], x["counts"])
