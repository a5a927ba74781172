"""A cuckoo filter over 64-bit keys whose inserts, look-ups and deletes take whole arrays.

Four 16-bit fingerprints a bucket; a key may lie in either of two buckets, the second one found
from the first and the fingerprint. A key must be inserted once and deleted only if present,
which the exact tables behind the filter see to.
"""

from __future__ import annotations

import struct

import numpy as np

from .grams import mix

SLOTS = 4
U = np.uint64


class Cuckoo:
    def __init__(self, buckets: int = 64, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16) if table is None else table

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        """Room for `n` keys at three quarters full."""
        return cls(1 << max(4, int(np.ceil(np.log2(max(n, 1) / (0.75 * SLOTS))))))

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        """A filter of these keys; it grows until all find a place."""
        f = cls.sized(len(keys))
        while not f.insert(keys):
            f = cls(2 * len(f.table))
        return f

    def dump(self) -> bytes:
        return struct.pack("<q", len(self.table)) + self.table.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> Cuckoo:
        n = struct.unpack("<q", blob[:8])[0]
        return cls(table=np.frombuffer(blob[8:], dtype=np.uint16).reshape(n, SLOTS).copy())

    def _places(self, keys: np.ndarray):
        h = mix(keys.astype(np.int64).view(U))
        mark = ((h >> U(48)) % U(65535) + U(1)).astype(np.uint16)
        one = (h & U(len(self.table) - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(U)) & U(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray, rounds: int = 300) -> bool:
        """False if some key found no place; the filter is then to be rebuilt larger."""
        rng = np.random.default_rng(len(keys))
        mark, at, _ = self._places(keys)
        for _ in range(rounds):
            if not len(mark):
                return True
            order = np.argsort(at, kind="stable")
            at, mark = at[order], mark[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            full = self.table[at] != 0
            fits = rank < SLOTS - full.sum(1)
            slot = np.argsort(full[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
            self.table[at[fits], slot] = mark[fits]
            at, mark = at[~fits], mark[~fits]
            # in each bucket one waiting key throws out another; the rest try their other bucket
            head = np.ones(len(at), dtype=bool)
            head[1:] = at[1:] != at[:-1]
            slot = rng.integers(0, SLOTS, head.sum())
            out = self.table[at[head], slot].copy()
            self.table[at[head], slot] = mark[head]
            mark[head] = out
            at = self._other(at, mark)
        return not len(mark)

    def delete(self, keys: np.ndarray) -> None:
        mark, one, two = self._places(keys)
        for at in (one, two):
            while True:
                hit = np.flatnonzero((self.table[at] == mark[:, None]).any(1) & (mark != 0))
                if not len(hit):
                    break
                slot = np.argmax(self.table[at[hit]] == mark[hit][:, None], axis=1)
                _, first = np.unique(at[hit] * SLOTS + slot, return_index=True)
                hit, slot = hit[first], slot[first]
                self.table[at[hit], slot] = 0
                mark[hit] = 0
