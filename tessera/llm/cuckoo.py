"""A cuckoo filter over 64-bit hashes that are inserted, looked up and deleted in batches."""

from __future__ import annotations

import struct

import numpy as np

from tessera.llm.shingles import U, mix

SLOTS = 4
_HEAD = struct.Struct("<QQ")


class CuckooFilter:
    """Buckets of four 16-bit fingerprints (0: free); a key may be in either of two buckets.

    ``lookup`` never misses a key that was inserted; it finds another key with probability about 8 / 65,535. A key that
    was inserted n times stays until it was deleted n times. Only keys that were inserted may be deleted.
    """

    #: Share of the slots beyond which a filter is built anew: under it nearly every key finds a slot.
    FULL = 0.8

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.stash: list[tuple[int, int]] = []

    @classmethod
    def of_size(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * cls.FULL))))))

    @property
    def room(self) -> int:
        """Keys it takes before it is full."""
        return int(self.buckets * SLOTS * self.FULL)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.astype(U, copy=False))
        prints = (h >> U(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (h & U(self.buckets - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return at ^ (mix(prints.astype(U)) & U(self.buckets - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        prints, first, second = self._places(keys)
        left = np.arange(len(keys))
        for place in (first, second):
            left = self._fill(left, place, prints)
        for i in left.tolist():
            self._kick(int(first[i]), int(prints[i]))

    def _fill(self, left: np.ndarray, place: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Puts what finds a free slot in its bucket; returns the rest."""
        order = left[np.argsort(place[left], kind="stable")]
        at = place[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at, "left")
        free = self.table[at] == 0
        # a key's slot is the free slot with its rank among the bucket's new keys
        nth = np.cumsum(free, axis=1)
        slot = np.argmax(free & (nth == (rank + 1)[:, None]), axis=1)
        fits = rank < nth[:, -1]
        self.table[at[fits], slot[fits]] = prints[order[fits]]
        return order[~fits]

    def _kick(self, at: int, p: int) -> None:
        for step in range(500):
            row = self.table[at]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = p
                return
            k = (step * 7 + at) % SLOTS
            row[k], p = p, int(row[k])
            at = int(self._other(np.array([at]), np.array([p], np.uint16))[0])
        self.stash.append((at, p))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        found = (self.table[first] == prints[:, None]).any(1) | (self.table[second] == prints[:, None]).any(1)
        for at, p in self.stash:
            found |= (prints == p) & ((first == at) | (second == at))
        return found

    def delete(self, keys: np.ndarray) -> None:
        for p, *places in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for at in places:
                slot = np.flatnonzero(self.table[at] == p)
                if len(slot):
                    self.table[at, slot[0]] = 0
                    break
            else:
                hit = next((x for x in self.stash if x[1] == p and x[0] in places), None)
                if hit is None:
                    raise KeyError("a key that was never inserted can't be deleted")
                self.stash.remove(hit)

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.buckets, len(self.stash)) + b"".join(_HEAD.pack(*x) for x in self.stash) + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets, stashed = _HEAD.unpack_from(data)
        at = _HEAD.size * (1 + stashed)
        out = cls(buckets, np.frombuffer(data, np.uint16, offset=at).reshape(buckets, SLOTS).copy())
        out.stash = [_HEAD.unpack_from(data, _HEAD.size * (1 + k)) for k in range(stashed)]
        return out
