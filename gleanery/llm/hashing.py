"""64-bit hashes of runs of bytes, in numpy, and a table from such hashes to numbers."""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 18
_PLACES = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WEIGHT = mix(np.arange(1, _PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] of each run. Runs are in order, not empty and don't overlap; memory is bounded but for a run longer than CHUNK."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        first, s, e = int(starts[a]), starts[a:b] - starts[a], ends[a:b] - starts[a]
        part = data[first : int(ends[b - 1])]
        place = np.arange(len(part)) - np.repeat(s, np.diff(np.append(s, len(part))))
        weight = _WEIGHT[place & (_PLACES - 1)]
        if int((e - s).max()) > _PLACES:
            weight = weight * (2 * (place >> 16) + 1).astype(np.uint64)
        edges = np.empty(2 * len(s), np.int64)
        edges[::2], edges[1::2] = s, e
        terms = (part.astype(np.uint64) + np.uint64(1)) * weight
        sums = np.add.reduceat(terms, edges[:-1])[::2]
        out[a:b] = mix(sums + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        a = b
    return out


class HashTable:
    """Numbers hashes from 0, in the order in which they are added. Open addressing; at most 2**bits / 2 of them."""

    def __init__(self, bits: int = 22):
        self.bits, self.mask = bits, (1 << bits) - 1
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.n = 0

    def room(self, more: int) -> bool:
        return self.n + more <= 1 << (self.bits - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it isn't known."""
        hashes = np.maximum(hashes, np.uint64(1))
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == hashes, self.values[slot], np.int32(-1)).astype(np.int64)
        left = np.flatnonzero((key != hashes) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            key = self.keys[slot[left]]
            hit = key == hashes[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """New, distinct hashes."""
        hashes = np.maximum(hashes, np.uint64(1))
        number = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = self.keys[slot[left]] == 0
            tried = left[free]
            self.keys[slot[tried]] = hashes[tried]  # of several, one stays
            won = np.zeros(len(left), bool)
            won[free] = self.keys[slot[tried]] == hashes[tried]
            done = left[won]
            self.values[slot[done]] = number[done]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask
        self.n += len(hashes)
