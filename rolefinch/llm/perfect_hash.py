"""Minimal perfect hashing of 64-bit keys in numpy arrays."""

from __future__ import annotations

import numpy as np

from .text import mix

_STEP, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


class PerfectHash:
    """A slot from 0 to n - 1 for each of n different keys, and -1 for anything else.

    Each level throws the keys that are left into twice as many places and keeps those that lie alone, as a bit and a
    running count. A key's slot is the rank of its bit. The keys are stored by slot: a lookup is verified by them,
    and by ``second``, another 64 bits of each key, if given.
    """

    def __init__(self, keys: np.ndarray, second: np.ndarray | None = None):
        self.bits, self.rank, self.salt = [], [], []
        left, held, salt = np.arange(len(keys)), [], 1
        base = 0
        while len(left):
            m = -(-2 * len(left) // 64) * 64
            at = self._places(keys[left], salt, m)
            alone = np.bincount(at, minlength=m)[at] == 1
            if alone.any():
                places = at[alone]
                bits = np.zeros(m // 64, np.uint64)
                np.bitwise_or.at(bits, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
                count = np.bitwise_count(bits).astype(np.int64)
                self.bits.append(bits)
                self.rank.append(base + np.cumsum(count) - count)
                self.salt.append(salt)
                held.append(left[alone][np.argsort(places)])
                base += len(places)
                left = left[~alone]
            salt += 1
        order = np.concatenate(held) if held else left
        self.keys = keys[order]
        self.second = None if second is None else second[order]

    @staticmethod
    def _places(keys: np.ndarray, salt: int, m: int) -> np.ndarray:
        return (mix(keys + np.uint64(salt * _STEP & _MASK)) % np.uint64(m)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for bits, rank, salt in zip(self.bits, self.rank, self.salt):
            at = self._places(keys[left], salt, 64 * len(bits))
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            found = left[hit]
            slot = rank[at[hit] >> 6] + np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            same = self.keys[slot] == keys[found]
            if self.second is not None:
                same &= self.second[slot] == second[found]
            out[found[same]] = slot[same]
            left = left[~hit]
            if not len(left):
                break
        return out
