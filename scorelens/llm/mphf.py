"""Minimal perfect hash of 128-bit keys with numpy: levels of bitmaps and ranks.

Level l gives each key left over a slot; slots that exactly one key takes are
set, the others' keys go to the next level.  The rank of a key's bit is its
number, so n keys get the numbers 0 to n-1 without storing the keys.
"""

from __future__ import annotations

import numpy as np

from scorelens.llm.common import mix64

GAMMA = 1.6  # slots per key left
MAX_LEVELS = 200


def _slots(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(a + b * np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64)


def build(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the levels and their bits, one byte each; (a, b) must be distinct pairs."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    sizes, bits = [], []
    while len(a):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("keys are not distinct")
        size = max(1, int(GAMMA * len(a)))
        slots = _slots(a, b, len(sizes), size)
        taken = np.bincount(slots, minlength=size) == 1
        sizes.append(size)
        bits.append(taken)
        left = ~taken[slots]
        a, b = a[left], b[left]
    return np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool)


class Lookup:
    """Numbers of keys; a key that was not indexed gets any number or -1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        found = np.full(len(a), -1, np.int64)
        left, base = np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = base + _slots(a[left], b[left], level, int(size))
            hit = self.bits[at]
            found[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + int(size)
        return found
