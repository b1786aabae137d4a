"""Hashed n-grams of texts, in numpy."""

from __future__ import annotations

import numpy as np

from scorelens.llm.common import WordHashes


def byte_grams(raw: bytes, n: int, bits: int) -> np.ndarray:
    """Hash (``bits`` bits) of each run of n <= 4 bytes, in order; none if there are fewer bytes."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) < n:
        return np.zeros(0, np.int64)
    code = np.zeros(len(b) - n + 1, np.uint32)
    for k in range(n):
        code |= b[k : len(b) - n + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    return (code >> np.uint32(32 - bits)).astype(np.int64)


class QualityFeatures:
    """Which hashed n-grams a text has: 4-grams of bytes, words, and how much of it repeats.

    The last 64 numbers are indicators of shares (repeated word triples, different words, symbols,
    capitals) in steps of an eighth, so that repetition shows although each n-gram counts once."""

    def __init__(self, bits: int = 17):
        self.bits, self.size, self.words = bits, 2**bits + 64, WordHashes()
        self.seen = np.zeros(self.size, bool)

    def __call__(self, text: str) -> np.ndarray:
        raw = text.encode()
        self.seen[byte_grams(raw, 4, self.bits)] = True
        found = raw.split()
        if found:
            h = self.words.of(found)
            self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)] = True
            b = np.frombuffer(raw, np.uint8)
            shares = [len(np.unique(h)) / len(h), ((b >= 65) & (b <= 90)).mean(), (((b >= 33) & (b <= 47)) | ((b >= 58) & (b <= 64)) | ((b >= 91) & (b <= 96)) | ((b >= 123) & (b <= 126))).mean()]
            if len(h) > 2:
                t = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)
                shares.append(1 - len(np.unique(t)) / len(t))
            for i, share in enumerate(shares):
                self.seen[2**self.bits + 16 * i + min(15, int(share * 16))] = True
        at = np.flatnonzero(self.seen)
        self.seen[at] = False
        return at.astype(np.int32)
