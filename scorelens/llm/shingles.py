"""Word shingles, MinHash signatures and the sequential Bayesian comparison, in numpy."""

from __future__ import annotations

import functools
import math

import numpy as np

from scorelens.llm.common import WordHashes, mix64

_ODD = (np.random.default_rng(20240229).integers(0, 2**63, 64, dtype=np.uint64) << np.uint64(1)) + np.uint64(1)


def shingle_set(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words (A-Z lower-cased); fewer words
    are one shingle, no word is none."""
    found = text.encode().lower().split() if text else []  # bytes: ASCII case and white space only
    if not found:
        return np.zeros(0, np.uint64)
    h = words.of(found)
    k = min(size, len(h))
    n = len(h) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc += mix64(h[j : j + n]) * _ODD[j]
    return np.unique(mix64(acc))


def banding(least: float, miss: float = 1e-6, most: int = 200) -> tuple[int, int]:
    """(bands, rows): most rows a band with ``most`` hashes at which a pair of similarity ``least``
    shares no band with probability ``miss`` at most."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(least**rows)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding within the hashes")


@functools.lru_cache(8)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(7).integers(0, 2**32, (2, n), dtype=np.uint32)
    return (draw[0] | np.uint32(1))[:, None], draw[1][:, None]


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of n hash functions over a set that is not empty."""
    a, b = _functions(n)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 8192):
        np.minimum(least, (a * x[None, i : i + 8192] + b).min(axis=1), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
    return mix64((parts * _ODD[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _ODD[40])


@functools.lru_cache(8)
def looks(n: int, least: float, miss: float, batch: int = 32) -> tuple[tuple[int, int, int], ...]:
    """(start, stop, matches needed so far) of each batch: with fewer, the posterior probability (flat
    prior) that the similarity is ``least`` or more is under ``miss``."""
    out = []
    for stop in [*range(batch, n, batch), n]:
        total, needed = 0.0, 0
        for m in range(stop + 2):  # P(Beta(m+1, stop-m+1) >= least) = P(Bin(stop+1, least) <= m)
            total += math.comb(stop + 1, m) * least**m * (1 - least) ** (stop + 1 - m)
            if total >= miss:
                needed = m
                break
        out.append((out[-1][1] if out else 0, stop, needed))
    return tuple(out)


def survivors(one: np.ndarray, others: np.ndarray, least: float, miss: float) -> np.ndarray:
    """Rows of ``others`` whose signatures may reach similarity ``least`` with ``one``, batch by batch."""
    left, matches = np.arange(len(others)), np.zeros(len(others), np.int32)
    for start, stop, needed in looks(others.shape[1], least, miss):
        matches = matches + (others[left, start:stop] == one[start:stop]).sum(axis=1)
        on = matches >= needed
        left, matches = left[on], matches[on]
        if not len(left):
            break
    return left


def similar(one: np.ndarray, sets: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``rows`` have 100 * intersection >= percent * union with the sorted set ``one``, exactly."""
    lengths = sizes[rows]
    able = 100 * np.minimum(lengths, len(one)) >= percent * np.maximum(lengths, len(one))
    out = np.zeros(len(rows), bool)
    for at in np.flatnonzero(able):
        other = sets[starts[rows[at]] : starts[rows[at]] + sizes[rows[at]]]
        found = one[np.minimum(np.searchsorted(one, other), len(one) - 1)] == other
        both = int(found.sum())
        out[at] = 100 * both >= percent * (len(one) + len(other) - both)
    return out


def link_group(sigs: np.ndarray, least: float, miss: float, verify=None) -> list[tuple[int, int]]:
    """Edges that join all members whose pairs pass, without listing the pairs.

    One member after another leads: it is compared with all members that have not led and are not yet
    in its component.  So each pair is compared or already joined.  ``verify(leader, rows)`` tells
    which survivors are links; without it all are."""
    label, edges = np.arange(len(sigs)), []
    for leader in range(len(sigs)):
        if (label[leader:] == label[leader]).all():
            break
        rows = leader + np.flatnonzero(label[leader:] != label[leader])
        rows = rows[survivors(sigs[leader], sigs[rows], least, miss)]
        if verify is not None and len(rows):
            rows = rows[verify(leader, rows)]
        if len(rows):
            found, first = np.unique(label[rows], return_index=True)
            edges += [(leader, int(rows[i])) for i in first]
            label[np.isin(label, found)] = label[leader]
    return edges
