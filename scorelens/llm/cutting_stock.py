"""Cutting stock by column generation: patterns of item lengths that fill bins, in numpy.

The input is a histogram of lengths, so its size does not depend on the number of items.
"""

from __future__ import annotations

import numpy as np


def best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the worth and the counts of the best filling."""
    order = np.argsort(lengths, kind="stable")
    sizes, worth = lengths[order], prices[order]
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if fits[c]:
            gains = value[c - sizes[: fits[c]]] + worth[: fits[c]]
            best = int(gains.argmax())
            if gains[best] > value[c] + 1e-12:
                value[c], choice[c] = gains[best], best
    counts, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[order[choice[c]]] += 1
            c -= int(sizes[choice[c]])
    return float(value[capacity]), counts


def fractional_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, most_rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, from the linear program.

    The simplex starts with one length to a pattern; the dual prices go to the knapsack, whose pattern
    enters while it is worth more than one bin.  Farley's bound stops it ``gap`` above the optimum."""
    columns = np.diag(capacity // lengths).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    used = demand / np.diag(columns)
    for _ in range(most_rounds):
        prices = inverse.sum(axis=0)
        worth, counts = best_pattern(lengths, prices, capacity)
        if worth <= 1 + 1e-9 or used.sum() * (1 - 1 / worth) <= max(gap * used.sum(), 0.5):
            break
        way = inverse @ counts
        ratio = np.where(way > 1e-9, used / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        used -= step * way
        used[out] = step
        columns[:, out] = counts
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        np.maximum(used, 0, out=used)
    return columns.astype(np.int64), used


def first_fit(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Bins of the items left over, longest first, each into the fullest bin that takes it."""
    free, bins = np.zeros(0, np.int64), []
    for i in np.argsort(-lengths, kind="stable"):
        for _ in range(int(demand[i])):
            fits = np.flatnonzero(free >= lengths[i])
            if len(fits):
                at = int(fits[free[fits].argmin()])
            else:
                at = len(bins)
                bins.append(np.zeros(len(lengths), np.int64))
                free = np.append(free, capacity)
            bins[at][i] += 1
            free[at] -= lengths[i]
    return bins


def plan(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(counts by length, bins) of patterns that use every item exactly once."""
    if not len(lengths):
        return []
    columns, used = fractional_patterns(lengths, demand.astype(float), capacity)
    whole = np.floor(used + 1e-7).astype(np.int64)
    out, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-whole, kind="stable"):
        counts = columns[:, j]
        fit = int(min([whole[j], *(left[counts > 0] // counts[counts > 0])]))
        if fit:
            out.append((counts, fit))
            left -= fit * counts
    return out + [(counts, 1) for counts in first_fit(lengths, left, capacity)]
