"""Independent checks of the scoring measures, from their written rules, with sorted arrays."""

from __future__ import annotations

import numpy as np


def gains(rows, bins=20):
    """rows: (key, y, score) ranked by score descending, then key.  Bin i ends at rank i * (n // bins)."""
    keys, y, scores = (np.array(c) for c in zip(*rows))
    ranked = np.lexsort((keys, -scores))
    bad, good = np.cumsum(y[ranked] == 1), np.cumsum(y[ranked] == 0)
    running = np.concatenate([[0.0], np.cumsum(scores[ranked])])
    size = len(rows) // bins
    out = []
    for i, end in enumerate(size * np.arange(1, bins + 1), 1):
        b, g = (int(bad[end - 1]), int(good[end - 1])) if end else (0, 0)
        share = [c / t if t else None for c, t in ((b, bad[-1]), (g, good[-1]))]
        mean = (running[end] - running[end - size]) / size if size else None
        out.append((i, b, g, *share, mean, None if None in share else abs(share[0] - share[1])))
    return out


def ks_auc(rows):
    """rows: (y, score).  KS from the two empirical distributions, AUC from rank sums (ties count half)."""
    y, scores = (np.array(c, float) for c in zip(*rows))
    one, zero = np.sort(scores[y == 1]), np.sort(scores[y == 0])
    below = [np.searchsorted(x, np.unique(scores), side="left") / len(x) for x in (one, zero)]
    wins = np.searchsorted(zero, one, side="left") + np.searchsorted(zero, one, side="right")
    return float(np.abs(below[0] - below[1]).max()), float(wins.sum() / (2 * len(one) * len(zero)))


def psi(dev, val, k=10):
    """Bands between the compared maximum, the base scores of descending rank m, 2m, ... (m = n // k) and
    the compared minimum; shares over all rows; an empty share costs 1.  Returns the sum and the compared shares."""
    base, other = np.sort(np.array(dev, float)), np.sort(np.array(val, float))
    ranks = len(base) - 1 - (len(base) // k) * np.arange(1, k)
    limits = np.concatenate([other[-1:], base[ranks], other[:1]])

    def shares(x):
        at_most, less = (np.searchsorted(x, limits, side=s) for s in ("right", "left"))
        lower = np.append(at_most[1:-1], less[-1])  # only the last band holds its lower limit
        return np.maximum(at_most[:-1] - lower, 0) / len(x)

    p, q = shares(base), shares(other)
    both = (p > 0) & (q > 0)
    return float(((p - q)[both] * np.log(p[both] / q[both])).sum() + (~both).sum()), q.tolist()
