"""Exact neighbours against all pairs, and what the bounds save."""

import numpy as np
import pytest

from scorelens.operators.neighbours import knn


def _check(spark, x, k, **options):
    names = [f"f{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(x)], "pid long, " + ", ".join(f"{c} double" for c in names))
    counts: dict = {}
    got: dict = {}
    for r in knn(df, names, k, counts=counts, **options).collect():
        got.setdefault(r["pid"], []).append((r["r"], r["cid"], r["d"]))
    d = np.zeros((len(x), len(x)))
    for i in range(x.shape[1]):
        d += (x[:, i, None] - x[None, :, i]) ** 2
    d = np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        want = [(int(j), d[i, j]) for j in np.lexsort((np.arange(len(x)), d[i]))[:k] if np.isfinite(d[i, j])]
        assert [(c, v) for _, c, v in sorted(got.get(i, []))] == want
    return counts


@pytest.mark.parametrize("dim", [2, 8, 20])
def test_exact_in_any_dimension(spark, dim):
    r = np.random.default_rng(dim)
    centres = r.normal(size=(6, dim)) * 8
    x = np.round(np.concatenate([c + r.normal(size=(60, dim)) * s for c, s in zip(centres, (1, 1, 0.2, 0.05, 2, 1))]), 3)
    x = np.unique(x, axis=0)
    counts = _check(spark, x, 5, cell_size=24)
    assert counts["points"] == len(x) and counts["candidates"] < 0.6 * len(x) ** 2


def test_ties_by_id_and_few_points(spark):
    grid = np.array([[i, j] for i in range(12) for j in range(12)], float)
    _check(spark, grid, 5, cell_size=10)
    _check(spark, grid[:4], 5)
    _check(spark, grid[:1], 3)


def test_points_away_from_the_other_cell_are_not_compared(monkeypatch):
    from scorelens.operators import neighbours as N

    r = np.random.default_rng(7)
    a, b = np.round(r.random((200, 2)), 2), np.round(r.random((200, 2)) + [0.95, 0], 2)
    ids, limit = r.permutation(200), np.full(200, 0.1)
    plain, sizes = N._pairwise, []

    def watched(x, y):
        sizes.append(len(x) * len(y))
        return plain(x, y)

    monkeypatch.setattr(N, "_pairwise", watched)
    got = sorted(zip(*(x.tolist() for x in N._nearest(a, limit, b, ids, 3, False))))
    d = plain(a, b)
    want = sorted((i, int(j), d[i, j]) for i in range(200) for j in np.lexsort((ids, d[i]))[:3] if d[i, j] <= 0.1)
    assert got == want and want and sum(sizes) < 0.1 * 200 * 200
