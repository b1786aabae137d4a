"""Penalised boosting against a plain restatement of one tree and of the scores."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from scorelens.operators import boosting as B
from scorelens.operators.model import gbt_pipeline, score_rows


def _data(spark, n=600, seed=2):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)), 2)
    y = (x[:, 0] + 0.5 * (x[:, 1] > 0.3) + r.normal(scale=0.7, size=n) > 0.4).astype(int)
    rows = [(i, *map(float, x[i]), int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, target int").repartition(4)
    return x, y, df


def _fit(df, **params):
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="_features").transform(df)
    gbt = B.PenalisedGBT(**params)
    return gbt, gbt.fit(v), v


def _grow(x, g, h, cuts, depth, p):
    """One tree by trying every cut on the rows themselves: nested dicts."""
    score = lambda rows: p.score(g[rows].sum(), h[rows].sum())
    best = (1e-9, None, None)
    for f in range(x.shape[1]):
        for c in cuts[f]:
            left = x[:, f] <= c
            if h[left].sum() < 1 or h[~left].sum() < 1:
                continue
            gain = (score(left) + score(~left) - score(np.ones(len(x), bool))) / 2
            if gain > best[0] + 1e-9:
                best = (gain, f, c)
    if depth == 0 or best[1] is None:
        return {"value": float(p.leaf(g.sum(), h.sum()))}
    left = x[:, best[1]] <= best[2]
    return {"split": best[1:], "left": _grow(x[left], g[left], h[left], cuts, depth - 1, p), "right": _grow(x[~left], g[~left], h[~left], cuts, depth - 1, p)}


def _walk(tree, row):
    while "split" in tree:
        f, c = tree["split"]
        tree = tree["left"] if row[f] <= c else tree["right"]
    return tree["value"]


@pytest.mark.parametrize("alpha,lam", [(0.0, 1.0), (3.0, 0.01), (0.01, 20.0)])
def test_one_tree_against_plain_search(spark, alpha, lam):
    x, y, df = _data(spark)
    gbt, model, v = _fit(df, n_estimators=1, max_depth=2, learning_rate=1.0, reg_alpha=alpha, reg_lambda=lam, bins=16)
    cuts = []
    for f in range(3):
        q = np.quantile(x[:, f], [k / 16 for k in range(1, 16)])
        cuts.append(sorted({float(c) for c in q if x[:, f].min() <= c < x[:, f].max()}))
    g, h = 0.5 - y, np.full(len(y), 0.25)
    tree = _grow(x, g, h, cuts, 2, B.Penalties(alpha, lam))
    want = [1 / (1 + math.exp(-_walk(tree, r))) for r in x]
    got = {r["row_id"]: r["probability"][1] for r in model.transform(v).select("row_id", "probability").collect()}
    assert np.allclose([got[i] for i in range(len(y))], want, atol=1e-7)


def test_scores_add_up_over_stored_margins(spark, monkeypatch):
    x, y, df = _data(spark)
    monkeypatch.setattr(B, "STORE_EVERY", 3)
    gbt, model, v = _fit(df, n_estimators=8)
    assert len(gbt.trees) == 8 and model.getNumTrees == 8
    p = np.array([r["probability"][1] for r in model.transform(v).orderBy("row_id").collect()])
    loss = lambda q: -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))
    assert loss(p) < loss(np.full(len(y), y.mean()))
    monkeypatch.setattr(B, "STORE_EVERY", 100)
    monkeypatch.setattr(B, "DIRECT_PARTS", 0)  # histograms summed by cell in a shuffle
    again = _fit(df, n_estimators=8)[1].transform(v).orderBy("row_id").collect()
    assert np.allclose(p, [r["probability"][1] for r in again], atol=1e-12)
    assert abs(sum(model.featureImportances.toArray()) - 1) < 1e-9


def test_penalties_shrink_and_prune(spark):
    _, _, df = _data(spark)
    spread = lambda m, v: np.ptp([r["probability"][1] for r in m.transform(v).collect()])
    _, free, v = _fit(df, n_estimators=3, reg_alpha=0.0, reg_lambda=0.0)
    assert spread(_fit(df, n_estimators=3, reg_alpha=0.0, reg_lambda=200.0)[1], v) < spread(free, v)
    none, flat, _ = _fit(df, n_estimators=3, reg_alpha=1e6)
    assert none.trees == [] and spread(flat, v) == 0


def test_subsample_missing_values_and_empty_tables(spark):
    _, _, df = _data(spark)
    holes = df.selectExpr("row_id", "if(row_id % 5 = 0, null, a) as a", "b", "c", "if(row_id % 50 = 0, null, target) as target")
    pipeline = gbt_pipeline(["a", "b", "c"], n_estimators=4, subsample=0.5)
    model = pipeline.fit(holes)
    a, b = (sorted(map(tuple, score_rows(m, holes).select("row_id", "model_score").collect())) for m in (model, pipeline.fit(holes)))
    assert a == b and all(0 < p < 1 for _, p in a)
    assert _fit(df.limit(0), n_estimators=2)[0].trees == [] and _fit(df.where("target = 1"), n_estimators=2)[0].trees == []
    with pytest.raises(ValueError):
        B.PenalisedGBT(reg_alpha=-1)
    with pytest.raises(ValueError):
        gbt_pipeline(["a"], reg_alpha=None, reg_lambda=None, min_child_weight=3)


@pytest.mark.parametrize("by_mask", [0, 100])
def test_nodes_of_rows_are_those_of_a_plain_walk(monkeypatch, by_mask):
    monkeypatch.setattr(B, "NODES_BY_MASK", by_mask)
    r = np.random.default_rng(5)
    bins = r.integers(0, 32, (4, 300)).astype(np.uint8)
    for depth in (1, 3, 8):
        size = 2 ** (depth + 1) - 1
        tree = B.Tree(np.full(size, -1), r.integers(0, 32, size), np.zeros(size), np.zeros(size), np.zeros(size))
        for k in range(2**depth - 1):
            if (k == 0 or tree.feature[(k - 1) // 2] >= 0) and r.random() < 0.9:
                tree.feature[k] = r.integers(0, 4)
        for levels in range(depth + 1):
            want = []
            for row in bins.T:
                k = 0
                for _ in range(levels):
                    if tree.feature[k] >= 0:
                        k = 2 * k + 1 + int(row[tree.feature[k]] > tree.cut[k])
                want.append(k)
            assert tree.nodes(bins, levels).tolist() == want


def test_only_the_lighter_child_is_summed(spark, monkeypatch):
    _, _, df = _data(spark)
    plain, passes = B._histograms, []

    def watched(*args):
        passes.append((args[2], len(args[3])))
        return plain(*args)

    monkeypatch.setattr(B, "_histograms", watched)
    gbt, _, _ = _fit(df, n_estimators=2, max_depth=3)
    assert len(gbt.trees) == 2 and passes[:3] == [(0, 1), (1, 1), (2, 2)]
    for tree in gbt.trees:  # what the children hold is what their parent holds
        for k in np.flatnonzero(tree.feature >= 0):
            assert abs(tree.weight[2 * k + 1] + tree.weight[2 * k + 2] - tree.weight[k]) < 1e-6
