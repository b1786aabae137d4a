"""Boosted trees with L1 and L2 leaf penalties, grown from second-order histograms.

MLlib's boosting has no penalties.  Here each level of a tree is one pass over the binned rows: tasks sum
gradients and curvatures by (node, feature, bin), and the split of each node is the one of largest gain

    score(G, H) = max(|G| - alpha, 0)^2 / (H + lambda),   gain = (score(left) + score(right) - score(node)) / 2

with leaf values -sign(G) max(|G| - alpha, 0) / (H + lambda).  The leaves of the last level follow from the
histograms of the level before.  Sums are whole numbers (fixed point), so they don't depend on the order
of tasks.  Of two children the rows of the lighter one are summed; the other's sums are what it leaves of its
parent's, which is exact with whole numbers.  The result is an MLlib model: scoring, importances and saving
stay MLlib's.

Rows stand in blocks of at most ``BLOCK`` rows (bins as bytes, a feature after the other, margins, labels).  A histogram has
nodes x features x bins cells whatever the number of rows; with many partitions the tasks' histograms are
summed by cell in a shuffle before they come to the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.plans.broadcast import materialize
from scorelens.plans.selection import column_spans, select_quantiles
from scorelens.session import scratch_path

BLOCK = 65_536
STORE_EVERY = 20  # trees between two writings of the margins
TASK_ROWS = 16_384  # rows a task holds at least
NODES_BY_MASK = 32  # up to so many splits of a level are applied one by one, to all rows
DIRECT_PARTS = 64  # up to so many partitions send their histograms to the driver themselves


@dataclass
class Tree:
    """Node k has children 2k + 1 and 2k + 2; feature -1 marks a leaf.  A row goes left if its bin is at most ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    weight: np.ndarray

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row (``bins``: features x rows) after at most ``levels`` steps."""
        kind = np.min_scalar_type(len(self.feature))
        at = np.zeros(bins.shape[1], kind)
        for level in range(levels):
            first = 2**level - 1
            splits = first + np.flatnonzero(self.feature[first : 2 * first + 1] >= 0)
            if len(splits) <= NODES_BY_MASK:
                for k in splits.tolist():
                    here = at == k
                    right = here & (bins[self.feature[k]] > self.cut[k])
                    at += here * kind.type(k + 1)  # to 2k + 1, or one more
                    at += right
            else:
                f = self.feature[at]
                step = 2 * at.astype(np.int64) + 1 + (bins[np.maximum(f, 0), np.arange(len(at))] > self.cut[at])
                at = np.where(f >= 0, step, at).astype(kind)
        return at


@dataclass
class Penalties:
    alpha: float = 0.0
    lambda_: float = 1.0
    min_gain: float = 0.0
    min_child_weight: float = 1.0

    def reduced(self, g):
        return np.sign(g) * np.maximum(np.abs(g) - self.alpha, 0.0)

    def score(self, g, h):
        return self.reduced(g) ** 2 / np.maximum(h + self.lambda_, 1e-300)

    def leaf(self, g, h):
        return -self.reduced(g) / np.maximum(h + self.lambda_, 1e-300)


def best_split(g: np.ndarray, h: np.ndarray, cuts: list[int], p: Penalties):
    """(gain, feature, cut, left sums, right sums) of one node from its histograms (features x bins), None without a
    gain.  Ties go to the first feature and the lowest cut."""
    best = None
    for f, n in enumerate(cuts):
        if not n:
            continue
        lg, lh = np.cumsum(g[f])[:n], np.cumsum(h[f])[:n]
        G, H = g[f].sum(), h[f].sum()
        gain = (p.score(lg, lh) + p.score(G - lg, H - lh) - p.score(G, H)) / 2 - p.min_gain
        gain = np.where((lh >= p.min_child_weight) & (H - lh >= p.min_child_weight), gain, -np.inf)
        c = int(gain.argmax())
        if gain[c] > 1e-12 and (best is None or gain[c] > best[0]):
            best = (float(gain[c]), f, c, (lg[c], lh[c]), (G - lg[c], H - lh[c]))
    return best


def _blocks(edges: list[list[float]]):
    """Rows (x array, y) to blocks (bins, margin, y).  A value's bin is the number of edges below it, all of them for a
    missing value (NaN)."""
    n_features = len(edges)

    def emit(held):
        table = pa.Table.from_batches(held)
        y = table.column("y").to_numpy().astype(np.float64)
        x = np.concatenate([b.column("x").flatten().to_numpy(zero_copy_only=False) for b in held]).reshape(-1, n_features)
        bins = np.stack([np.searchsorted(np.array(e, float), v) for e, v in zip(edges, x.T)]).astype(np.uint8)
        for s in range(0, len(y), BLOCK):
            part = slice(s, s + BLOCK)
            yield pa.record_batch([pa.array([bins[:, part].tobytes()]), pa.array([np.zeros(len(y[part])).tobytes()]), pa.array([y[part].tobytes()])], names=["bins", "margin", "y"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= BLOCK:
                yield from emit(held)
                held, n = [], 0
        if held:
            yield from emit(held)

    return run


def _arrays(batch, n_features):
    for block, bins, margin, y in zip(*(batch.column(c).to_pylist() for c in ("block", "bins", "margin", "y"))):
        yield block, np.frombuffer(bins, np.uint8).reshape(n_features, -1), np.frombuffer(margin, np.float64), np.frombuffer(y, np.float64)


def _added(margin: np.ndarray, trees: list[Tree], bins: np.ndarray, depth: int) -> np.ndarray:
    more = np.zeros(len(margin))
    for t in trees:
        more += t.value[t.nodes(bins, depth)]
    return margin + more


def _histograms(trees: list[Tree], depth: int, level: int, counted: list[int], growing: Tree | None, n_features: int, n_bins: int, scale: float, subsample: float, seed: int):
    """Task: fixed-point sums (2 x ``counted`` nodes of the level x features x bins), one row."""
    width = len(counted)

    def run(batches):
        total = np.zeros((2, width, n_features, n_bins), np.int64)
        slot = np.full(2 ** (level + 1), -1)
        slot[counted] = np.arange(width) * n_bins
        for batch in batches:
            for block, bins, margin, y in _arrays(batch, n_features):
                base = slot[growing.nodes(bins, level)]
                here = base >= 0
                if subsample < 1.0:
                    here &= np.random.default_rng([seed, block]).random(len(y)) < subsample
                if not here.all():
                    rows = np.flatnonzero(here)
                    bins, margin, y, base = bins.take(rows, axis=1), margin[rows], y[rows], base[rows]
                p = 1 / (1 + np.exp(-_added(margin, trees, bins, depth)))
                g, h = np.rint((p - y) * scale), np.rint(p * (1 - p) * scale)
                for f in range(n_features):
                    cell = base + bins[f]
                    for k, x in enumerate((g, h)):
                        total[k, :, f] += np.bincount(cell, x, width * n_bins).astype(np.int64).reshape(width, n_bins)
        yield pa.record_batch([pa.array([total.tobytes()])], names=["sums"])

    return run


def _summed(blocks: DataFrame, parts: int, task, shape) -> np.ndarray:
    partial = blocks.mapInArrow(task, "sums binary")
    if parts <= DIRECT_PARTS:
        rows = [np.frombuffer(r["sums"], np.int64) for r in partial.collect()]
        return np.sum(rows, axis=0, dtype=np.int64).reshape(shape) if rows else np.zeros(shape, np.int64)

    def cells(batches):
        for batch in batches:
            for sums in batch.column(0).to_pylist():
                v = np.frombuffer(sums, np.int64)
                at = np.flatnonzero(v)
                yield pa.record_batch([pa.array(at), pa.array(v[at])], names=["cell", "v"])

    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in partial.mapInArrow(cells, "cell long, v long").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out.reshape(shape)


@dataclass
class PenalisedGBT:
    """Boosted trees for a 0/1 label on a vector column; ``fit`` gives an MLlib GBTClassificationModel.

    Features are cut at ``bins`` - 1 exact quantiles.  A NaN is greater than all cuts.  Rows without a label are
    left out.  An empty or one-class table gives trees without splits."""

    features_col: str = "_features"
    label_col: str = "target"
    learning_rate: float = 0.1
    n_estimators: int = 200
    max_depth: int = 3
    subsample: float = 1.0
    reg_alpha: float = 0.01
    reg_lambda: float = 0.01
    min_child_weight: float = 1.0
    bins: int = 32
    seed: int = 1
    trees: list[Tree] = field(default_factory=list)

    def __post_init__(self):
        if not 2 <= self.bins <= 256:
            raise ValueError("bins must be from 2 to 256 (a bin is a byte)")
        if min(self.reg_alpha, self.reg_lambda, self.min_child_weight) < 0:
            raise ValueError("penalties must not be negative")

    def fit(self, df: DataFrame) -> GBTClassificationModel:
        spark = df.sparkSession
        rows = materialize(df.where(F.col(self.label_col).isNotNull()).select(vector_to_array(self.features_col).alias("x"), F.col(self.label_col).cast("double").alias("y")))
        first = rows.select(F.size("x").alias("n")).first()
        n_features = int(first["n"]) if first else 0
        columns = {f"x{i}": F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]) for i in range(n_features)}
        spans, _ = column_spans(rows, columns)
        found = select_quantiles(rows, columns, [k / self.bins for k in range(1, self.bins)], spans)
        edges = [sorted({e for e in found[c] if e is not None and spans[c].low <= e < spans[c].high}) for c in columns]
        n_rows = rows.count()
        # a pass over few rows is quicker in few tasks
        few = rows.coalesce(max(1, min(rows.rdd.getNumPartitions(), n_rows // TASK_ROWS)))
        blocks = few.mapInArrow(_blocks(edges), "bins binary, margin binary, y binary")
        blocks = materialize(blocks.withColumn("block", F.monotonically_increasing_id()))
        parts = blocks.rdd.getNumPartitions()
        scale = 2.0 ** min(36, 62 - max(1, n_rows).bit_length())
        since: list[Tree] = []
        self.trees = []
        for t in range(self.n_estimators if n_rows and n_features else 0):
            tree = self._grow(blocks, parts, since, n_features, [len(es) for es in edges], scale, t)
            if tree is None:  # nothing to gain any more, and rows don't change between trees
                if self.subsample >= 1.0:
                    break
                continue
            since.append(tree)
            self.trees.append(tree)
            if len(since) == STORE_EVERY and t + 1 < self.n_estimators:
                blocks, since = materialize(self._with_margins(blocks, since, n_features)), []
        return self._model(spark, edges, n_features)

    def _with_margins(self, blocks, trees, n_features):
        depth = self.max_depth

        def run(batches):
            for batch in batches:
                out = [_added(margin, trees, bins, depth) for _, bins, margin, _ in _arrays(batch, n_features)]
                yield pa.RecordBatch.from_arrays([batch.column("bins"), pa.array([m.tobytes() for m in out], pa.binary()), batch.column("y"), batch.column("block")], names=["bins", "margin", "y", "block"])

        return blocks.mapInArrow(run, blocks.schema)

    def _grow(self, blocks, parts, since, n_features, cuts, scale, t) -> Tree | None:
        size = 2 ** (self.max_depth + 1) - 1
        tree = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size))
        p = Penalties(self.reg_alpha, self.reg_lambda, 0.0, self.min_child_weight)
        n_bins = max(cuts) + 1
        sums: dict[int, tuple[float, float]] = {}
        cells: dict[int, np.ndarray] = {}  # of the level's nodes: 2 x features x bins whole numbers
        for level in range(self.max_depth):
            first, width = 2**level - 1, 2**level
            open_ = [0] if level == 0 else [k for k in range(first, first + width) if k in sums]
            if not open_:
                break
            # the lighter child of each split
            counted = open_ if level == 0 else [min(k, k + 1, key=lambda c: (sums[c][1], c)) for k in open_[::2]]
            task = _histograms(since, self.max_depth, level, counted, tree, n_features, n_bins, scale, self.subsample, self.seed + 7919 * t)
            found = _summed(blocks, parts, task, (2, len(counted), n_features, n_bins))
            parents, cells = cells, {k: found[:, i] for i, k in enumerate(counted)}
            for k in counted if level else ():
                parent = (k - 1) // 2
                cells[4 * parent + 3 - k] = parents[parent] - cells[k]
            for k in open_:
                g, h = cells[k] / scale
                sums[k] = (g[0].sum(), h[0].sum())
                split = best_split(g, h, cuts, p)
                if split:
                    tree.gain[k], tree.feature[k], tree.cut[k] = split[:3]
                    sums[2 * k + 1], sums[2 * k + 2] = split[3:]
        if tree.feature[0] < 0:
            return None
        for k, (G, H) in sums.items():
            tree.value[k], tree.weight[k] = self.learning_rate * p.leaf(G, H), H
        return tree

    def _model(self, spark: SparkSession, edges, n_features) -> GBTClassificationModel:
        """The trees as a stored MLlib model.  MLlib's margin is half the logit, so leaves are halved;
        its importances weight a node's gain by its count, so gains are divided by it."""
        gbt = GBTClassifier(featuresCol=self.features_col, labelCol=self.label_col, stepSize=self.learning_rate, maxDepth=self.max_depth,
                            maxIter=max(1, len(self.trees)), subsamplingRate=self.subsample, seed=self.seed)
        given = {p.name: v for p, v in gbt._paramMap.items()}
        defaults = {p.name: v for p, v in gbt._defaultParamMap.items() if p.name not in ("thresholds", "weightCol")}
        meta = {"timestamp": 0, "sparkVersion": spark.version, "paramMap": given, "defaultParamMap": defaults}
        per_tree = {"paramMap": {k: given[k] for k in ("featuresCol", "labelCol", "maxDepth")}, "defaultParamMap": {k: v for k, v in defaults.items() if k in (
            "cacheNodeIds", "checkpointInterval", "leafCol", "maxBins", "maxMemoryInMB", "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol")} | {"impurity": "variance", "seed": self.seed}}
        path = scratch_path(spark, "boosted")
        trees = self.trees or [Tree(np.array([-1]), np.zeros(1, np.int64), np.zeros(1), np.zeros(1), np.zeros(1))]
        model = {"class": "org.apache.spark.ml.classification.GBTClassificationModel", "uid": gbt.uid, "numFeatures": max(n_features, 1), "numTrees": len(trees), **meta}
        spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        heads = [(i, json.dumps({"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "uid": f"dtr_{gbt.uid}_{i}", **meta, **per_tree}), 1.0) for i in range(len(trees))]
        spark.createDataFrame(heads, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
        split = "split struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>"
        node = f"id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,{split.replace(' ', ':', 1)}"
        rows = [(i, n) for i, tree in enumerate(trees) for n in _preorder(tree, edges)]
        spark.createDataFrame(rows, f"treeID int, nodeData struct<{node}>").write.parquet(f"{path}/data")
        return GBTClassificationModel.load(path)


def _preorder(tree: Tree, edges) -> list[tuple]:
    """Nodes as MLlib stores them: (id, prediction, impurity, stats, count, gain, left, right, split), ids in preorder."""
    out: list = []

    def visit(k: int) -> int:
        i, n = len(out), max(float(tree.weight[k]), 1e-9)
        out.append(None)
        value, f = float(tree.value[k]) / 2, int(tree.feature[k])
        if f < 0:
            out[i] = (i, value, 0.0, [n, 0.0, 0.0], max(1, round(n)), -1.0, -1, -1, (-1, [], -1))
        else:
            left, right = visit(2 * k + 1), visit(2 * k + 2)
            out[i] = (i, value, 0.0, [n, 0.0, 0.0], max(1, round(n)), float(tree.gain[k]) / n, left, right, (f, [float(edges[f][int(tree.cut[k])])], -1))
        return i

    visit(0)
    return out
