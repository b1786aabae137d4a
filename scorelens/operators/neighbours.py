"""Exact k nearest neighbours by a tree of pivot cells and triangle-inequality bounds.

1. Cells that hold more than ``cell_size`` points are split: a few of their points become pivots and each
   point goes to its nearest one, round by round.  A cell knows its pivot and its radius.
2. Pairs of cells go down the tree level by level, as joins.  Within a distance d between pivots, all points of
   B are at most d + rA + rB from any point of A, so if B has k points that bounds the k-th neighbour of
   all A; a pair whose d - rA - rB is beyond the least bound of A is dropped with all below it.
3. Each last cell finds its neighbours inside itself, which bounds the k-th distance of each of its points; the pairs of
   cells that are left are compared in blocks, and a point's k best remain.  Of two cells only the points are
   compared that lie within that distance of the box around the other cell's points.

No cell is compared with all others unless the bounds can't part them (as with many features), and no task
holds more than two cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.plans.broadcast import checked_broadcast, materialize

CELL = 512  # points in a cell that is not split
FAN = 8  # pivots of a cell that is split
MOST_ROUNDS = 40
SLACK = 1 + 1e-9  # for rounding in the bounds


def _distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _split(points: DataFrame, cell_size: int, seed: int) -> tuple[DataFrame, list[DataFrame]]:
    """(points with their last cell, nodes of each level): nodes are (cell, parent, centre, radius, n); a cell that is not
    split is its own parent on the next level."""
    text = F.lit("").cast("string")
    cur = materialize(points.select("pid", "x", text.alias("cell"), text.alias("parent"), F.col("x").alias("centre"), F.lit(0.0).alias("dist")))
    levels = []
    for turn in range(MOST_ROUNDS):
        big = cur.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_size)
        chosen = [F.min_by("x", F.xxhash64("pid", F.lit(seed), F.lit(turn * FAN + j))) for j in range(FAN)]
        pivots = cur.join(checked_broadcast(big.select("cell")), "cell").groupBy("cell").agg(F.array_distinct(F.array(*chosen)).alias("pivots"))
        pivots = materialize(pivots)
        if not pivots.take(1):
            break
        rows = cur.select("pid", "x", "cell", F.col("centre").alias("c0"), F.col("dist").alias("d0")).join(checked_broadcast(pivots), "cell", "left")
        near = F.array_min(F.transform("pivots", lambda p, i: F.struct(_distance(F.col("x"), p).alias("d"), i.alias("i"))))
        rows = rows.withColumn("near", near)
        split = F.col("near").isNotNull()
        cur = materialize(rows.select(
            "pid", "x", F.when(split, F.concat_ws(".", "cell", F.col("near.i").cast("string"))).otherwise(F.col("cell")).alias("cell"), F.col("cell").alias("parent"),
            F.when(split, F.element_at("pivots", F.col("near.i") + 1)).otherwise(F.col("c0")).alias("centre"),
            F.when(split, F.col("near.d")).otherwise(F.col("d0")).alias("dist")))
        nodes = cur.groupBy("cell", "parent").agg(F.first("centre").alias("centre"), F.max("dist").alias("radius"), F.count(F.lit(1)).alias("n"))
        levels.append(materialize(nodes))
    return cur, levels


def _pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances, summed feature by feature."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[None, :, i]) ** 2
    return np.sqrt(out)


def _pack(n_features: int, k: int):
    """Cells as one row each: ids, points, and the distance within which each point has k neighbours in its cell."""

    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("points", "within", "reach", "size")}
            for xs in batch.column("xs").to_pylist():
                x = np.array(xs, float).reshape(-1, n_features)
                within = np.full(len(x), np.inf)
                if len(x) > k:
                    d = _pairwise(x, x)
                    np.fill_diagonal(d, np.inf)
                    within = np.partition(d, k - 1, axis=1)[:, k - 1]
                out["points"].append(x.tobytes())
                out["within"].append(within.tobytes())
                out["reach"].append(float(within.max(initial=0.0)))
                out["size"].append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("pids"), *(pa.array(out[c]) for c in out)], names=["cell", "pids", *out])

    return run


def _pairs(levels: list[DataFrame], packed: DataFrame, k: int) -> DataFrame:
    """(cell, other): pairs of last cells that may hold neighbours; every cell is paired with itself."""
    if not levels:
        return packed.select("cell", F.col("cell").alias("other"))
    pairs = packed.sparkSession.createDataFrame([("", "")], "cell string, other string")
    for depth, nodes in enumerate(levels, start=1):
        one = nodes.select(F.col("parent").alias("cell"), F.col("cell").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"))
        two = nodes.select(F.col("parent").alias("other"), F.col("cell").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"), F.col("n").alias("nb"))
        down = pairs.join(one, "cell").join(two, "other")
        same = F.col("a") == F.col("b")
        d = _distance(F.col("ca"), F.col("cb"))
        down = down.select("a", "b", F.when(same, 0.0).otherwise(d - F.col("ra") - F.col("rb")).alias("least"),
                           F.when(same & (F.col("nb") > k), 2 * F.col("ra")).when(~same & (F.col("nb") >= k), d + F.col("ra") + F.col("rb")).alias("most"))
        down = materialize(down)
        bound = down.groupBy("a").agg(F.coalesce(F.min("most"), F.lit(float("inf"))).alias("bound"))
        if depth == len(levels):  # the last cells know more
            bound = bound.join(packed.select(F.col("cell").alias("a"), "reach"), "a").select("a", F.least("bound", "reach").alias("bound"))
        left = down.join(bound, "a").where(F.col("least") <= F.col("bound") * SLACK)
        pairs = materialize(left.select(F.col("a").alias("cell"), F.col("b").alias("other")))
    return pairs


def _to_box(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each point of ``a`` to the box around ``b``, summed as in ``_pairwise``, so never above a distance there."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += np.maximum(np.maximum(b[:, i].min() - a[:, i], a[:, i] - b[:, i].max()), 0.0) ** 2
    return np.sqrt(out)


def _nearest(a: np.ndarray, limit: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, distance): at most the k nearest of each point of ``a`` that are within its limit,
    ties by id.  ``same``: both are one cell, and no point is its own neighbour."""
    mine, theirs = np.arange(len(a)), np.arange(len(b))
    if not same:
        mine = np.flatnonzero(_to_box(a, b) <= limit)
        if len(mine):
            theirs = np.flatnonzero(_to_box(b, a[mine]) <= limit[mine].max())
    if not len(mine) or not len(theirs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    d = _pairwise(a[mine], b[theirs])
    if same:
        np.fill_diagonal(d, np.inf)
    i, j = np.nonzero((d <= limit[mine, None]) & (d < np.inf))
    d, i, j = d[i, j], mine[i], theirs[j]
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    order = np.lexsort((place[j], d, i))
    d, i, j = d[order], i[order], j[order]
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
    best = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
    return i[best], j[best], d[best]


def _compare(n_features: int, k: int):
    """Pairs of packed cells to (pid, cid, d): at most k for each point of the first cell."""

    def run(batches):
        for batch in batches:
            kind = batch.schema.field("pids").type.value_type
            pids, cids, dists = [], [], []
            names = ("cell", "other", "pids", "points", "within", "cids", "others")
            for cell, other, mine, points, within, theirs, others in zip(*(batch.column(c) for c in names)):
                a, b = (np.frombuffer(x.as_buffer()).reshape(-1, n_features) for x in (points, others))
                ids = theirs.values.to_numpy(zero_copy_only=False)
                i, j, d = _nearest(a, np.frombuffer(within.as_buffer()), b, ids, k, cell.as_py() == other.as_py())
                if len(i):
                    pids.append(mine.values.take(pa.array(i)))
                    cids.append(theirs.values.take(pa.array(j)))
                    dists.append(d)
            one = lambda parts: pa.concat_arrays(parts) if parts else pa.array([], kind)  # noqa: B023, E731
            yield pa.record_batch([one(pids), one(cids), pa.array(np.concatenate(dists) if dists else np.zeros(0))], names=["pid", "cid", "d"])

    return run


def knn(points: DataFrame, feats: list[str], k: int = 5, seed: int = 1, cell_size: int = CELL, counts: dict | None = None) -> DataFrame:
    """Exact k nearest neighbours among ``points`` (pid, feats...): (pid, cid, d, r), ties by cid.

    Points have no missing features; pid is unique.  ``counts`` receives the number of points, of cells and of compared pairs of
    points (``candidates``).  Fewer than k + 1 points: all others are neighbours.  Stored, as are the steps before."""
    n = len(feats)
    start = points.select("pid", F.array(*[F.col(f).cast("double") for f in feats]).alias("x"))
    cur, levels = _split(start, cell_size, seed)
    pid_type = points.schema["pid"].dataType
    grouped = cur.groupBy("cell").agg(F.collect_list(F.struct("pid", "x")).alias("rows"))
    grouped = grouped.select("cell", F.col("rows.pid").alias("pids"), F.col("rows.x").alias("xs"))
    schema = T.StructType([T.StructField("cell", T.StringType()), T.StructField("pids", T.ArrayType(pid_type)), T.StructField("points", T.BinaryType()),
                           T.StructField("within", T.BinaryType()), T.StructField("reach", T.DoubleType()), T.StructField("size", T.LongType())])
    packed = materialize(grouped.mapInArrow(_pack(n, k), schema))
    pairs = _pairs(levels, packed, k)
    theirs = packed.select(F.col("cell").alias("other"), F.col("pids").alias("cids"), F.col("points").alias("others"), F.col("size").alias("others_size"))
    both = pairs.join(packed, "cell").join(theirs, "other")
    if counts is not None:
        row = both.agg(F.sum(F.col("size") * F.col("others_size")).alias("c")).first()
        counts |= {"points": cur.count(), "cells": packed.count(), "candidates": int(row["c"] or 0)}
    found = T.StructType([T.StructField("pid", pid_type), T.StructField("cid", pid_type), T.StructField("d", T.DoubleType())])
    near = both.select("cell", "other", "pids", "points", "within", "cids", "others").mapInArrow(_compare(n, k), found)
    best = Window.partitionBy("pid").orderBy("d", "cid")
    return materialize(near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k))
