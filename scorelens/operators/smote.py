"""SMOTE oversampling (Chawla et al. 2002) on numeric features, exact neighbours.

For each minority row, N/100 synthetic points x + u * (nn - x) are drawn, nn
among its k nearest minority neighbours (Euclidean, ties by id).

Neighbours come from ``operators.neighbours``: cells around pivots, compared only where the triangle
inequality can't part them.  Identical vectors are collapsed
first (a hot duplicate is one point with a count).

The neighbour index and u come from xxhash64(id, j, seed), so reruns agree.
Originals and the label are kept; synthetic rows carry ``is_synthetic``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.operators.neighbours import knn
from scorelens.plans.broadcast import materialize


def smote(df: DataFrame, features, target: str = "target", key: str = "row_id", n: int = 100, k: int = 5,
          seed: int = 1) -> DataFrame:
    """``df`` (key, features as doubles, target) and n % as many synthetic rows of class 1.

    Every minority row gives n // 100 points, and n % 100 in a hundred of them (by
    a hash of the key) one more.  A minority row with a missing feature has no
    place in the space: it raises, so fill or drop such rows first.
    """
    feats = list(features)
    if n < 0:
        raise ValueError("n must not be negative")
    orig = df.select(key, *[F.col(c).cast("double").alias(c) for c in feats], target,
                     F.lit(False).alias("is_synthetic"))
    if n == 0:
        return orig

    def present(c):
        x = F.col(c).cast("double")
        wrong = F.raise_error(F.lit(f"feature {c} is missing in a row of class 1")).cast("double")
        return F.when(x.isNull() | F.isnan(x), wrong).otherwise(x).alias(c)

    mino = df.where(F.col(target) == 1).select(key, *[present(c) for c in feats])
    more = F.when(F.pmod(F.xxhash64(F.lit("more"), key, F.lit(seed)), F.lit(100)) < n % 100, 1).otherwise(0)
    mino = mino.withColumn("_m", F.lit(n // 100) + more)
    # Collapse identical vectors: neighbours are searched among distinct points.
    pts = materialize(mino.groupBy(*feats).agg(F.min(key).alias("pid")))
    nn = knn(pts, feats, k, seed)
    vec = pts.select(F.col("pid").alias("cid"), F.array(*feats).alias("_nv"))
    nn = nn.join(vec, "cid").groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("r", "_nv"))).alias("_nns"))
    rows = mino.join(pts, feats).join(nn, "pid", "left")
    rows = rows.where("_m > 0").withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_m"))))
    cnt = F.coalesce(F.size("_nns"), F.lit(0))
    cnt = F.when(cnt < 0, 0).otherwise(cnt)
    pick = F.when(cnt > 0, F.element_at("_nns", (F.pmod(F.xxhash64(key, "_j", F.lit(seed)), cnt) + 1).cast("int")))
    u = F.pmod(F.xxhash64(key, "_j", F.lit(seed + 1)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    nv = pick.getField("_nv")
    synth = rows.select(
        F.lit(None).cast(df.schema[key].dataType).alias(key),
        *[(F.col(c) + u * (F.coalesce(nv[i], F.col(c)) - F.col(c))).alias(c) for i, c in enumerate(feats)],
        F.lit(1).cast(df.schema[target].dataType).alias(target),
        F.lit(True).alias("is_synthetic"))
    return orig.unionByName(synth)
