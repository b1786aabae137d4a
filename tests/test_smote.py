import math
import random

import pytest
from pyspark.sql import functions as F

from scorelens.operators.smote import knn, smote


def test_knn_is_exact_with_dense_cluster(spark):
    rnd = random.Random(4)
    pts = [(i, round(rnd.gauss(0, 1), 3), round(rnd.gauss(0, 1), 3)) for i in range(150)]
    pts += [(1000 + i, 0.2 + 0.0005 * i, 0.2) for i in range(60)]  # dense cluster
    df = spark.createDataFrame(pts, "pid long, a double, b double")
    got = {}
    for r in knn(df, ["a", "b"], k=4).collect():
        got.setdefault(r["pid"], []).append((r["r"], r["cid"]))
    for p in pts:
        exp = [c for _, c in sorted((math.dist(p[1:], q[1:]), q[0]) for q in pts if q[0] != p[0])[:4]]
        assert [c for _, c in sorted(got[p[0]])] == exp


def test_smote_counts_and_bounds(spark):
    rnd = random.Random(8)
    rows = [(i, 1 if i % 4 == 0 else 0, rnd.random(), rnd.random() * 10) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, target int, a double, b double")
    out = smote(df, ["a", "b"], n=200, k=3)
    n1 = sum(1 for r in rows if r[1] == 1)
    assert out.count() == len(rows) + 2 * n1
    syn = out.where("is_synthetic")
    lo = df.where("target = 1").agg(F.min("a"), F.max("a")).first()
    s = syn.agg(F.min("a"), F.max("a")).first()
    assert s[0] >= lo[0] - 1e-12 and s[1] <= lo[1] + 1e-12


def test_smote_of_any_percentage_and_on_the_segments(spark):
    rnd = random.Random(3)
    rows = [(i, 1, rnd.random(), rnd.random(), rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, target int, a double, b double, c double")
    for n, low, high in ((50, 150, 250), (150, 550, 650), (0, 0, 0)):
        made = smote(df, ["a", "b", "c"], n=n, k=3).where("is_synthetic").count() if n else 0
        assert low <= made <= high
    small = df.where("row_id < 25")
    points = [r[2:] for r in rows[:25]]
    for r in smote(small, ["a", "b", "c"], n=100, k=3).where("is_synthetic").collect():
        x = (r["a"], r["b"], r["c"])
        assert any(abs(math.dist(p, x) + math.dist(x, q) - math.dist(p, q)) < 1e-9 for p in points for q in points)


def test_smote_of_a_missing_feature_raises(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 1, None), (3, 0, None)], "row_id long, target int, a double")
    with pytest.raises(Exception, match="feature a is missing"):
        smote(df, ["a"], n=100, k=1).collect()
