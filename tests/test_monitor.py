import math
import random

from pyspark.sql import functions as F

import brute
from scorelens.functions.bands import score_band
from scorelens.operators import monitor as mon


def test_band_edges(spark):
    xs = [-1.0, 0.0, 0.05, 0.1, 0.15, 0.3, 1.0, 1.01, None, float("nan")]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(score_band("x", 20)).collect()]
    assert got == [None, None, "0.00~0.05", "0.05~0.10", "0.10~0.15", "0.25~0.30", "0.95~1.00", None, None, None]
    got10 = [r[0] for r in df.select(score_band("x", 10)).collect()]
    assert got10[2:6] == ["0.00~0.10", "0.00~0.10", "0.10~0.20", "0.20~0.30"]


def _psi_df(spark, dev, val):
    rows = [(i, "dev", x) for i, x in enumerate(dev)] + [(10_000 + i, "val", x) for i, x in enumerate(val)]
    return spark.createDataFrame(rows, "row_id long, sample string, score double")


def test_psi_equals_reference_rule(spark):
    rnd = random.Random(1)
    dev = [round(rnd.random(), 2) for _ in range(157)]
    val = [round(rnd.random() * 0.9 + 0.05, 2) for _ in range(93)]  # narrower range: dev tails fall in no band
    t = mon.score_psi(_psi_df(spark, dev, val), k=10).orderBy("band").collect()
    exp, av = brute.psi(dev, val, 10)
    assert math.isclose(t[0]["psi"], exp, abs_tol=1e-8)
    assert all(math.isclose(r["cmp_share"], a, abs_tol=1e-9) for r, a in zip(t, av))


def test_psi_zero_share_costs_one(spark):
    dev = [0.1] * 50 + [0.9] * 50
    val = [0.9] * 30
    t = mon.score_psi(_psi_df(spark, dev, val), k=4).collect()
    exp, _ = brute.psi(dev, val, 4)
    assert math.isclose(t[0]["psi"], exp, abs_tol=1e-8)
    assert any(r["term"] == 1.0 for r in t)


def test_score_distribution_gap_is_zero_on_right_band(spark):
    rows = [(1, "dev", 0.02), (2, "dev", 0.52), (3, "val", 0.52), (4, "val", 0.98)]
    df = spark.createDataFrame(rows, "row_id long, sample string, score double")
    d = {r["band"]: r for r in mon.score_distribution(df, samples=("dev", "val")).collect()}
    assert d["0.00~0.05"]["n_val"] == 0 and d["0.00~0.05"]["n_dev"] == 1
    assert d["0.95~1.00"]["n_dev"] == 0 and d["0.95~1.00"]["n_val"] == 1
    assert math.isclose(d["0.50~0.55"]["pct_val"], 0.5)


def test_histogram_density_integrates_to_one(spark, sample001):
    h = mon.score_histogram(sample001).collect()
    by = {}
    for r in h:
        by.setdefault(r["sample"], 0.0)
        by[r["sample"]] += r["density"] * (r["hi"] - r["lo"])
    assert all(math.isclose(v, 1.0, abs_tol=1e-6) for v in by.values())


def test_psi_of_a_sample_against_itself_is_zero(spark):
    rnd = random.Random(9)
    xs = [rnd.random() for _ in range(200)]
    t = mon.score_psi(_psi_df(spark, xs, xs), k=10).collect()
    assert all(r["dev_share"] > 0 for r in t)
    assert abs(t[0]["psi"]) < 1e-12
