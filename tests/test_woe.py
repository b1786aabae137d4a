import math

from pyspark.sql import functions as F

from scorelens.operators import woe as W


def _lv(spark, rows):
    return spark.createDataFrame(rows, "row_id long, lv string, target int")


def test_woe_zero_cells_replaced_by_one(spark):
    # level a: 0 bad / 2 good; level b: 2 bad / 0 good; totals B=3, G=3
    rows = [(1, "a", 0), (2, "a", 0), (3, "b", 1), (4, "b", 1), (5, "c", 1), (6, "c", 0)]
    m = {r["level"]: r["woe"] for r in W.woe_map(_lv(spark, rows), ["lv"], "target").collect()}
    assert math.isclose(m["a"], math.log(1 * 3 / 3 / 2), abs_tol=1e-9)
    assert math.isclose(m["b"], math.log(2 * 3 / 3 / 1), abs_tol=1e-9)
    assert math.isclose(m["c"], 0.0, abs_tol=1e-9)


def test_woe_unseen_level_zero_and_null_is_a_level(spark):
    train = _lv(spark, [(1, "a", 1), (2, "a", 0), (3, None, 1), (4, None, 1), (5, "b", 0)])
    apply = _lv(spark, [(10, "a", 0), (11, "zz", 1), (12, None, 0)])
    out = {r["row_id"]: r["lv"] for r in W.woe_fit_apply(train, apply, ["lv"], "target").collect()}
    assert out[11] == 0.0
    # null level: 2 bad, g = 0 -> 1; B = 3, G = 2
    assert math.isclose(out[12], math.log(2 * 2 / 3 / 1), abs_tol=1e-9)


def test_group_woe_one_sided_zero_is_infinite(spark):
    st = spark.createDataFrame([("f", "a", 0, 5), ("f", "b", 3, 5)], "feature string, level string, bad long, good long")
    m = {r["level"]: r["woe"] for r in W.group_woe(st).collect()}
    assert m["a"] == float("-inf")
    sm = {r["level"]: r["woe"] for r in W.group_woe(st, zero_policy="sentinel").collect()}
    assert sm["a"] == -99.0


def test_iv_drops_zero_share_rows(spark):
    st = spark.createDataFrame([("f", "a", 0, 5), ("f", "b", 3, 5), ("f", "c", 3, 0)],
                               "feature string, level string, bad long, good long")
    iv = W.grouped_iv(st).first()["iv"]
    bp, gp = 3 / 6, 5 / 10
    assert math.isclose(iv, math.log(bp / gp) * (bp - gp), abs_tol=1e-9)


def test_category_psi_ignores_one_sided_levels(spark):
    b = spark.createDataFrame([("f", "a", 5, 5), ("f", "b", 5, 5), ("f", "x", 9, 9)],
                              "feature string, level string, good long, bad long")
    o = spark.createDataFrame([("f", "a", 2, 2), ("f", "b", 6, 6)], "feature string, level string, good long, bad long")
    psi = W.category_psi(b, o).first()["psi"]
    p, q = [0.5, 0.5], [0.25, 0.75]
    assert math.isclose(psi, sum(math.log(a / c) * (a - c) for a, c in zip(p, q)), abs_tol=1e-9)


def test_iv_is_non_negative(spark, sample001):
    for r in W.iv_ranking(sample001, ["segment", "nation"], ["totalprice"], "target").collect():
        assert r["iv"] >= 0
