"""Auto-grouping against its written rule."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scorelens.operators.autogroup import ATTEMPTS, auto_group


def _levels(pdf, feat):
    d = pdf[pdf[feat].notna() & pdf["target"].isin([0, 1])]
    g = d.groupby(feat)["target"].agg(bad="sum", n="count").reset_index()
    g["good"] = g["n"] - g["bad"]
    g["bad_ratio"] = g["bad"] / (g["bad"] + g["good"])
    return g.sort_values(["bad_ratio", feat]).reset_index(drop=True)


def _expected_groups(lv, n):
    """Group of each level, or None: cut points are the weighted i/n quantiles (linear) of the bad
    ratios; each must be a level's ratio, and the first such level opens the next group."""
    ratio, ends = lv["bad_ratio"].to_numpy(), np.cumsum((lv["good"] + lv["bad"]).to_numpy())
    at = (int(ends[-1]) - 1) * np.arange(1, n) / n
    low, high = (ratio[np.searchsorted(ends, f(at), side="right")] for f in (np.floor, np.ceil))
    marks = np.unique(np.concatenate([ratio[[0, -1]], low + (high - low) * (at - np.floor(at))]))[1:]
    if len(marks) == 0 or not np.isin(marks, ratio).all():
        return None
    opens = np.searchsorted(ratio, marks[:-1], side="left")
    return np.searchsorted(opens, np.arange(len(ratio)), side="left").tolist()


def test_regroup_matches_pandas_rule(spark, sample001):
    pdf = sample001.where(F.col("sample").isin("dev", "val")).select("nation", "target").toPandas()
    lv = _levels(pdf, "nation")
    res = auto_group(sample001, ["nation"], "target")
    got = {}
    for r in res.levels.collect():
        got.setdefault(r["n"], {})[r["level"]] = r["grp"]
    for n in ATTEMPTS:
        exp = _expected_groups(lv, n)
        if exp is None:
            assert n not in got
        else:
            assert got[n] == dict(zip(lv["nation"], exp)), n


def _fixture(spark, spec):
    rows, rid = [], 0
    for li, (bad, good) in enumerate(spec):
        for sample in ("dev", "oft1", "oft2", "oft3"):
            for _ in range(bad):
                rows.append((rid, sample, f"L{li}", 1)); rid += 1
            for _ in range(good):
                rows.append((rid, sample, f"L{li}", 0)); rid += 1
    df = spark.createDataFrame(rows, "row_id long, sample string, f string, target int")
    pdf = pd.DataFrame([(r[2], r[3]) for r in rows if r[1] == "dev"], columns=["f", "target"])
    return df, _levels(pdf, "f")


def test_all_attempts_fail_keeps_levels(spark):
    # weights and ratios chosen so that no quantile cut point is an observed ratio
    df, lv = _fixture(spark, [(3, 4), (6, 6), (4, 1), (1, 6), (5, 1), (2, 3), (3, 2)])
    assert all(_expected_groups(lv, n) is None for n in ATTEMPTS)
    res = auto_group(df, ["f"], "target", build=("dev",))
    assert all(r["status"] == "failed" and r["score"] == 0.0 for r in res.trial_report.collect())
    fm = res.final_map.collect()
    assert len(fm) == 7 and sorted(r["grp"] for r in fm) == list(range(7))


def test_unobserved_edge_fails_only_that_attempt(spark):
    df, lv = _fixture(spark, [(6, 6), (3, 6), (5, 4), (2, 3), (1, 3), (1, 5), (3, 1), (2, 5)])
    res = auto_group(df, ["f"], "target", build=("dev",))
    status = {r["n_bins"]: r["status"] for r in res.trial_report.collect()}
    got = {}
    for r in res.levels.collect():
        got.setdefault(r["n"], {})[r["level"]] = r["grp"]
    for n in ATTEMPTS:
        exp = _expected_groups(lv, n)
        assert status[n] == ("failed" if exp is None else "regrouped"), n
        if exp is not None:
            assert got[n] == dict(zip(lv["f"], exp)), n


def test_tied_ratio_first_index_is_border(spark):
    # two levels share a ratio that is a cut point: the first index is the border
    rows, rid = [], 0
    spec = [(1, 9), (1, 9), (3, 7), (3, 7), (5, 5), (5, 5), (7, 3), (7, 3)]
    for li, (bad, good) in enumerate(spec):
        for sample in ("dev", "oft1", "oft2", "oft3"):
            for _ in range(bad):
                rows.append((rid, sample, f"L{li}", 1)); rid += 1
            for _ in range(good):
                rows.append((rid, sample, f"L{li}", 0)); rid += 1
    df = spark.createDataFrame(rows, "row_id long, sample string, f string, target int")
    res = auto_group(df, ["f"], "target", build=("dev",))
    pdf = pd.DataFrame([(r[2], r[3]) for r in rows if r[1] == "dev"], columns=["f", "target"])
    lv = _levels(pdf, "f")
    got = {}
    for r in res.levels.collect():
        got.setdefault(r["n"], {})[r["level"]] = r["grp"]
    for n in ATTEMPTS:
        exp = _expected_groups(lv, n)
        if exp is not None:
            assert got[n] == dict(zip(lv["f"], exp))


def test_small_feature_keeps_levels(spark, sample001):
    res = auto_group(sample001, ["segment"], "target")
    rep = res.trial_report.collect()
    assert len(rep) == 1 and rep[0]["status"] == "unchanged" and rep[0]["score"] == 0.0
    fm = res.final_map.collect()
    assert sorted(r["grp"] for r in fm) == list(range(len(fm)))
    assert all(not math.isnan(r["woe"]) for r in fm)
