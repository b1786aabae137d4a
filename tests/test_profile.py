import math

import numpy as np
from pyspark.sql import functions as F

from scorelens.operators import profile as P
from scorelens.plans.selection import exact_quantiles


def test_exact_quantiles_match_numpy(spark, sample001):
    pdf = sample001.select("totalprice", "acctbal").toPandas()
    got = exact_quantiles(sample001, ["totalprice", "acctbal"], [0.01, 0.25, 0.5, 0.99], cells=64)
    for c in ["totalprice", "acctbal"]:
        exp = np.nanpercentile(pdf[c].astype(float), [1, 25, 50, 99])
        assert np.allclose(got[c], exp, rtol=0, atol=1e-6)


def test_bivar_few_values_use_value_table(spark):
    df = spark.createDataFrame([(float(i % 4), i % 2) for i in range(40)], "x double, target int")
    assert P.bivar_numeric(df, ["x"]).count() == 0
    assert P.bivar_categorical(df, ["x"]).count() == 4


def test_bivar_equal_width_counts_match_pandas_cut(spark, sample001):
    pdf = sample001.select("totalprice", "target").toPandas()
    cut = np.histogram  # noqa: F841 - documentation: pandas cut rule restated below
    x = pdf["totalprice"].to_numpy()
    mn, mx = x.min(), x.max()
    edges = np.linspace(mn, mx, 11)
    edges[0] -= (mx - mn) * 0.001
    bins = np.searchsorted(edges, x, side="left")
    exp = {int(b): int((bins == b).sum()) for b in np.unique(bins)}
    got = {r["bin"]: r["count"] for r in P.bivar_numeric(sample001, ["totalprice"]).collect()}
    assert got == exp


def test_crosstab_margin_row(spark, sample001):
    ct = {(r["feature"], r["level"]): r for r in P.crosstab_margins(sample001, ["segment"]).collect()}
    total = sample001.where(F.col("segment").isNotNull()).count()
    assert ct[("segment", "All")]["n_all"] == total
