"""Running totals over ranges, rank selection, thinned curves: against plain computation and by plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens.operators import evaluate as ev
from scorelens.operators import monitor as mon
from scorelens.operators import report as R
from scorelens.operators import sampling
from scorelens.operators import woe as W
from scorelens.operators.autogroup import weighted_quantiles
from scorelens.operators.profile import describe
from scorelens.plans import selection
from scorelens.plans.prefix import running_totals
from scorelens.spec import SAMPLE_SPEC


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_totals_of_a_group_over_many_ranges(spark):
    rows = [(("hot" if i % 3 else None), i, i % 7) for i in range(500)] + [("small", 1, 4)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    out = running_totals(df, ["g"], ["k"], ["v"], parts=6).collect()
    assert len({r["_part"] for r in out if r["g"] == "hot"}) > 1
    for g in ("hot", None, "small"):
        mine = sorted((r for r in out if r["g"] == g), key=lambda r: r["k"])
        values = [v for x, _, v in rows if x == g]
        assert [r["idx"] for r in mine] == list(range(len(values)))
        assert [r["cum_v"] for r in mine] == list(np.cumsum(values)) and {r["tot_v"] for r in mine} == {sum(values)}


def test_a_hundred_thousand_levels_spread_over_tasks(spark):
    n = 100_000
    df = spark.range(2 * n).select(F.concat(F.lit("L"), F.col("id") % n).alias("f"), (F.xxhash64("id") % 3 == 0).cast("int").alias("target"))
    stats = W.category_stats(df, ["f"], "target", cumulative=True)
    windows = [x for x in plan_of(stats).splitlines() if "Window [" in x and "row_number" in x]
    assert windows and all("_part" in x for x in windows)  # no window by feature alone
    parts = stats.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(parts) > 1
    ks, iv = W.grouped_ks(stats).first()["ks"], W.grouped_iv(stats).first()["iv"]
    pdf = stats.toPandas().sort_values(["bad_ratio", "level"])
    assert (pdf["idx"].to_numpy() == np.arange(n)).all()
    g, b = pdf["good"].to_numpy(), pdf["bad"].to_numpy()
    assert abs(ks - np.abs(np.cumsum(g) / g.sum() - np.cumsum(b) / b.sum()).max()) < 1e-9
    both = (g > 0) & (b > 0)
    p, q = b[both] / b.sum(), g[both] / g.sum()
    assert abs(iv - (np.log(p / q) * (p - q)).sum()) < 1e-9
    weighted = stats.selectExpr("feature", "bad_ratio", "good + bad as n", "idx + 1 as place")
    weighted = weighted.selectExpr("*", "place * 2 as cum_n", f"{2 * n} as tot_n")
    got = weighted_quantiles(weighted, [0.0, 0.3, 0.5, 1.0])["f"]
    assert np.allclose(got, np.quantile(np.repeat(pdf["bad_ratio"].to_numpy(), 2), [0.0, 0.3, 0.5, 1.0]))


@pytest.mark.parametrize("cells,few", [(16, 0), (16, 50), (selection.CELLS, selection.FEW)])
def test_ranks_of_awkward_columns(spark, cells, few):
    r = np.random.default_rng(1)
    cols = {
        "wide": np.concatenate([10.0 ** r.uniform(-300, 300, 200), -(10.0 ** r.uniform(-300, 300, 200))]),
        "ties": np.repeat([0.0, -0.5, 7.0, 1e-9], 100),
        "one": np.full(400, 3.25),
        "ends": np.concatenate([[-np.inf] * 20, r.normal(size=360), [np.inf] * 20]),
        "outlier": np.concatenate([r.normal(size=399), [1e18]]),
    }
    df = spark.createDataFrame([tuple(float(v[i]) for v in cols.values()) for i in range(400)], ", ".join(f"{c} double" for c in cols))
    exprs = {c: F.col(c) for c in cols}
    spans, _ = selection.column_spans(df, exprs)
    ranks = {c: [0, 1, 17, 199, 200, 398, 399] for c in cols}
    got = selection.select_ranks(df, exprs, ranks, spans, cells=cells, most_counted=few)
    for c, v in cols.items():
        assert [got[c][k] for k in ranks[c]] == [np.sort(v)[k] for k in ranks[c]], c


def test_quantile_plans_have_no_window(spark, sample001):
    for df in (describe(sample001, ["totalprice", "score"]),):
        assert "Window" not in plan_of(df)
    approx = {r["column_name"]: r for r in describe(sample001, ["totalprice"], (0.25, 0.5), approx=True).collect()}
    exact = {r["column_name"]: r for r in describe(sample001, ["totalprice"], (0.25, 0.5)).collect()}
    rank = lambda v: sample001.where(F.col("totalprice") <= v).count() / sample001.count()
    assert abs(rank(approx["totalprice"]["p50"]) - 0.5) < 0.02 and approx["totalprice"]["mean"] == exact["totalprice"]["mean"]
    empty = describe(sample001.limit(0), ["totalprice"]).first()
    assert empty["count"] == 0 and empty["p50"] is None


def test_a_report_reads_its_rows_a_bounded_number_of_times(spark, sample001, tmp_path):
    """The rows are behind a counter: what is about the score is read off one table."""
    from scorelens.plans.scoretable import score_table

    path = str(tmp_path / "rows")
    sample001.write.parquet(path)
    df = spark.read.parquet(path)
    table = score_table(df, by=["sample"], groups=5)
    for t in (ev.roc_summary(df, by=["sample"], table=table), ev.roc_points(df, by=["sample"], table=table, thin=True), mon.score_histogram(df, table=table),
              mon.score_distribution(df, table=table), mon.psi_monitor(df, table=table)):
        assert path not in plan_of(t)
    tables = R.score_report(df, spec=SAMPLE_SPEC)
    reading = [name for name, t in tables.items() if path in plan_of(t)]
    assert set(reading) <= {"gains", "samples", "bivar", "bivar_levels"}


def test_missing_scores_stand_last_and_break_nothing(spark):
    rows = [("dev", i, i % 2, (i * 37 % 100) / 100.0) for i in range(100)] + [("dev", 200 + i, 1, float("nan")) for i in range(5)] + [("dev", 300, 0, None)]
    df = spark.createDataFrame(rows, "sample string, row_id long, target int, score double")
    clean = df.where("row_id < 200")
    hist = lambda d: sorted(map(tuple, mon.score_histogram(d, groups=["dev"]).collect()))
    assert hist(df) == hist(clean)
    assert ev.roc_summary(df).collect() == ev.roc_summary(clean).collect()
    last = ev.gains(df, bins=2).orderBy("bin").collect()
    assert all(r["avg_score"] == r["avg_score"] for r in last) and last[1]["cum_bad_num"] + last[1]["cum_good_num"] == 106


def test_thin_curve_keeps_the_corners_over_range_borders(spark):
    r = np.random.default_rng(3)
    rows = [(i, float(i // 3), int(x)) for i, x in enumerate(np.repeat(r.integers(0, 2, 100), 3))]
    df = spark.createDataFrame(rows, "row_id long, score double, target int")
    full = {x["threshold"]: (x["tpr"], x["fpr"]) for x in ev.roc_points(df).collect()}
    for parts in (1, 3, 9):
        thin = {x["threshold"]: (x["tpr"], x["fpr"]) for x in ev.roc_points(df, thin=True, n_buckets=parts).collect()}
        assert thin.items() <= full.items()
        order = sorted(full, reverse=True)
        steps = [next(t for _, s, t in rows if s == v) for v in order]
        assert sorted(thin, reverse=True) == [v for i, v in enumerate(order) if i in (0, len(order) - 1) or steps[i + 1] != steps[i]]
    flipped = {x["threshold"]: (x["fpr"], x["tpr"]) for x in ev.roc_points(df, pos_label=0).collect()}
    assert flipped == full


def test_samples_are_a_filter(spark, sample001):
    got = sampling.stratified_sample(sample001)
    plan = plan_of(got)
    assert "Window" not in plan and "Union" not in plan
    base = plan_of(sample001)
    assert plan.count("Join") == base.count("Join") and plan.count("Exchange") == base.count("Exchange")
    df = spark.createDataFrame([(None, 1), ("a", 1), ("b", 1), ("c", 0), ("d", None)], "row_id string, target int")
    assert sampling.stratified_sample(df, frac1=1.0, frac0=0.0).count() == 3
    assert sampling.stratified_sample(df.limit(0)).count() == 0 and sampling.dev_val_split(df.limit(0)).count() == 0


def test_one_class_is_refused(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1)], "f string, target int")
    with pytest.raises(Exception, match="both values"):
        W.woe_map(df, ["f"], "target").collect()


def test_tasks_count_values_by_cell(spark):
    """A round shuffles a row a cell and task, and makes no row a value."""
    df = spark.range(20_000).selectExpr("cast(id * id % 7919 as double) as a", "if(id % 3 = 0, null, -exp(id / 100.0)) as b").repartition(3)
    exprs = {c: F.col(c) for c in ("a", "b")}
    spans, _ = selection.column_spans(df, exprs)
    todo = [selection._Cell(i, spans[c].low, spans[c].high, 0, spans[c].n, [0]) for i, c in enumerate(exprs)]
    for logarithm in (False, True):
        counted = selection._counted(df, exprs, todo, 50, logarithm)
        plan = counted._jdf.queryExecution().toString()
        assert "Generate" not in plan and "explode" not in plan
        rows = sorted(counted.collect(), key=lambda r: (r["t"], r["cell"]))
        assert sum(r["n"] for r in rows) == sum(s.n for s in spans.values()) and len(rows) <= 100
        assert all(x["hi"] < y["lo"] for x, y in zip(rows, rows[1:]) if x["t"] == y["t"])  # cells keep the order
