"""Exactness does not depend on the bucketing: any number of buckets gives the same tables."""

from scorelens.operators import evaluate as ev
from scorelens.plans.selection import exact_quantiles


def test_gains_and_roc_independent_of_bucket_count(spark, sample001):
    ref_g = sorted(map(tuple, ev.gains(sample001, by=["sample"], n_buckets=2).collect()))
    ref_r = sorted(map(tuple, ev.roc_summary(sample001, by=["sample"], n_buckets=2).collect()))
    for b in (16, 512):
        assert sorted(map(tuple, ev.gains(sample001, by=["sample"], n_buckets=b).collect())) == ref_g
        assert sorted(map(tuple, ev.roc_summary(sample001, by=["sample"], n_buckets=b).collect())) == ref_r


def test_exact_quantiles_independent_of_bucket_count(spark, sample001):
    probs = [0.01, 0.5, 0.99]
    ref = exact_quantiles(sample001, ["totalprice", "score"], probs, cells=8, most_counted=0)
    for cells, few in ((64, 10), (4096, 100_000)):
        assert exact_quantiles(sample001, ["totalprice", "score"], probs, cells=cells, most_counted=few) == ref


def test_gains_and_sampling_with_a_text_key(spark, sample001):
    from pyspark.sql import functions as F

    from scorelens.operators import sampling

    text = sample001.withColumn("row_id", F.format_string("k%08d", "row_id"))
    a = sorted(map(tuple, ev.gains(sample001, by=["sample"]).collect()))
    assert sorted(map(tuple, ev.gains(text, by=["sample"]).collect())) == a
    tied = text.withColumn("score", F.lit(0.5))
    assert ev.gains(tied, bins=10).count() == 10
    assert sampling.stratified_sample(text).count() == sampling.stratified_sample(sample001).count()


def test_quantiles_need_no_single_task_sketch():
    from scorelens.plans import prefix, selection

    for module in (prefix, selection):
        with open(module.__file__) as f:
            assert "percentile" not in f.read()
