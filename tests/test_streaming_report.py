import pytest
from pyspark.sql import functions as F

from scorelens.operators import monitor as mon
from scorelens.operators import profile as P
from scorelens.operators.model import gbt_pipeline
from scorelens.operators.report import model_report, report_summary, score_report
from scorelens.operators.woe import woe_map
from scorelens.sources.tables import sample_view
from scorelens.spec import SAMPLE_SPEC, FeatureSpec
from scorelens.streaming import monitor as ST

SF = "/root/testdata/sf0.001"


def test_stream_band_counts_equal_batch(spark):
    stream = sample_view(spark, SF, orders=ST.orders_stream(spark, SF))
    got = {(r["sample"], r["band"]): r["n"] for r in ST.run_available(spark, ST.band_counts_stream(stream)).collect()}
    batch = sample_view(spark, SF)
    exp = {}
    for s in ("dev", "val", "oft1", "oft2", "oft3"):
        for r in mon.band_counts(batch.where(F.col("sample") == s)).collect():
            exp[(s, r["band"])] = r["n"]
    assert got == exp


def test_score_report_tables(spark, sample001):
    t = score_report(sample001, spec=SAMPLE_SPEC)
    assert {"class_balance", "score_dist", "gains", "metrics", "histogram", "psi", "describe", "bivar"} <= set(t)
    summ = report_summary(t).collect()
    assert len(summ) == 5
    dev = [r for r in summ if r["sample"] == "dev"][0]
    assert dev["psi"] is None and 0.5 < dev["auc"] <= 1.0
    assert t["gains"].count() == 5 * 20


def test_stream_over_a_folder_of_part_files(spark, tmp_path):
    for t in ("customer", "nation", "region"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{SF}/orders.parquet").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    stream = ST.orders_stream(spark, str(tmp_path), max_files_per_trigger=2)
    counts = stream.groupBy().agg(F.count(F.lit(1)).alias("n"))
    assert ST.run_available(spark, counts).first()["n"] == 1500


def test_every_feature_is_in_the_report(spark, sample001):
    flag = sample001.withColumn("flag", (F.col("row_id") % 4).cast("double"))
    spec = FeatureSpec(char=SAMPLE_SPEC.char, num=(*SAMPLE_SPEC.num, "flag"), target=SAMPLE_SPEC.target)
    t = score_report(flag, spec=spec, psi=False)
    names = {r[0] for k in ("bivar", "bivar_levels") for r in t[k].select("column_name").distinct().collect()}
    assert names == {*spec.char, *spec.num}
    order = ["flag", "totalprice"]
    top = P.bivar(flag, spec.char, spec.num, by=["sample"], order=order, top=2)
    assert {(r["position"], r["column_name"], r["kind"]) for r in top.collect()} == {(1, "flag", "values"), (2, "totalprice", "bins")}


def test_psi_of_a_sample_without_rows_is_a_null_row(spark, sample001):
    some = sample001.where("sample in ('dev', 'val')")
    out = {r["sample"]: r["psi"] for r in mon.psi_monitor(some, others=("val", "oft1")).collect()}
    assert out["val"] is not None and out["oft1"] is None
    assert [r["psi"] for r in mon.psi_monitor(some, others=("oft1",)).collect()] == [None]


def test_woe_refuses_a_target_that_is_not_binary(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "f string, target int")
    with pytest.raises(Exception, match="target must be 0 or 1, not 2"):
        woe_map(df, ["f"], "target").collect()


def test_model_report_sheets_and_defaults(spark, sample001):
    t = model_report(sample001, SAMPLE_SPEC, n_estimators=3)
    params = {r["name"]: r["value"] for r in t["params"].collect()}
    assert params["n_estimators"] == "3" and params["max_depth"] == "3"
    assert {r["sample"] for r in t["samples"].collect()} == {"dev", "val", "oft1", "oft2", "oft3"}
    assert abs(sum(r["importance"] for r in t["importance"].collect()) - 1) < 1e-6
    order = [r["name"] for r in t["importance"].collect()]
    assert [r[0] for r in t["bivar_ranked"].select("column_name").distinct().join(t["bivar_ranked"].groupBy("column_name").agg({"position": "min"}), "column_name").orderBy("min(position)").collect()] == order
    assert {r["column_name"] for r in t["describe"].collect()} == set(order) and t["dtypes"].count() == len(sample001.columns)
    trees = gbt_pipeline(["a"]).trees
    assert (trees.n_estimators, trees.reg_alpha, trees.reg_lambda) == (200, 0.01, 0.01)
    assert gbt_pipeline(["a"], reg_alpha=None, reg_lambda=None).trees.getMaxIter() == 200
    with pytest.raises(ValueError, match="penalties"):
        gbt_pipeline(["a"], reg_alpha=-0.1)
