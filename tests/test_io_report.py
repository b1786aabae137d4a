import json
import tempfile

import pytest

from scorelens.operators import profile as P
from scorelens.operators.report import write_bundle
from scorelens.sources.csv import export_table, mapping_json, read_csv_sample, write_csv


def test_describe_approx_close_to_exact(spark, sample001):
    ex = {r["column_name"]: r for r in P.describe(sample001, ["totalprice"]).collect()}
    ap = {r["column_name"]: r for r in P.describe(sample001, ["totalprice"], approx=True).collect()}
    e, a = ex["totalprice"], ap["totalprice"]
    assert e["count"] == a["count"] and e["mean"] == a["mean"]
    assert abs(e["p50"] - a["p50"]) <= 0.01 * (e["max"] - e["min"])


def test_mapping_json_round_trips(spark):
    m = spark.createDataFrame([("f", "a", 0.5), ("f", None, -1.0), ("g", "x", 2.0)],
                              "feature string, level string, woe double")
    out = sorted((r["feature"], *json.loads(r["mapping"]).items()) for r in mapping_json(m).collect())
    assert out == [("f", ("a", 0.5)), ("f", ("null", -1.0)), ("g", ("x", 2.0))]


def test_mapping_json_tells_a_missing_level_from_one_named_null(spark):
    m = spark.createDataFrame([("f", "null", 0.5), ("f", None, -1.0)], "feature string, level string, woe double")
    assert sorted(r["mapping"] for r in mapping_json(m).collect()) == ['{"(null)":-1.0}', '{"null":0.5}']


def test_csv_keeps_quotes_line_breaks_and_blanks(spark):
    rows = [(1, 'say "hi", ok', " pad "), (2, "two\nlines", ""), (3, "a,b", '"'), (4, None, "x")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    path = write_csv(df, tempfile.mkdtemp(prefix="csv-quotes-") + "/t")
    assert [tuple(r) for r in read_csv_sample(spark, path, df.schema).orderBy("k").collect()] == rows


def test_csv_value_of_the_wrong_type_raises(spark):
    path = write_csv(spark.createDataFrame([("1",), ("abc",)], "k string"), tempfile.mkdtemp(prefix="csv-type-") + "/t")
    assert read_csv_sample(spark, path, "k string").count() == 2
    with pytest.raises(Exception, match="column k is no int: abc"):
        read_csv_sample(spark, path, "k int").collect()


def test_export_table_comes_back(spark, sample001):
    some = sample001.select("row_id", "location", "segment_null").limit(50)
    some.createOrReplaceTempView("export_me")
    path = export_table(spark, "export_me", tempfile.mkdtemp(prefix="export-") + "/t")
    back = read_csv_sample(spark, path, some.schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, some.collect()))


def test_write_bundle_writes_every_table(spark, sample001):
    tables = {"balance": P.class_balance(sample001), "cross": P.crosstab_margins(sample001, ["segment"])}
    locs = write_bundle(tables, tempfile.mkdtemp(prefix="bundle-"))
    for name, loc in locs.items():
        assert spark.read.parquet(loc).count() == tables[name].count()
