import hashlib
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from scorelens.functions.predicates import is_num
from scorelens.operators import prep, sampling
from scorelens.sources.csv import read_csv_sample


def test_is_num_follows_python_float(spark):
    vals = ["1_000", "1d", " 1.5 ", "nan", "-inf", "abc", "1e5", ".5", "5.", "1__0", "", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(is_num("s")).collect()]

    def py(v):
        if v is None:
            return None
        try:
            float(v)
            return True
        except ValueError:
            return False

    assert got == [py(v) for v in vals]


def test_nan_ratio_equality_is_kept(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, float("nan") if False else 7.0)],
                               "a int, b double")
    rep = {r["column_name"]: r["kept"] for r in prep.sparse_column_report(df, 0.5).collect()}
    assert rep["b"] is True
    df2 = spark.createDataFrame([(1, None), (2, None), (3, None), (4, 7.0)], "a int, b double")
    assert prep.drop_sparse_columns(df2, 0.5).columns == ["a"]


def test_fill_constant_fills_strings_and_nan(spark):
    df = spark.createDataFrame([(None, None), ("x", float("nan"))], "s string, d double")
    out = prep.fill_constant(df, 0).collect()
    assert out[0]["s"] == "0" and out[0]["d"] == 0.0 and out[1]["d"] == 0.0


def test_fill_mean(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "d double")
    assert [r[0] for r in prep.fill_mean(df).collect()] == [1.0, 2.0, 3.0]


def test_csv_ragged_rows(spark):
    d = tempfile.mkdtemp(prefix="csv-ragged-")
    with open(os.path.join(d, "s.csv"), "w") as f:
        f.write("a,b,c\n1,x,2.5\n2,(NULL),3.5\n3,y\n4,z,1.0,EXTRA\n")
    out = read_csv_sample(spark, d, "a int, b string, c double").orderBy("a").collect()
    assert [r["a"] for r in out] == [1, 2, 3]
    assert out[1]["b"] is None and out[2]["c"] is None


def test_location_split_missing_part_is_null(spark):
    df = spark.createDataFrame([("p,c",), ("p",), (None,)], "mobile_location string")
    out = prep.location_split(df, ("mobile_location",)).collect()
    assert (out[0]["mobile_loc_prov"], out[0]["mobile_loc_city"]) == ("p", "c")
    assert (out[1]["mobile_loc_prov"], out[1]["mobile_loc_city"]) == ("p", None)


def _md5_order(keys, seed):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{k}#{seed}".encode()).hexdigest(), k))


def test_stratified_sample_sizes_and_rows(spark):
    rows = [(i, 1 if i % 3 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "row_id long, target int")
    got = {r["row_id"] for r in sampling.stratified_sample(df, digits=1, few=3).collect()}
    exp = set()
    for cls in (0, 1):
        keys = [k for k, y in rows if y == cls]
        exp |= set(_md5_order(keys, 1)[: math.floor(0.7 * len(keys))])
    assert got == exp


def test_dev_val_split_exact_sizes(spark):
    df = spark.createDataFrame([(i,) for i in range(1001)], "row_id long")
    out = sampling.dev_val_split(df, digits=2, few=5).groupBy("split").count().collect()
    d = {r["split"]: r["count"] for r in out}
    assert d["val"] == math.ceil(0.3 * 1001) and d["dev"] == 1001 - math.ceil(0.3 * 1001)


def test_fill_constant_keeps_the_value(spark):
    df = spark.createDataFrame([(None, None, None, None)], "i int, d date, t timestamp, m decimal(10,1)")
    out = prep.fill_constant(df, 0.5).first()
    assert (out["i"], out["m"]) == (0.5, 0.5) and out["d"] is None and out["t"] is None
    assert prep.fill_na(df, "0.5").first()["i"] == 0.5 and prep.fill_constant(df, 3).schema["i"].dataType.simpleString() == "int"


def test_location_split_of_an_absent_column_raises(spark):
    with pytest.raises(ValueError, match="idcard_location"):
        prep.location_split(spark.createDataFrame([("p,c",)], "mobile_location string"))
