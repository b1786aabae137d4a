"""Edges of reading and filling: values beyond a type, rows with too many fields."""

from pyspark.sql import functions as F

from scorelens.operators import prep
from scorelens.sources import csv as C


def test_fill_of_a_value_that_the_type_cannot_hold(spark):
    df = spark.createDataFrame([(None, None, None)], "i int, d decimal(4,2), l long")
    out = prep.fill_constant(df, 3_000_000_000)
    assert dict(out.dtypes) == {"i": "double", "d": "double", "l": "bigint"}
    assert tuple(out.first()) == (3e9, 3e9, 3_000_000_000)
    assert dict(prep.fill_constant(df, 50).dtypes) == {"i": "int", "d": "decimal(4,2)", "l": "bigint"}
    assert prep.fill_constant(df, 500).first()["d"] == 500.0


def test_rows_with_too_many_fields_go_even_if_the_last_is_empty(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a,b\n1,x\n2,y,\n3,z,(NULL)\n4\n5,"q,""r"",s"\n6,"l\nm"\n7,"n",o,p\n8,\n')
    for multi in (True, False):
        text = p.read_text() if multi else p.read_text().replace('"l\nm"', "lm")
        q = tmp_path / f"y{multi}.csv"
        q.write_text(text)
        rows = {r["a"]: r["b"] for r in C.read_csv_sample(spark, str(q), "a int, b string", multi_line=multi).collect()}
        assert rows == {1: "x", 4: None, 5: 'q,"r",s', 6: "l\nm" if multi else "lm", 8: None}
        again = C.read_csv_sample(spark, str(q), "a int, b string", multi_line=multi)
        assert again.select(F.max("a")).first()[0] == 8 and again.count() == 5


def test_broadcast_is_checked_by_rows_and_bytes(spark):
    from scorelens.plans.broadcast import checked_broadcast

    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array("id", "id").alias("a"))
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(checked_broadcast(df)) and not hinted(checked_broadcast(df, max_rows=99)) and not hinted(checked_broadcast(df, max_bytes=90_000))
    assert hinted(checked_broadcast(df.limit(0)))
