"""Parquet table access and the `sample` view (one scored row per order).

The view joins orders to customer (a shuffle or AQE-chosen join, sizes grow
with the data) and to nation/region, which are fixed-size dimension tables
(25 and 5 rows by definition), so those two are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = ("dev", "val", "oft1", "oft2", "oft3")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sample_label(orderkey: Column, orderdate: Column) -> Column:
    yr = F.year(orderdate)
    split_key = F.substring(F.md5(F.concat(orderkey.cast("string"), F.lit("#split"))), 1, 4)
    return (
        F.when(yr == 1999, "oft1")
        .when(yr == 2000, "oft2")
        .when(yr >= 2001, "oft3")
        .when(split_key < F.lit("b333"), "dev")
        .otherwise("val")
    )


def sample_view(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """The `sample` view of FIXTURES.md part 3 as a DataFrame.

    ``orders`` may be given instead of the parquet table, e.g. a streaming
    DataFrame: the joins to the dimension tables are then stream-static joins.
    """
    o = (orders if orders is not None else load_table(spark, sf_dir, "orders")).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    c = load_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = load_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = load_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # nation/region are fixed-size code tables: broadcast is size-bounded.
    j = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    key = F.col("o_orderkey")
    is_f = F.col("o_orderstatus") == "F"
    score = ((key * 7919) % 1000 + 1 + F.when(is_f, 250).otherwise(0)).cast("double") / F.lit(1251.0)
    return j.select(
        key.alias("row_id"),
        _sample_label(key, F.col("o_orderdate")).alias("sample"),
        F.when(is_f, 1).otherwise(0).alias("target"),
        score.alias("score"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("balance"),
        F.col("o_totalprice").alias("totalprice"),
        F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("acctbal"),
        F.when(key % 5 < 4, F.lit(None)).otherwise(F.col("c_acctbal")).alias("sparse_num"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.col("n_name").alias("nation"),
        F.when(key % 11 == 0, F.col("n_name"))
        .otherwise(F.concat(F.col("n_name"), F.lit(","), F.col("r_name")))
        .alias("location"),
        F.when(key % 13 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("segment_null"),
        F.when(key % 3 == 0, F.concat(F.lit("x"), key.cast("string")))
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("num_text"),
    )


# Same view as SQL; oracle queries carry it as a CTE named `sample`.
SAMPLE_SQL = """
select o.o_orderkey as row_id,
  case when year(o.o_orderdate) = 1999 then 'oft1'
       when year(o.o_orderdate) = 2000 then 'oft2'
       when year(o.o_orderdate) >= 2001 then 'oft3'
       when substr(md5(concat(cast(o.o_orderkey as varchar), '#split')), 1, 4) < 'b333' then 'dev'
       else 'val' end as sample,
  case when o.o_orderstatus = 'F' then 1 else 0 end as target,
  cast((o.o_orderkey * 7919) % 1000 + 1
       + case when o.o_orderstatus = 'F' then 250 else 0 end as double) / 1251.0e0 as score,
  cast(o.o_totalprice as decimal(18,2)) as balance,
  o.o_totalprice as totalprice,
  case when c.c_acctbal < 0 then null else c.c_acctbal end as acctbal,
  case when o.o_orderkey % 5 < 4 then null else c.c_acctbal end as sparse_num,
  c.c_mktsegment as segment,
  o.o_orderpriority as priority,
  n.n_name as nation,
  case when o.o_orderkey % 11 = 0 then n.n_name
       else concat(n.n_name, ',', r.r_name) end as location,
  case when o.o_orderkey % 13 = 0 then null else c.c_mktsegment end as segment_null,
  case when o.o_orderkey % 3 = 0 then 'x' || cast(o.o_orderkey as varchar)
       else cast(o.o_totalprice as varchar) end as num_text
from orders o
join customer c on o.o_custkey = c.c_custkey
join nation n on c.c_nationkey = n.n_nationkey
join region r on n.n_regionkey = r.r_regionkey
"""
