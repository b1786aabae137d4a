"""Every oracle statement must plan in DuckDB, and return the same column names as
its Spark query's schema (checked cheaply at sf0.001 without running Spark jobs)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scorelens.oracle_check import duck  # noqa: E402
from scorelens.registry import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_oracles_plan_in_duckdb():
    con = duck(SF)
    for name, sql in ORACLES.items():
        con.execute(f"explain {sql}")
        assert name in QUERIES


def test_oracle_column_names_match_spark_schema(spark):
    con = duck(SF)
    cheap = ["gains_table", "ks_max", "score_band_20", "woe_map", "category_stats", "class_balance",
             "crosstab_margins", "bivar_categorical", "split_x_y", "location_split", "filter_class"]
    for name in cheap:
        cols = [d[0] for d in con.execute(f"select * from ({ORACLES[name]}) limit 0").description]
        assert sorted(cols) == sorted(QUERIES[name](spark, SF).columns), name
