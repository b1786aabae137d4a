import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from scorelens.oracle_check import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_oracles_match_at_sf0001(spark):
    con = duck(SF)
    names = ["gains_by_sample", "sample_metrics", "score_psi", "woe_map", "char_auto_woe", "describe_report",
             "stratified_sample", "bivar_many"]
    q, o = E.queries(), E.oracle_sql()
    for n in names:
        r = compare(spark, SF, n, q[n], o[n], con)
        assert r["cols_ok"] and r["hash_ok"], r
