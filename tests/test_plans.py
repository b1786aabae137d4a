"""Plan properties: row-level work stays JVM-side (no Python evaluation nodes)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scorelens.operators import model as M  # noqa: E402
from scorelens.registry import QUERIES  # noqa: E402
from scorelens.sources.tables import sample_view  # noqa: E402
from scorelens.spec import SAMPLE_SPEC  # noqa: E402

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "PythonUDF", "MapInArrow")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_evaluation_in_query_plans(spark):
    names = ["gains_by_sample", "sample_metrics", "score_psi", "score_distribution", "woe_fit_apply",
             "char_auto_woe", "iv_ranking", "profile_describe", "bivar_many", "stratified_sample",
             "dev_val_split", "is_num", "location_split", "smote_oversample"]
    sample = sample_view(spark, SF)
    fitted = M.fit_model(sample.where("sample = 'dev'"), SAMPLE_SPEC, n_estimators=3)
    plans = {n: _plan(QUERIES[n](spark, SF)) for n in names} | {"score_rows": _plan(M.score(fitted, sample, SAMPLE_SPEC))}
    for n, plan in plans.items():
        assert not any(p in plan for p in PYTHON_NODES), n


def test_scan_reads_only_needed_columns(spark):
    spark.catalog.clearCache()  # inspect the parquet scans, not a cached view from another test
    plan = QUERIES["gains_table"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # the customer scan needs only the join key and nation key for the score view
    assert "c_name" not in plan and "c_mktsegment" not in plan
