"""Bench: headline workflows of the reference at $BENCH_SF_DIR on local[$BENCH_CPUS].

The `sample` view is built once from orders/customer/nation/region and written
as Parquet to a scratch folder (timed as `load_sample`), as the reference loads
its sample once; every workflow then reads that table and runs to completion
into Spark's no-op sink.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import functions as F

    from scorelens.operators import autogroup as AG
    from scorelens.operators import evaluate as ev
    from scorelens.operators import monitor as mon
    from scorelens.operators import profile as prof
    from scorelens.operators import sampling as smp
    from scorelens.operators import woe as W
    from scorelens.plans.scoretable import score_table
    from scorelens.operators import report as rep
    from scorelens.session import clear_scratch, local_session
    from scorelens.sources.tables import SAMPLES, sample_view
    from scorelens.spec import SAMPLE_SPEC as SPEC

    parts = int(os.environ.get("BENCH_PARTITIONS", str(max(int(cpus) if cpus != "*" else 8, 1))))
    spark = local_session(cpus, shuffle_partitions=parts, app="scorelens-bench")
    scratch = tempfile.mkdtemp(prefix="scorelens-bench-")

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}

    tracker = spark.sparkContext.statusTracker()
    jobs: dict[str, int] = {}

    def timed(name, fn):
        j0 = len(tracker.getJobIdsForGroup(None))
        t = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t, 3)
        jobs[name] = len(tracker.getJobIdsForGroup(None)) - j0

    # warm-up (JVM start, class loading) is not timed
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()

    path = f"{scratch}/sample"
    timed("load_sample", lambda: sample_view(spark, sf_dir).write.mode("overwrite").parquet(path))
    s = spark.read.parquet(path)
    dev = s.where(F.col("sample") == "dev")
    char, num = list(SPEC.char), list(SPEC.num)

    def gains_and_metrics():
        table = score_table(s, by=["sample"])
        run(ev.gains(s, by=["sample"], table=table, groups=SAMPLES))
        run(ev.roc_summary(s, by=["sample"], table=table, groups=SAMPLES))

    workflows = {
        "gains_ks_auc_by_sample": gains_and_metrics,
        "fraud_report_100_bins": lambda: run(ev.gains(s, bins=100, by=["sample"], balance="balance",
                                                      groups=SAMPLES)),
        "psi_monitor": lambda: run(mon.psi_monitor(s, k=20)),
        "score_distribution": lambda: run(mon.score_distribution(s)),
        "score_histogram": lambda: run(mon.score_histogram(s, groups=SAMPLES)),
        "char_auto_woe": lambda: run(AG.auto_group(s, char, "target").final_map),
        "woe_fit_apply": lambda: run(W.woe_fit_apply(dev, s.where(F.col("sample") != "dev"), char, "target")),
        "iv_ranking": lambda: run(W.iv_ranking(s, char, num, "target")),
        "describe": lambda: run(prof.describe(s, num + ["score"])),
        "bivar_by_sample": lambda: run(prof.bivar_numeric(s, num, by=["sample"])),
        "crosstab_margins": lambda: run(prof.crosstab_margins(s, char)),
        "stratified_sample": lambda: run(smp.stratified_sample(s)),
        "dev_val_split": lambda: run(smp.dev_val_split(s)),
        "bivar_all_features": lambda: run(prof.bivar(s, char, num, by=["sample"])),
        "roc_points": lambda: run(ev.roc_points(s, by=["sample"], groups=SAMPLES)),
        "model_report": lambda: run(rep.report_summary(rep.model_report(s, SPEC))),
    }
    for name, fn in workflows.items():
        timed(name, fn)

    total = round(sum(times.values()), 3)
    if os.environ.get("BENCH_JOBS"):
        print(json.dumps({"spark_jobs": jobs}), file=sys.stderr)
    print(json.dumps({"metric": "scorelens_headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir).replace("sf", ""), "cpus": cpus}))
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
