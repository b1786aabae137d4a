"""Stable coarse grouping of categorical features across periods (char_auto_woe).

For each categorical feature, levels of the build sample are sorted by bad
ratio.  Features with at least MIN_LEVELS levels try n = 3..7 groups: the cut
points are weighted quantiles of the level bad ratios (weights = level rows),
duplicates dropped; every cut point must be an observed bad ratio, else the
attempt fails; its border is the *first* level index with that ratio, and a
level's group is the number of interior borders below its index.  Each attempt
is scored by new IV minus the mean PSI of the new groups over the three later
periods; the best score wins (ties: smaller n).  Fewer levels keep one group
per level.  The result is a map (feature, level, grp, woe) plus a trial report
(n_bins / n_groups are 0 on rows without a grouping: status "unchanged" for
small features, "failed" for attempts whose cut points were not observed).

Decisions where the reference is defective (see SURVEY 2D): the winning cut is
reused as scored (no second cut with the winner's group count); if every
attempt fails the levels are kept; null levels are left out, as the
reference's group-by drops them.

Plan shape: one aggregation of (feature, level) with the counts of each period as
columns does all counting.  The levels are dealt by ranges of (feature, bad ratio, level)
(``plans.prefix``), so one feature's levels are spread over tasks; the weighted quantiles are
the levels whose running totals cover the wanted ranks.  What comes to the driver are
cut points: features x probabilities rows.  All attempts are scored by one grouped pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.operators.woe import CELLS, _iv_term, _ks_term, _r, group_woe, long_levels
from scorelens.plans.broadcast import bounded_broadcast, materialize
from scorelens.plans.prefix import running_totals

# Fixed values of the reference's procedure.
ATTEMPTS = (3, 4, 5, 6, 7)  # group counts tried
MIN_LEVELS = 7  # fewer build levels: keep one group per level


def qcut_probs(n: int) -> list[float]:
    """Quantile probabilities as pandas qcut uses them: linspace(0, 1, n+1),
    passed through numpy's percent scale (x*100/100)."""
    q = np.linspace(0.0, 1.0, n + 1)
    return [float(v) for v in np.true_divide(q * 100.0, 100.0)]


def _period_counts(df: DataFrame, features, target: str, sample_col: str, build, offs) -> DataFrame:
    """(feature, level, good, bad, n, good_1, bad_1, n_1, ...): counts of the build sample and of each later period."""
    src = df.where(F.col(sample_col).isin(*build, *offs) & F.col(target).isin(0, 1))
    long = long_levels(src, features, target, [sample_col]).where(F.col("level").isNotNull())
    periods = [("", F.col(sample_col).isin(*build)), *[(f"_{i}", F.col(sample_col) == p) for i, p in enumerate(offs, start=1)]]
    aggs = []
    for suffix, here in periods:
        for name, value in (("good", 0), ("bad", 1)):
            aggs.append(F.count(F.when(here & (F.col(target) == value), 1)).alias(name + suffix))
    counts = long.groupBy("feature", "level").agg(*aggs)
    return counts.select("*", *[(F.col(f"good{s}") + F.col(f"bad{s}")).alias(f"n{s}") for s, _ in periods])


def weighted_quantiles(levels: DataFrame, probs, value: str = "bad_ratio", weight: str = "n", key: str = "feature") -> dict:
    """{key: [quantile per prob]} by rank selection: ``levels`` has running totals cum_/tot_ of ``weight`` in the order of
    ``value``; a level covers the ranks [cum - weight, cum).  Linear between the ranks around p * (total - 1).

    A row of the result is a wanted rank, so keys x probabilities x 2 rows come to the driver."""
    at = lambda p: F.lit(float(p)) * (F.col(f"tot_{weight}") - 1)
    wanted = F.array(*[F.struct(F.lit(2 * i + s).alias("k"), f(at(p)).cast("long").alias("rank")) for i, p in enumerate(probs) for s, f in enumerate((F.floor, F.ceil))])
    covered = F.filter(wanted, lambda x: (x["rank"] >= F.col(f"cum_{weight}") - F.col(weight)) & (x["rank"] < F.col(f"cum_{weight}")))
    rows = levels.select(key, F.col(value).alias("_value"), F.col(f"tot_{weight}").alias("_total"), F.explode(covered).alias("_rank")).collect()
    found: dict = {}
    for r in rows:
        found.setdefault(r[key], ({}, r["_total"]))[0][r["_rank"]["k"]] = r["_value"]
    out = {}
    for k, (values, n) in found.items():
        out[k] = []
        for i, p in enumerate(probs):
            pos, low, high = p * (n - 1), values[2 * i], values[2 * i + 1]
            out[k].append(low if low == high else (math.ceil(pos) - pos) * low + (pos - math.floor(pos)) * high)
    return out


@dataclass
class AutoGroupResult:
    stats: DataFrame  # (feature, level, good, bad, bad_ratio, idx, ...) build sample, with the periods' counts as columns
    attempts: DataFrame  # (feature, n, ok, n_groups, interior)
    levels: DataFrame  # (feature, n, level, idx, grp) for successful attempts
    group_totals: DataFrame  # (feature, n, grp, good, bad, bad_ratio) build sample
    off_groups: DataFrame  # (period, feature, n, grp, good, bad) later periods
    trial_report: DataFrame
    best: DataFrame  # (feature, n, n_groups, score)
    final_map: DataFrame  # (feature, level, grp, woe)
    kept_map: DataFrame  # the part of final_map whose levels stay as they are


def auto_group(df: DataFrame, features, target: str = "target", sample_col: str = "sample",
               build=("dev", "val"), offs=("oft1", "oft2", "oft3"), attempts=ATTEMPTS,
               min_levels: int = MIN_LEVELS, zero_policy: str = "inf") -> AutoGroupResult:
    features, offs = list(features), list(offs)
    spark = df.sparkSession
    # Tables with a row per feature, (feature, attempt) or cut point have a size fixed by the arguments.
    probs = {n: qcut_probs(n) for n in attempts}
    all_probs = sorted({p for ps in probs.values() for p in ps})
    per_feature = lambda d: bounded_broadcast(d, len(features))
    per_attempt = lambda d: bounded_broadcast(d, len(features) * len(attempts))
    suffixes = [f"_{i}" for i in range(1, len(offs) + 1)]
    off_cells = [c + s for s in suffixes for c in CELLS]
    # The one pass over the rows; everything below reads level-sized tables.
    counts = materialize(_period_counts(df, features, target, sample_col, build, offs))
    seen = counts.where("n > 0").withColumn("bad_ratio", F.col("bad") / F.col("n"))
    levels = running_totals(seen, ["feature"], ["bad_ratio", "level"], [*CELLS, "n"], groups=len(features))
    levels = materialize(levels.withColumn("idx", F.col("idx").cast("int")))

    # --- one row per feature: level count, KS, IV, PSI of the levels as they are ----------------
    first = suffixes[0]
    both = F.col(f"n{first}") > 0
    summary = levels.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_levels"), _r(F.max(_ks_term())).alias("old_build_ks"),
        _r(F.coalesce(F.sum(_iv_term()), F.lit(0.0))).alias("old_build_iv"),
        F.sum(F.when(both, F.col("n"))).alias("_b"), F.sum(F.when(both, F.col(f"n{first}"))).alias("_o"))
    summary = materialize(summary)
    p, q = F.col("n") / F.col("_b"), F.col(f"n{first}") / F.col("_o")
    old_psi = levels.where(both).join(per_feature(summary.select("feature", "_b", "_o")), "feature")
    old_psi = old_psi.groupBy("feature").agg(_r(F.sum(F.log(p / q) * (p - q))).alias("old_psi_1"))
    summary = materialize(summary.drop("_b", "_o").join(per_feature(old_psi), "feature", "left"))

    # --- cut points: weighted quantiles that are observed ratios, and their borders --------------
    wide = per_feature(summary.where(F.col("n_levels") >= min_levels).select("feature"))
    quantiles = weighted_quantiles(levels.join(wide, "feature"), all_probs)
    edges = {(f, n): sorted({v[all_probs.index(x)] for x in probs[n]}) for f, v in quantiles.items() for n in attempts}
    cuts = sorted({(f, e) for (f, n), es in edges.items() for e in es})
    cut_table = bounded_broadcast(spark.createDataFrame(cuts, "feature string, bad_ratio double"), len(cuts))
    borders = {(r["feature"], r["bad_ratio"]): r["idx"] for r in levels.join(cut_table, ["feature", "bad_ratio"]).groupBy("feature", "bad_ratio").agg(F.min("idx").alias("idx")).collect()}
    tried = []
    for (f, n), es in edges.items():
        ok = len(es) >= 2 and all((f, e) in borders for e in es[1:])
        interior = sorted(borders[f, e] for e in es[1:-1] if (f, e) in borders)
        tried.append((f, n, ok, len(es) - 1, interior))
    att = spark.createDataFrame(tried, "feature string, n int, ok boolean, n_groups int, interior array<int>")

    # --- all attempts in one grouped pass; levels without build rows fall into group 0 ------------
    fitted = per_attempt(att.where("ok").select("feature", "n", "interior"))
    grp = F.size(F.filter("interior", lambda b: b < F.col("idx")))
    lv = levels.select("feature", "level", "idx").join(fitted, "feature").select("feature", "n", "level", "idx", grp.alias("grp"))
    placed = counts.where("n = 0").select("feature", "level", *CELLS, *off_cells, F.lit(-1).alias("idx"))
    placed = levels.select("feature", "level", *CELLS, *off_cells, "idx").unionByName(placed)
    ng = placed.join(fitted, "feature").groupBy("feature", "n", grp.alias("grp")).agg(*[F.sum(c).alias(c) for c in [*CELLS, *off_cells]])
    ng = materialize(ng)
    off = None
    for s, period in zip(suffixes, offs):
        rows = ng.where(F.col(f"good{s}") + F.col(f"bad{s}") > 0)
        rows = rows.select(F.lit(period).alias("period"), "feature", "n", "grp", *[F.col(c + s).alias(c) for c in CELLS])
        off = rows if off is None else off.unionByName(rows)

    # --- metrics of an attempt: its groups are at most as many as it tried for --------------------
    inside = Window.partitionBy("feature", "n")
    upto = inside.orderBy("grp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows_of = lambda s: F.col(f"good{s}") + F.col(f"bad{s}")
    m = ng.select("*", *[F.sum(c).over(upto).alias(f"cum_{c}") for c in CELLS], *[F.sum(c).over(inside).alias(f"tot_{c}") for c in CELLS])
    psis = []
    for i, s in enumerate(suffixes, start=1):
        both = rows_of(s) > 0
        m = m.withColumn(f"_p{i}", F.when(both, rows_of("") / F.sum(F.when(both, rows_of(""))).over(inside)))
        m = m.withColumn(f"_q{i}", F.when(both, rows_of(s) / F.sum(F.when(both, rows_of(s))).over(inside)))
        psis.append(_r(F.sum(F.log(F.col(f"_p{i}") / F.col(f"_q{i}")) * (F.col(f"_p{i}") - F.col(f"_q{i}")))).alias(f"new_psi_{i}"))
    new = m.groupBy("feature", "n").agg(_r(F.max(_ks_term())).alias("new_build_ks"), _r(F.coalesce(F.sum(_iv_term()), F.lit(0.0))).alias("new_build_iv"), *psis)

    # --- trial report ----------------------------------------------------------------------------
    psi_cols = [f"new_psi_{i}" for i in range(1, len(offs) + 1)]
    zero = F.lit(0.0)
    metric = lambda c: F.when(F.col("ok"), F.coalesce(F.col(c), zero)).otherwise(zero).alias(c)
    big = att.join(per_attempt(new), ["feature", "n"], "left").join(per_feature(summary), "feature").select(
        "feature", F.col("n").alias("n_bins"), F.when(F.col("ok"), F.col("n_groups")).otherwise(F.lit(0)).alias("n_groups"),
        F.when(F.col("ok"), F.lit("regrouped")).otherwise(F.lit("failed")).alias("status"),
        *[metric(c) for c in ("old_build_ks", "new_build_ks", "old_build_iv", "new_build_iv", "old_psi_1", *psi_cols)])
    small = summary.where(F.col("n_levels") < min_levels).select(
        "feature", F.lit(0).alias("n_bins"), F.lit(0).alias("n_groups"), F.lit("unchanged").alias("status"),
        F.coalesce("old_build_ks", zero).alias("old_build_ks"), zero.alias("new_build_ks"),
        F.coalesce("old_build_iv", zero).alias("old_build_iv"), zero.alias("new_build_iv"),
        F.coalesce("old_psi_1", zero).alias("old_psi_1"), *[zero.alias(c) for c in psi_cols])
    rep = big.unionByName(small)
    total = sum((F.col(c) for c in psi_cols[1:]), F.col(psi_cols[0]))
    rep = rep.withColumn("psi_sum", _r(total / F.lit(float(len(psi_cols)))))
    rep = materialize(rep.withColumn("score", _r(F.col("new_build_iv") - F.col("psi_sum"))))

    # --- best attempt and final map ------------------------------------------------------------
    w = Window.partitionBy("feature").orderBy(F.desc("score"), F.asc("n_bins"))  # one row per attempt
    best = (rep.where(F.col("status") == "regrouped").withColumn("_r", F.row_number().over(w))
            .where("_r = 1").select("feature", F.col("n_bins").alias("n"), "n_groups", "score"))
    winners = per_feature(best.select("feature", "n"))
    win_woe = group_woe(ng.join(winners, ["feature", "n"]).select("feature", "grp", *CELLS), group_col="grp", zero_policy=zero_policy, groups=len(features))
    regrouped = lv.join(winners, ["feature", "n"]).join(bounded_broadcast(win_woe, len(features) * (max(attempts) + 1)), ["feature", "grp"])
    regrouped = regrouped.select("feature", "level", "grp", "woe")
    kept = levels.join(winners.select("feature"), "feature", "left_anti")  # small path or all attempts failed
    kept_map = group_woe(kept.withColumn("grp", F.col("idx")), group_col="level", part=("feature", "grp"), zero_policy=zero_policy)
    kept_map = kept_map.select("feature", "level", "grp", "woe")
    final = regrouped.unionByName(kept_map)

    ratio = F.col("bad") / (F.col("good") + F.col("bad"))
    return AutoGroupResult(stats=levels, attempts=att, levels=lv, group_totals=ng.select("feature", "n", "grp", *CELLS, ratio.alias("bad_ratio")),
                           off_groups=off, trial_report=rep, best=best, final_map=final, kept_map=kept_map)


def offtime_apply(df: DataFrame, group_map: DataFrame, features, value_col: str = "grp", fill=0) -> DataFrame:
    """Map levels of another sample into fitted groups; unseen levels -> group 0."""
    from scorelens.operators.woe import woe_apply

    return woe_apply(df, group_map, features, fill=fill, value_col=value_col)
