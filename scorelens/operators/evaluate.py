"""Score evaluation: gains tables (by count and by balance), KS, AUC, ROC points.

Semantics follow the reference's report functions:

* rows are ordered by score descending; ties are broken by the row key (the
  reference's sort is unstable, so any tie order is one of its outcomes);
* ``bin_len = floor(n / bins)``; bin i holds rows ``bin_len*(i-1) .. bin_len*i-1``;
  the last ``n mod bins`` rows are in no bin, yet totals include them;
* cumulative bad/good counts per bin, shares over all rows, the average score
  of the bin alone, and |cum bad share - cum good share|;
* KS = max |TPR - FPR| over distinct thresholds, AUC = Mann-Whitney, both from
  integer numerators.

Physical plan: rows are collapsed to distinct scores and ordered once
(``plans.scoretable``); distinct scores inside a bin are summed whole, and only the rows of
tied scores that a bin border cuts (at most groups x bins scores) are read again and ranked by key.
A missing score (null or NaN) stands last, in the bins but in no average.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.plans.broadcast import bounded_broadcast, checked_broadcast
from scorelens.plans.prefix import next_in_order, null_safe_join, running_totals
from scorelens.plans.scoretable import SCORE, ScoreTable, clean_score, measures, score_table

TIED_ROWS = 1_000_000  # rows of one score that a window may hold
DIGITS = 10  # rounding of ratios in outputs, so equal values hash equally


def _r(c):
    return F.round(c, DIGITS)


def _ratio(num, den):
    return _r(F.try_divide(num.cast("double"), den.cast("double")))


def _restrict(df: DataFrame, by: list[str], groups) -> DataFrame:
    """Keep only the declared values of a single grouping column (makes the
    group count a proven bound)."""
    if groups is None:
        return df
    if len(by) != 1:
        raise ValueError("groups needs exactly one `by` column")
    return df.where(F.col(by[0]).isin(list(groups)))


def _n_groups(groups) -> int | None:
    return None if groups is None else len(list(groups))


def _small_side(small: DataFrame, per_group: int, by: list[str], groups) -> DataFrame:
    """Broadcast a per-group bounded table: proven bound when the groups are
    known (none, or declared), otherwise a counted size check."""
    if not by:
        return bounded_broadcast(small, per_group)
    if groups is not None:
        return bounded_broadcast(small, per_group * len(list(groups)))
    return checked_broadcast(small)


def _bin_of(pos: str, bins: int):
    """1-based bin of a 0-based position (a SQL expression over columns), or null
    for remainder rows.  Integer division keeps it exact at any row count."""
    return F.expr(f"case when bin_len > 0 and ({pos}) < bin_len * {int(bins)} "
                  f"then ({pos}) div bin_len + 1 end")


def gains(
    df: DataFrame,
    score: str = "score",
    target: str = "target",
    key: str = "row_id",
    bins: int = 20,
    by: tuple[str, ...] | list[str] = (),
    balance: str | None = None,
    table: ScoreTable | None = None,
    n_buckets: int | None = None,
    groups=None,
) -> DataFrame:
    """Gains table, one row per (by..., bin).  See module docstring.

    Without ``balance``: cum_bad_num, cum_good_num, cum_bad_pct, cum_good_pct,
    avg_score, ks_value.  With ``balance`` the 13-column balance report.
    ``table`` is a score table of ``df`` (grouped by ``by``, with this balance); it is built if not given,
    in ``n_buckets`` ranges.  Actions: the score table, and a look whether a border cuts a tie.
    """
    by = list(by)
    base = _restrict(df, by, groups)
    table = table or score_table(base, score, target, by, balance, n_buckets, _n_groups(groups))
    sums = measures(target, balance)
    names = [c for c in sums if c not in ("pos", "neg")]
    st = _restrict(table.rows, by, groups).withColumn("off_n", F.col("cum_n") - F.col("n"))
    st = st.withColumn("bin_len", F.expr(f"tot_n div {int(bins)}"))
    st = st.withColumn("first_bin", _bin_of("off_n", bins)).withColumn("last_bin", _bin_of("off_n + n - 1", bins))
    whole = F.col("first_bin").eqNullSafe(F.col("last_bin"))
    per_bin = st.where(whole & F.col("first_bin").isNotNull()).select(*by, F.col("first_bin").alias("bin"), *names)

    cut = st.where(~whole).select(*by, SCORE, "off_n", "bin_len", F.col("n").alias("tied"))
    most = cut.agg(F.max("tied")).first()[0]
    if most is not None:
        # at most `bins` cut scores per group
        small = _small_side(cut, bins, by, groups)
        rows = base.select(*by, clean_score(base, score).alias(SCORE), target, key, *([balance] if balance else []))
        rows = null_safe_join(rows, small, [*by, SCORE])
        if most <= TIED_ROWS:
            ranked = rows.withColumn("idx", F.row_number().over(Window.partitionBy(*by, SCORE).orderBy(F.asc(key))) - 1)
        else:  # a tie that is too large for one window is spread over ranges of the key
            ranked = running_totals(rows, [*by, SCORE], [F.asc(key)], [], n_buckets)
        ranked = ranked.withColumn("pos", F.col("off_n") + F.col("idx")).withColumn("bin", _bin_of("pos", bins))
        cut_part = ranked.where(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(*[sums[c].alias(c) for c in names])
        per_bin = per_bin.unionByName(cut_part)
    per_bin = per_bin.groupBy(*by, "bin").agg(*[F.sum(c).alias(c) for c in names])
    # The first score of each group (offset 0) carries the group totals.
    totals = st.where(F.col("off_n") == 0).select(*by, *[f"tot_{c}" for c in names if f"tot_{c}" in st.columns])
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins)).cast("array<bigint>")))
    g = null_safe_join(grid, per_bin, [*by, "bin"], "left")
    for c in names:
        g = g.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast(per_bin.schema[c].dataType)))
    wc = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("cbad", F.sum("bad").over(wc)).withColumn("cgood", F.sum("good").over(wc))
    bad_pct = _ratio(F.col("cbad"), F.col("tot_bad"))
    good_pct = _ratio(F.col("cgood"), F.col("tot_good"))
    if not balance:
        return g.select(
            *by,
            F.col("bin").cast("int").alias("bin"),
            F.col("cbad").cast("long").alias("cum_bad_num"),
            F.col("cgood").cast("long").alias("cum_good_num"),
            bad_pct.alias("cum_bad_pct"),
            good_pct.alias("cum_good_pct"),
            _r(F.try_divide(F.col("ssum"), F.col("scnt").cast("double"))).alias("avg_score"),
            _r(F.abs(bad_pct - good_pct)).alias("ks_value"),
        )
    g = g.withColumn("cbbal", F.sum("bbal").over(wc)).withColumn("cgbal", F.sum("gbal").over(wc))
    return g.select(
        *by,
        F.col("bin").cast("int").alias("bin"),
        F.col("cbad").cast("long").alias("cum_bad_num"),
        F.col("tot_bad").cast("long").alias("tot_bad_num"),
        bad_pct.alias("cum_bad_pct"),
        F.col("cgood").cast("long").alias("cum_good_num"),
        F.col("tot_good").cast("long").alias("tot_good_num"),
        good_pct.alias("cum_good_pct"),
        _r(F.abs(bad_pct - good_pct)).alias("ks_value"),
        F.round(F.col("cbbal").cast("double"), 2).alias("cum_bad_bal"),
        F.round(F.col("tot_bbal").cast("double"), 2).alias("tot_bad_bal"),
        _ratio(F.col("cbbal"), F.col("tot_bbal")).alias("cum_bad_bal_pct"),
        F.round(F.col("cgbal").cast("double"), 2).alias("cum_good_bal"),
        F.round(F.col("tot_gbal").cast("double"), 2).alias("tot_good_bal"),
        _ratio(F.col("cgbal"), F.col("tot_gbal")).alias("cum_good_bal_pct"),
    )


def roc_table(
    df: DataFrame,
    score: str = "score",
    target: str = "target",
    key: str = "row_id",
    by: tuple[str, ...] | list[str] = (),
    table: ScoreTable | None = None,
    n_buckets: int | None = None,
    groups=None,
    pos_label: int = 1,
) -> DataFrame:
    """One row per (by..., distinct score): pos, neg at that score and the
    cumulative tp/fp at threshold >= score, plus group totals P and N (rows without a score left out).

    Read off the score table (a hot tie is one row).  ``pos_label`` 0 takes class 0 for the positive one."""
    if pos_label not in (0, 1):
        raise ValueError("pos_label must be 0 or 1")
    by = list(by)
    p, n = ("pos", "neg") if pos_label == 1 else ("neg", "pos")
    table = table or score_table(_restrict(df, by, groups), score, target, by, None, n_buckets, _n_groups(groups))
    return _restrict(table.rows, by, groups).where(F.col(SCORE).isNotNull()).select(
        *by, F.col(SCORE).alias(score), F.col(p).alias("pos"), F.col(n).alias("neg"), F.col(f"cum_{p}").alias("tp"), F.col(f"cum_{n}").alias("fp"),
        F.col(f"tot_{p}").alias("P"), F.col(f"tot_{n}").alias("N"), "idx", "_part")


def roc_summary(df: DataFrame, score="score", target="target", key="row_id", by=(), table=None,
                n_buckets=None, groups=None) -> DataFrame:
    """KS and AUC per group, exact (integer numerators in decimal(38,0))."""
    by = list(by)
    t = roc_table(df, score, target, key, by, table, n_buckets, groups)
    dec = "decimal(38,0)"
    tp, fp = F.col("tp").cast(dec), F.col("fp").cast(dec)
    P, N = F.col("P").cast(dec), F.col("N").cast(dec)
    ks_num = F.abs(tp * N - fp * P)
    auc_num = F.col("neg").cast(dec) * (F.lit(2).cast(dec) * tp - F.col("pos").cast(dec))
    agg = t.groupBy(*by, "P", "N").agg(F.max(ks_num).alias("ks_num"), F.sum(auc_num).alias("auc_num"))
    pn = F.col("P").cast("double") * F.col("N").cast("double")
    return agg.select(
        *by,
        _r(F.try_divide(F.col("ks_num").cast("double"), pn)).alias("ks"),
        _r(F.try_divide(F.col("auc_num").cast("double"), 2 * pn)).alias("auc"),
    )


def roc_points(df: DataFrame, score="score", target="target", key="row_id", by=(), table=None,
               n_buckets=None, groups=None, thin: bool = False, pos_label: int = 1) -> DataFrame:
    """(threshold, tpr, fpr) per distinct score, as in the ROC curve.

    With ``thin`` points inside a straight piece are left out: a point stays if it is its group's first or last
    or if the next score adds other counts than its own."""
    by = list(by)
    t = roc_table(df, score, target, key, by, table, n_buckets, groups, pos_label)
    if thin:
        t = next_in_order(t, by, ["idx"], ["pos", "neg"])
        turns = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        t = t.where((F.col("idx") == 0) | F.col("next_pos").isNull() | turns)
    return t.select(
        *by,
        F.col(score).alias("threshold"),
        _ratio(F.col("tp"), F.col("P")).alias("tpr"),
        _ratio(F.col("fp"), F.col("N")).alias("fpr"),
    )


def ks_max(df: DataFrame, score="score", target="target", key="row_id", by=(), table=None,
           groups=None) -> DataFrame:
    return roc_summary(df, score, target, key, by, table, groups=groups).select(*by, "ks")


def auc(df: DataFrame, score="score", target="target", key="row_id", by=(), table=None,
        groups=None) -> DataFrame:
    return roc_summary(df, score, target, key, by, table, groups=groups).select(*by, "auc")


def top_capture(gains_df: DataFrame) -> DataFrame:
    """First row of a gains table (top 1 % when bins=100)."""
    return gains_df.where(F.col("bin") == 1)


def ks_curve(gains_df: DataFrame, by=()) -> DataFrame:
    """Gains plus a zero row at bin 0 per group, for KS / gains curves."""
    by = list(by)
    cols = [c for c in gains_df.columns if c not in by and c != "bin"]
    zero = gains_df.select(*by).distinct().withColumn("bin", F.lit(0))
    for c in cols:
        zero = zero.withColumn(c, F.lit(0).cast(gains_df.schema[c].dataType))
    return gains_df.unionByName(zero)
