"""Weight of evidence: level statistics, WOE maps, apply, KS / IV / PSI over levels.

All features are handled in one job: the categorical columns are unpivoted to
a long table (feature, level, target) and counted with one groupBy; partial
aggregation makes a hot level cost one row per map task, not one per row.
The fitted map is a DataFrame (feature, level, woe) that can be saved and
applied later; apply is one size-checked broadcast join per feature.

Four zero rules live here, on purpose not shared:
* ``woe_map``: each of b, g, B, G replaced by 1 when 0;
* ``grouped_iv``: levels with a zero share are dropped;
* ``group_woe``: one-sided zeros give -inf / +inf (policy switch);
* (``score_psi`` in monitor.py charges 1 for a zero share.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.plans.broadcast import materialize
from scorelens.plans.prefix import running_totals, with_totals

DIGITS = 10
CELLS = ["good", "bad"]


def _r(c):
    return F.round(c, DIGITS)


def long_levels(df: DataFrame, features, target: str, ids=()) -> DataFrame:
    """(ids..., target, feature, level) with level as string (Expand, no shuffle)."""
    ids = list(ids)
    src = df.select(*ids, target, *[F.col(c).cast("string").alias(c) for c in features])
    return src.unpivot([*ids, target], list(features), "feature", "level")


def level_counts(df: DataFrame, features, target: str, by=()) -> DataFrame:
    """(by..., feature, level, n, bad, good): bad = target 1, good = target 0."""
    by = list(by)
    lg = long_levels(df, features, target, by)
    return lg.groupBy(*by, "feature", "level").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col(target) == 1, 1)).alias("bad"),
        F.count(F.when(F.col(target) == 0, 1)).alias("good"),
    )


def validate_target(df: DataFrame, target: str) -> None:
    """Raise unless the target's distinct non-null values are exactly {0, 1} (one action)."""
    vals = {r[0] for r in df.select(target).where(F.col(target).isNotNull()).distinct().limit(3).collect()}
    if vals != {0, 1}:
        raise ValueError(f"target {target!r} must take exactly the values 0 and 1, found {sorted(vals)}")


def checked_target(df: DataFrame, target: str) -> DataFrame:
    """``df`` whose target raises, in the query that reads it, where it is neither 0, 1 nor null."""
    t = F.col(target)
    wrong = F.raise_error(F.concat(F.lit(f"target {target} must be 0 or 1, not "), t.cast("string")))
    return df.withColumn(target, F.when(t.isNull() | t.isin(0, 1), t).otherwise(wrong.cast(df.schema[target].dataType)))


def woe_map(df: DataFrame, features, target: str) -> DataFrame:
    """(feature, level, n, bad, good, woe) with woe = ln(b*G/B/g), where
    g = n - b and each of b, g, B, G is replaced by 1 when it is 0.
    A null level is an ordinary level with its true counts.  A target of one class only (or none) raises, in
    the query that reads the map: there is nothing to weigh."""
    c = level_counts(checked_target(df, target), features, target)
    # totals by aggregation and join: the levels of one feature need not meet in a task
    totals = c.groupBy("feature").agg(F.sum("bad").alias("_B"), F.sum("good").alias("_G"))
    one_class = F.raise_error(F.lit(f"target {target} must take both values 0 and 1")).cast("long")
    both = (F.col("_B") > 0) & (F.col("_G") > 0)
    totals = totals.select("feature", F.when(both, F.col("_B")).otherwise(one_class).alias("_B"), "_G")
    c = c.join(F.broadcast(totals), "feature")  # one row per named feature
    B, G = F.col("_B"), F.col("_G")
    b = F.col("bad")
    g = F.col("n") - F.col("bad")
    one = lambda x: F.when(x == 0, F.lit(1)).otherwise(x)
    ratio = one(b).cast("double") * one(G) / one(B) / one(g)
    return c.select("feature", "level", "n", "bad", (F.col("n") - F.col("bad")).alias("good"),
                    _r(F.log(ratio)).alias("woe"))


def woe_apply(df: DataFrame, wmap: DataFrame, features, fill: float | None = 0.0, fill_all: bool = False,
              value_col: str = "woe", prefix: str | None = None) -> DataFrame:
    """Replace each feature by its mapped value (null-safe level match).

    Unseen levels get ``fill`` (0.0 as the reference's fillna(0)); with
    ``fill_all`` every null of every column is then filled with 0, as the
    reference fills the whole frame.  With ``prefix`` the mapped values go to
    new columns ``prefix + feature`` and the originals are kept.
    """
    from scorelens.plans.broadcast import DEFAULT_MAX_BROADCAST_BYTES, DEFAULT_MAX_BROADCAST_ROWS, materialize

    # The map is stored once; rows and bytes are checked feature by feature.
    wmap = materialize(wmap.select("feature", "level", value_col))
    sizes = wmap.where(F.col("feature").isin(list(features))).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("level"), F.lit(0)) + 16).alias("b")).collect()
    fits = {r["feature"] for r in sizes if r["n"] <= DEFAULT_MAX_BROADCAST_ROWS and r["b"] <= DEFAULT_MAX_BROADCAST_BYTES}
    absent = set(features) - {r["feature"] for r in sizes}
    out = df
    for f in features:
        m = wmap.where(F.col("feature") == f).select(F.col("level").alias("_lv"), F.col(value_col).alias("_v"))
        m = F.broadcast(m) if f in fits | absent else m
        out = out.join(m, out[f].cast("string").eqNullSafe(m["_lv"]), "left")
        v = F.col("_v") if fill is None else F.coalesce(F.col("_v"), F.lit(fill))
        out = out.withColumn(f if prefix is None else prefix + f, v).drop("_lv", "_v")
    if fill_all:
        from scorelens.operators.prep import fill_constant

        out = fill_constant(out, 0)
    return out


def woe_fit_transform(df: DataFrame, features, target: str) -> DataFrame:
    """Fit on df and apply to df."""
    return woe_apply(df, woe_map(df, features, target), features, fill=None)


def woe_fit_apply(train: DataFrame, apply: DataFrame, features, target: str, fill_all: bool = False) -> DataFrame:
    """Fit on train, apply to another frame; unseen levels -> 0."""
    return woe_apply(apply, woe_map(train, features, target), features, fill=0.0, fill_all=fill_all)


def category_stats(df: DataFrame, features, target: str, by=(), cumulative: bool = False) -> DataFrame:
    """(by..., feature, level, good, bad, bad_ratio, idx): levels sorted by bad
    ratio (ties by level), idx from 0.  Null levels drop out (group-by of the
    reference drops them); only rows with target 0/1 count.

    The order is by ranges (``plans.prefix``), so the levels of one feature are spread over
    tasks.  ``cumulative`` adds cum_good, cum_bad, tot_good and tot_bad."""
    by = list(by)
    src = df.where(F.col(target).isin(0, 1))
    c = level_counts(src, features, target, by).where(F.col("level").isNotNull())
    c = c.select(*by, "feature", "level", "good", "bad", (F.col("bad") / (F.col("bad") + F.col("good"))).alias("bad_ratio"))
    out = running_totals(c, [*by, "feature"], ["bad_ratio", "level"], CELLS if cumulative else [], groups=None if by else len(list(features)))
    sums = [f"{s}_{x}" for s in ("cum", "tot") for x in CELLS] if cumulative else []
    return out.select(*by, "feature", "level", "good", "bad", "bad_ratio", F.col("idx").cast("int").alias("idx"), *sums)


def _with_cumulative(stats: DataFrame, keys, order_col: str) -> DataFrame:
    if {f"cum_{x}" for x in CELLS} <= set(stats.columns):
        return stats
    return running_totals(stats.drop("idx") if order_col != "idx" else stats.withColumnRenamed("idx", "_place"), keys,
                          [order_col if order_col != "idx" else "_place"], CELLS)


def _ks_term():
    return F.abs(F.try_divide("cum_good", "tot_good") - F.try_divide("cum_bad", "tot_bad"))


def _iv_term():
    """ln(b%/g%)(b% - g%), null where a share is zero."""
    gp, bp = F.col("good") / F.col("tot_good"), F.col("bad") / F.col("tot_bad")
    return F.when((F.col("good") != 0) & (F.col("bad") != 0), F.log(bp / gp) * (bp - gp))


def grouped_ks(stats: DataFrame, by=(), order_col: str = "idx", part=("feature",)) -> DataFrame:
    """max |cum good share - cum bad share| over rows in ``order_col`` order (cumulative columns
    of ``category_stats`` are used if ``stats`` has them)."""
    keys = list(by) + list(part)
    return _with_cumulative(stats, keys, order_col).groupBy(*keys).agg(_r(F.max(_ks_term())).alias("ks"))


def grouped_iv(stats: DataFrame, by=(), part=("feature",), groups: int | None = None) -> DataFrame:
    """Sum of ln(b%/g%)(b% - g%) over rows whose shares are both non-zero;
    shares are over all rows of the group.  ``groups`` bounds the number of groups, if known."""
    keys = list(by) + list(part)
    s = stats if {f"tot_{x}" for x in CELLS} <= set(stats.columns) else with_totals(stats.select(*keys, *CELLS), keys, CELLS, groups)
    return s.groupBy(*keys).agg(_r(F.coalesce(F.sum(_iv_term()), F.lit(0.0))).alias("iv"))


def category_psi(build: DataFrame, off: DataFrame, on: str = "level", part=("feature",)) -> DataFrame:
    """PSI over an inner join on ``on``: shares use the joined rows' totals only;
    sum of ln(p/q)(p - q).  Inputs carry good and bad per row."""
    keys = list(part)
    b = build.select(*keys, on, (F.col("good") + F.col("bad")).alias("bn"))
    o = off.select(*keys, on, (F.col("good") + F.col("bad")).alias("on_"))
    j = with_totals(materialize(b.join(o, [*keys, on], "inner")), keys, ["bn", "on_"])
    p = F.col("bn") / F.col("tot_bn")
    q = F.col("on_") / F.col("tot_on_")
    return j.groupBy(*keys).agg(_r(F.sum(F.log(p / q) * (p - q))).alias("psi"))


def group_woe(stats: DataFrame, group_col: str = "level", part=("feature",), zero_policy: str = "inf",
              groups: int | None = None) -> DataFrame:
    """ln((b/B)/(g/G)) per group, no smoothing.

    zero_policy: "inf" (reference: one-sided zeros give -inf / +inf), "smooth"
    (zeros replaced by 0.5), "sentinel" (-99 for any zero cell).  ``groups`` bounds the number
    of different ``part`` keys, if known.
    """
    keys = list(part)
    s = stats if {f"tot_{x}" for x in CELLS} <= set(stats.columns) else with_totals(stats, keys, CELLS, groups)
    b, g = F.col("bad").cast("double"), F.col("good").cast("double")
    B, G = F.col("tot_bad"), F.col("tot_good")
    if zero_policy == "smooth":
        b = F.when(b == 0, 0.5).otherwise(b)
        g = F.when(g == 0, 0.5).otherwise(g)
        w = F.log((b / B) / (g / G))
    elif zero_policy == "sentinel":
        w = F.when((b == 0) | (g == 0), F.lit(-99.0)).otherwise(F.log((b / B) / (g / G)))
    elif zero_policy == "inf":
        w = (F.when((b == 0) & (g == 0), F.lit(-99.0))
             .when(b == 0, F.lit(float("-inf")))
             .when(g == 0, F.lit(float("inf")))
             .otherwise(F.log((b / B) / (g / G))))
    else:
        raise ValueError(f"unknown zero_policy {zero_policy!r}")
    return s.select(*keys, group_col, _r(w).alias("woe"))


IV_BINS = 10  # equal-frequency bins for numeric features in the IV ranking


def iv_ranking(df: DataFrame, char, num, target: str, bins: int = IV_BINS) -> DataFrame:
    """(name, var_type, iv) for every feature.

    The reference delegates this to a module it does not ship; our contract:
    string levels as they are (null is a level), numeric features cut at exact
    deciles (linear interpolation, duplicates dropped, right-closed, null its
    own bin); IV as ``grouped_iv``.  Actions: the exact quantiles.
    """
    from scorelens.plans.selection import exact_quantiles

    char, num = list(char), list(num)
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(df, num, probs) if num else {}
    binned = []
    for c in num:
        es = sorted({e for e in edges[c] if e is not None})
        x = F.col(c).cast("double")
        b = F.lit(1)
        for e in es:
            b = b + F.when(x > F.lit(e), 1).otherwise(0)
        binned.append(F.when(x.isNull() | F.isnan(x), F.lit("null")).otherwise(b.cast("string")).alias(c))
    src = df.select(target, *[F.col(c).cast("string").alias(c) for c in char], *binned)
    stats = level_counts(src, char + num, target)
    iv = grouped_iv(stats, groups=len(char) + len(num))
    types = df.sparkSession.createDataFrame([(c, "string") for c in char] + [(c, "number") for c in num],
                                            "feature string, var_type string")
    # one row per feature; sorted by IV descending like the reference's report
    return (iv.join(F.broadcast(types), "feature").select(F.col("feature").alias("name"), "var_type", "iv")
            .orderBy(F.desc("iv"), "name"))
