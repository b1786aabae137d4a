"""Monitoring: score-band distribution, score PSI against a base sample, and the
density histogram behind the score plot.

PSI follows the reference's order-statistic rule: with the base (dev) scores
sorted descending and m = n_dev // k, the edges are
  [max(cmp)] + [dev[m*1], ..., dev[m*(k-1)]] + [min(cmp)]
band j holds x with edge_j >= x > edge_{j+1} (the last band is closed on both
ends), shares are over *all* rows of each side (so rows outside the compared
sample's range fall in no band), and a band whose share is 0 on either side
costs exactly 1.

Reports take a score table (``plans.scoretable``), so that several of them read the rows
once between them.  A NaN score is a missing one: in no band, range or histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.functions.bands import score_band
from scorelens.plans.broadcast import bounded_broadcast, checked_broadcast
from scorelens.plans.prefix import null_safe_join
from scorelens.plans.scoretable import SCORE, ScoreTable, score_table

DIGITS = 10


def _r(c):
    return F.round(c, DIGITS)


def score_distribution(df: DataFrame, score="score", sample_col="sample", samples=("dev", "val", "oft1", "oft2", "oft3"),
                       n_bands: int = 20, table: ScoreTable | None = None) -> DataFrame:
    """Band counts per sample pivoted by band (absent -> 0) and each sample's share.

    Bands that no sample hits do not appear (value_counts semantics); rows
    without a band are not counted.  ``table`` (by ``sample_col``) stands for the rows of ``df``.
    """
    x, n = (score, F.lit(1)) if table is None else (SCORE, F.col("n"))
    src = (df if table is None else table.rows).select(score_band(x, n_bands).alias("band"), F.col(sample_col).alias("_s"), n.alias("_n"))
    p = src.where(F.col("band").isNotNull()).groupBy("band").pivot("_s", list(samples)).agg(F.sum("_n"))
    p = p.na.fill(0, subset=list(samples))
    w = Window.partitionBy()  # <= n_bands rows
    out = [F.col("band")]
    out += [F.col(s).cast("long").alias(f"n_{s}") for s in samples]
    out += [_r(F.col(s) / F.sum(s).over(w)).alias(f"pct_{s}") for s in samples]
    return p.select(*out)


def band_counts(df: DataFrame, score="score", n_bands: int = 20, by=()) -> DataFrame:
    """value_counts of the score band: (by..., band, n)."""
    return df.select(*by, score_band(score, n_bands).alias("band")).where(F.col("band").isNotNull()).groupBy(
        *by, "band").agg(F.count(F.lit(1)).alias("n"))


# --- PSI --------------------------------------------------------------------------------------


def psi_edges(table: ScoreTable, base="dev", others=("val",), k: int = 10) -> tuple[dict[str, list], int, dict[str, int]]:
    """(edges per compared sample, base size, rows per compared sample): one action over the score table that returns
    a row for each wanted position and each sample.

    The wanted positions of the base are read off the running totals: a score covers [cum_n - n, cum_n)."""
    sample = F.col(table.by[0])
    wanted = [F.struct(F.lit(i).alias("i"), F.expr(f"(tot_n div {int(k)}) * {i}").alias("p")) for i in range(1, k)]
    wanted = F.array(*wanted).cast("array<struct<i:int,p:bigint>>")
    held = F.filter(wanted, lambda x: (x["p"] >= F.col("cum_n") - F.col("n")) & (x["p"] < F.col("cum_n")))
    marks = F.transform(held, lambda x: F.struct(x["i"].alias("i"), F.col(SCORE).cast("double").alias("v")))
    marks = F.flatten(F.collect_list(F.when(sample == base, marks))).alias("marks")
    ends = [F.max(SCORE).alias("mx"), F.min(SCORE).alias("mn"), F.sum("n").alias("rows")]
    got = {r["s"]: r for r in table.of([base, *others]).groupBy(sample.alias("s")).agg(*ends, marks).collect()}
    n_dev = int(got[base]["rows"]) if base in got else 0
    inner: list = [None] * (k - 1)
    for m in got[base]["marks"] if n_dev else []:
        inner[m["i"] - 1] = m["v"]
    found = [s for s in others if s in got]
    return {s: [got[s]["mx"], *inner, got[s]["mn"]] for s in found}, n_dev, {s: int(got[s]["rows"]) for s in found}


def _band_expr(x: Column, sep: list[float]) -> Column:
    k = len(sep) - 1
    expr = None
    for j in range(k):
        hi, lo = sep[j], sep[j + 1]
        if hi is None or lo is None:
            continue
        cond = (x <= F.lit(hi)) & ((x > F.lit(lo)) if j < k - 1 else (x >= F.lit(lo)))
        expr = F.when(cond, F.lit(j)) if expr is None else expr.when(cond, F.lit(j))
    return expr if expr is not None else F.lit(None).cast("int")


def score_psi(df: DataFrame, score="score", key="row_id", sample_col="sample", base="dev", others=("val",),
              k: int = 10, target=None, table: ScoreTable | None = None) -> DataFrame:
    """Band table per compared sample: (sample, band, hi, lo, dev_share, cmp_share, term, psi).

    ``table`` (by ``sample_col``) stands for the rows of ``df``; it is built if not given.  Counts
    come from one pass over it: each score counts once for its own sample and, if it is the base's, once for
    every comparison.  A compared sample without rows has one row, null but for its name."""
    spark = df.sparkSession
    others = list(others)
    table = table or score_table(df.where(F.col(sample_col).isin(base, *others)), score, target, [sample_col], groups=len(others) + 1)
    edges, n_dev, n_cmp = psi_edges(table, base, others, k)
    schema = "sample string, band int, hi double, lo double, dev_share double, cmp_share double, term double, psi double"
    absent = spark.createDataFrame([(s, *[None] * 7) for s in others if s not in edges], schema)
    if not edges:
        return absent
    x, own = F.col(SCORE), F.col(table.by[0])
    sides = F.array(*[F.when(own.isin(base, s), F.struct(F.lit(s).alias("sample"), _band_expr(x, sep).alias("band"))) for s, sep in edges.items()])
    placed = table.of([base, *edges]).select(own.alias("_own"), "n", F.explode(F.filter(sides, lambda t: t["band"].isNotNull())).alias("t"))
    counts = placed.groupBy("t.sample", "t.band").agg(
        F.sum(F.when(F.col("_own") == base, F.col("n"))).alias("c_dev"), F.sum(F.when(F.col("_own") != base, F.col("n"))).alias("c_cmp"))
    number = lambda v: None if v is None else float(v)
    grid_rows = [(s, j, number(sep[j]), number(sep[j + 1]), n_cmp[s]) for s, sep in edges.items() for j in range(k)]
    grid = spark.createDataFrame(grid_rows, "sample string, band int, hi double, lo double, n_cmp long")
    g = grid.join(counts, ["sample", "band"], "left")
    ds = F.coalesce(F.col("c_dev"), F.lit(0)) / F.lit(float(n_dev) if n_dev else None)
    vs = F.coalesce(F.col("c_cmp"), F.lit(0)) / F.col("n_cmp")
    term = F.when((ds == 0) | (vs == 0), F.lit(1.0)).otherwise((ds - vs) * F.log(ds / vs))
    g = g.select("sample", "band", "hi", "lo", _r(ds).alias("dev_share"), _r(vs).alias("cmp_share"),
                 _r(term).alias("term"), term.alias("_t"))
    w = Window.partitionBy("sample")  # k rows
    return g.withColumn("psi", _r(F.sum("_t").over(w))).drop("_t").unionByName(absent)


def psi_monitor(df: DataFrame, score="score", key="row_id", sample_col="sample", base="dev",
                others=("val", "oft1", "oft2", "oft3"), k: int = 20, target=None, table: ScoreTable | None = None) -> DataFrame:
    """PSI of the base sample against each other sample: (sample, psi)."""
    t = score_psi(df, score, key, sample_col, base, others, k, target, table)
    return t.groupBy("sample").agg(F.first("psi").alias("psi"))


# --- histogram --------------------------------------------------------------------------------


def score_histogram(df: DataFrame, score="score", by=("sample",), bins: int = 20, groups=None, target=None,
                    table: ScoreTable | None = None) -> DataFrame:
    """Density histogram, equal width between each group's own min and max.

    numpy's rule: bins left-closed, last bin closed; edges j*step + min with
    step = (max-min)/bins and the last edge = max; index from
    ((x-min)/(max-min))*bins, then corrected against the edges.  min == max
    widens the range by 0.5 on both sides.  Missing (null, NaN) and infinite scores are left
    out; a group with no other score has no rows.  ``table`` (by ``by``) stands for the rows of ``df``.
    """
    by = list(by)
    table = table or score_table(df if groups is None else df.where(F.col(by[0]).isin(list(groups))), score, target, by, groups=None if groups is None else len(list(groups)))
    x = F.col(SCORE).cast("double")
    rows = (table.rows if groups is None else table.of(groups)).where(F.abs(x) < float("inf")).select(*by, x.alias(SCORE), "n")
    ext = rows.groupBy(*by).agg(F.min(SCORE).alias("mn0"), F.max(SCORE).alias("mx0"), F.sum("n").alias("rows"))
    ext = ext.select(*by, "rows",
                     F.when(F.col("mn0") == F.col("mx0"), F.col("mn0") - 0.5).otherwise(F.col("mn0")).alias("mn"),
                     F.when(F.col("mn0") == F.col("mx0"), F.col("mx0") + 0.5).otherwise(F.col("mx0")).alias("mx"))
    ext = ext.withColumn("step", (F.col("mx") - F.col("mn")) / F.lit(float(bins)))

    def edge(j):
        return F.when(j >= bins, F.col("mx")).otherwise(j.cast("double") * F.col("step") + F.col("mn"))

    # one row per group: a proven bound when the groups are declared
    small = bounded_broadcast(ext, len(list(groups))) if groups is not None else checked_broadcast(ext)
    x = F.col(SCORE)
    rows = null_safe_join(rows, small, by)
    f = ((x - F.col("mn")) / (F.col("mx") - F.col("mn"))) * F.lit(float(bins))
    i0 = f.cast("int")
    rows = rows.withColumn("_i", F.when(i0 == bins, F.lit(bins - 1)).otherwise(i0))
    rows = rows.withColumn("_i", F.when(x < edge(F.col("_i")), F.col("_i") - 1).otherwise(F.col("_i")))
    rows = rows.withColumn("_i", F.when((x >= edge(F.col("_i") + 1)) & (F.col("_i") != bins - 1),
                                        F.col("_i") + 1).otherwise(F.col("_i")))
    counts = rows.groupBy(*by, "_i").agg(F.sum("n").alias("cnt"))
    grid = small.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    g = null_safe_join(grid, counts, [*by, "_i"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    lo, hi = edge(F.col("_i")), edge(F.col("_i") + 1)
    return g.select(*by, (F.col("_i") + 1).cast("int").alias("bin"), _r(lo).alias("lo"), _r(hi).alias("hi"),
                    F.col("cnt").cast("long").alias("count"),
                    _r(F.col("cnt") / (hi - lo) / F.col("rows")).alias("density"))
