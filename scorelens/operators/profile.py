"""Profiling: describe, class balance, cross tables with margins, bivariate
(single-variable) analysis.

Numeric columns are unpivoted so one job covers all of them.  Quantiles are
exact by default (``plans.selection``: only the cells that hold a wanted rank are
narrowed, no row is shuffled or sorted); ``approx=True`` uses KLL sketches instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.plans.broadcast import checked_broadcast, materialize
from scorelens.plans.prefix import null_safe_join
from scorelens.plans.selection import column_spans, kll_quantiles, select_quantiles

DIGITS = 10
MOMENT_DIGITS = 6  # report precision of mean / std / quantiles / bin edges (values can be large)


def _pname(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_").rjust(2, "0")


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def describe(df: DataFrame, cols=None, probs=(0.01, 0.25, 0.5, 0.75, 0.99), approx: bool = False) -> DataFrame:
    """One row per numeric column: dtype, count, mean, std, min, quantiles, max.

    Two actions: moments with ranges, and the rank selection of the quantiles (``plans.selection``).
    ``approx`` takes the quantiles from KLL sketches instead, merged in two steps."""
    spark = df.sparkSession
    cols = list(cols) if cols is not None else numeric_columns(df)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    moments = [a for i, c in enumerate(cols) for a in (F.avg(clean[c]).alias(f"m{i}"), F.stddev_samp(clean[c]).alias(f"s{i}"))]
    span, row = column_spans(df, clean, moments)
    qs = kll_quantiles(df, clean, probs) if approx else select_quantiles(df, clean, probs, span)
    num = lambda v: None if v is None else float(v)
    short = lambda v: None if v is None else round(float(v), MOMENT_DIGITS)
    rows = [(c, types[c], span[c].n, short(row[f"m{i}"]), short(row[f"s{i}"]), num(span[c].low), *map(short, qs[c]), num(span[c].high))
            for i, c in enumerate(cols)]
    names = ", ".join(f"{_pname(p)} double" for p in probs)
    return spark.createDataFrame(rows, f"column_name string, dtype string, count long, mean double, std double, min double, {names}, max double")


def column_types(df: DataFrame) -> DataFrame:
    """(position, column_name, dtype) of every column."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, dtype string")


def class_balance(df: DataFrame, target: str = "target", by=("sample",), counted: bool = False) -> DataFrame:
    """(by..., num_good, num_bad, bad_rate); an absent class counts 0.  ``counted``: ``df`` has
    columns good and bad (a score table) instead of a row per target."""
    by = list(by)
    good, bad = (F.sum("good"), F.sum("bad")) if counted else (F.count(F.when(F.col(target) == 0, 1)), F.count(F.when(F.col(target) == 1, 1)))
    g = df.groupBy(*by).agg(good.alias("num_good"), bad.alias("num_bad"))
    return g.withColumn("bad_rate", F.round(F.try_divide(F.col("num_bad").cast("double"),
                                                         F.col("num_bad") + F.col("num_good")), DIGITS))


def crosstab_margins(df: DataFrame, features, target: str = "target") -> DataFrame:
    """Level x target counts with an 'All' row per feature and an 'All' column;
    ratio = n_1 / n_all.  Null levels are left out (crosstab drops them)."""
    from scorelens.operators.woe import long_levels

    lg = long_levels(df, features, target).where(F.col("level").isNotNull())
    counts = lg.groupBy("feature", "level").agg(
        F.count(F.when(F.col(target) == 0, 1)).alias("n_0"), F.count(F.when(F.col(target) == 1, 1)).alias("n_1"),
        F.count(F.lit(1)).alias("n_all"))
    # margins from the level table: rows are counted once
    r = counts.rollup("feature", "level").agg(*[F.sum(c).alias(c) for c in ("n_0", "n_1", "n_all")],
                                              F.grouping("feature").alias("_gf"), F.grouping("level").alias("_gl"))
    r = r.where(F.col("_gf") == 0)
    return r.select("feature", F.when(F.col("_gl") == 1, F.lit("All")).otherwise(F.col("level")).alias("level"),
                    "n_0", "n_1", "n_all", F.round(F.col("n_1") / F.col("n_all"), DIGITS).alias("ratio"))


# --- bivariate analysis -----------------------------------------------------------------------

BIVAR_BINS = 10  # fixed value: equal-width bins of a numeric column
BIVAR_MIN_DISTINCT = 5  # fixed value: fewer distinct values -> per-value table


def _long_numbers(df: DataFrame, by: list[str], cols: list[str], more=()) -> DataFrame:
    """(by..., more..., column_name, x): every value of the numeric columns; null and NaN left out."""
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in cols])
    return df.select(*by, *more, F.explode(each).alias("t")).select(*by, *more, "t.*").where(F.col("x").isNotNull() & ~F.isnan("x"))


def number_spans(df: DataFrame, cols, by=()) -> DataFrame:
    """(by..., column_name, mn, mx, est): range and estimated number of different values of each numeric column in each
    group; one pass over the rows, stored."""
    lg = _long_numbers(df, list(by), list(cols))
    return materialize(lg.groupBy(*by, "column_name").agg(F.min("x").alias("mn"), F.max("x").alias("mx"), F.approx_count_distinct("x", 0.01).alias("est")))


def _with_many(df: DataFrame, spans: DataFrame, by: list[str], k: int) -> DataFrame:
    """The groups of ``spans`` with at least k different values.

    Groups estimated below 4k are counted exactly; if there are none, no rows are read."""
    doubtful = spans.where(F.col("est") < 4 * k)
    clear = spans.where(F.col("est") >= 4 * k)
    names = [r["column_name"] for r in doubtful.select("column_name").distinct().collect()]
    if not names:
        return clear
    few = checked_broadcast(doubtful.select(*by, "column_name"))
    exact = null_safe_join(_long_numbers(df, by, names), few, [*by, "column_name"]).groupBy(*by, "column_name").agg(F.count_distinct("x").alias("nd"))
    return clear.unionByName(null_safe_join(doubtful, exact.where(F.col("nd") >= k).drop("nd"), [*by, "column_name"]))


def route_numeric(df: DataFrame, cols, min_distinct: int = BIVAR_MIN_DISTINCT, spans: DataFrame | None = None) -> tuple[list[str], list[str]]:
    """(columns to bin, columns to list by value), decided once over all rows of
    ``df``, so that a column has the same form in every group (a row per column comes to the driver).

    A column with enough values in some group (by ``spans``) is settled; the others are counted exactly."""
    cols = list(cols)
    if not cols:
        return [], []
    spans = number_spans(df, cols) if spans is None else spans
    most = {r["column_name"]: r["est"] for r in spans.groupBy("column_name").agg(F.max("est").alias("est")).collect()}
    unsettled = [c for c in cols if c in most and most[c] < 4 * min_distinct]
    exact = {}
    if unsettled:
        number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        exact = df.agg(*[F.count_distinct(number(c)).alias(c) for c in unsettled]).first().asDict()
    many = [c for c in cols if (exact[c] >= min_distinct if c in exact else c in most)]
    return many, [c for c in cols if c not in many]


def bivar(df: DataFrame, char=(), num=(), target: str = "target", by=(), bins: int = BIVAR_BINS,
          min_distinct: int = BIVAR_MIN_DISTINCT, order=None, top: int | None = None) -> DataFrame:
    """Single-variable analysis of every feature: (position, by..., column_name, kind,
    bin, lo, hi, level, count, bad_rate).

    Numeric columns with ``min_distinct`` different values or more are binned
    (kind "bins"); those with fewer, and char columns, have a row per value (kind
    "values", bin 0).  ``order`` names the features by importance (default: as given) and
    ``top`` keeps the first so many."""
    names = [c for c in (order or [*char, *num]) if c in {*char, *num}][:top]
    wanted = [c for c in num if c in names]
    spans = number_spans(df, wanted, by) if wanted else None
    binned, listed = route_numeric(df, wanted, min_distinct, spans)
    parts = []
    if binned:
        parts.append(bivar_numeric(df, binned, target, by, bins, min_distinct=None, spans=spans).select(
            *by, "column_name", F.lit("bins").alias("kind"), "bin", "lo", "hi", F.lit(None).cast("string").alias("level"),
            "count", "bad_rate"))
    values = [c for c in names if c in {*char, *listed}]
    if values:
        parts.append(bivar_categorical(df, values, target, by).select(
            *by, "column_name", F.lit("values").alias("kind"), F.lit(0).alias("bin"),
            F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), "level", "count", "bad_rate"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    position = F.coalesce(*[F.when(F.col("column_name") == c, i + 1) for i, c in enumerate(names)])
    return out.select(position.alias("position"), *out.columns)


def bivar_numeric(df: DataFrame, cols, target: str = "target", by=(), bins: int = BIVAR_BINS,
                  min_distinct: int | None = BIVAR_MIN_DISTINCT, spans: DataFrame | None = None) -> DataFrame:
    """Equal-width, right-closed bins between each group's min and max (the
    lowest edge lowered by 0.1 % of the range, as pandas cut does); count and bad
    rate per non-empty bin; nulls drop.  Groups with fewer than ``min_distinct``
    distinct values are left out (None: none are); ``bivar`` sends whole columns
    to bins or values instead.

    ``spans`` (from ``number_spans`` with the same ``by``) saves a pass: ranges and distinct estimates
    come from one aggregation, the counts from a second."""
    by = list(by)
    cols = list(cols)
    spans = (number_spans(df, cols, by) if spans is None else spans).where(F.col("column_name").isin(cols))
    ext = _with_many(df, spans, by, min_distinct) if min_distinct else spans
    ext = checked_broadcast(ext.select(*by, "column_name", "mn", "mx"))
    lg = _long_numbers(df, by, cols, [target])
    step = (F.col("mx") - F.col("mn")) / F.lit(float(bins))

    def edge(i):  # numpy linspace: i*step + min, last edge = max
        return F.lit(float(i)) * step + F.col("mn") if i < bins else F.col("mx")

    j = null_safe_join(lg, ext, [*by, "column_name"])
    b = F.lit(1)
    for i in range(1, bins):
        b = b + F.when(F.col("x") > edge(i), 1).otherwise(0)
    agg = j.withColumn("bin", b).groupBy(*by, "column_name", "bin", "mn", "mx").agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.col(target).cast("double")).alias("bad_rate"))
    lo = F.col("mn") - (F.col("mx") - F.col("mn")) * 0.001
    lo_i = None
    hi_i = None
    for i in range(1, bins + 1):
        lo_e = lo if i == 1 else edge(i - 1)
        lo_i = F.when(F.col("bin") == i, lo_e) if lo_i is None else lo_i.when(F.col("bin") == i, lo_e)
        hi_i = F.when(F.col("bin") == i, edge(i)) if hi_i is None else hi_i.when(F.col("bin") == i, edge(i))
    return agg.select(*by, "column_name", F.col("bin").cast("int").alias("bin"),
                      F.round(lo_i, MOMENT_DIGITS).alias("lo"), F.round(hi_i, MOMENT_DIGITS).alias("hi"), "count",
                      F.round("bad_rate", DIGITS).alias("bad_rate"))


def bivar_categorical(df: DataFrame, cols, target: str = "target", by=()) -> DataFrame:
    """Count and bad rate per value (nulls drop), one row per (column, value)."""
    from scorelens.operators.woe import long_levels

    by = list(by)
    lg = long_levels(df, cols, target, by).where(F.col("level").isNotNull())
    return lg.groupBy(*by, "feature", "level").agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg(F.col(target).cast("double")), DIGITS).alias("bad_rate"),
    ).withColumnRenamed("feature", "column_name")
