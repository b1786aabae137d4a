"""Running totals inside groups that may be larger than a task.

Rows are dealt by ranges of (group, order), so one group may cover many
partitions and each partition many groups.  The sums of each (group, partition)
piece - at most groups + partitions rows - give every piece its offset and every group
its totals; row-level windows then run inside one piece only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.plans.broadcast import bounded_broadcast, checked_broadcast, materialize
from scorelens.session import shuffle_partitions

PART = "_part"


def null_safe_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join on equal or both-null keys; the left keys stay."""
    mine = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    cond = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return left.join(mine, cond, how).drop(*[f"_on_{c}" for c in on])


def with_totals(df: DataFrame, by, cols, groups: int | None = None, prefix: str = "tot_") -> DataFrame:
    """``df`` with tot_c of its group for each of ``cols``: an aggregation (partial on the map side) joined
    back, so the rows of a group do not meet.  ``groups`` bounds the number of groups, if it is known."""
    by = list(by)
    if not by:
        raise ValueError("with_totals needs at least one grouping column")
    totals = df.groupBy(*by).agg(*[F.sum(c).alias(f"{prefix}{c}") for c in cols])
    totals = checked_broadcast(totals) if groups is None else bounded_broadcast(totals, groups)
    return null_safe_join(df, totals, by)


def running_totals(df: DataFrame, by, order, cols, parts: int | None = None, groups: int | None = None) -> DataFrame:
    """``df`` with, in the order of ``order`` (names or sort columns, unique in a group) inside each group ``by``: idx
    (from 0), cum_c (this row included) and tot_c for each of ``cols``, and _part, the range that holds the row.

    Stores ``df`` once, dealt by ranges.  Null is a group of its own.  ``groups`` bounds the number of groups, if known."""
    by, order, cols = list(by), list(order), list(cols)
    n = parts or shuffle_partitions(df.sparkSession)
    dealt = df.repartitionByRange(n, *by, *order) if by or order else df
    dealt = materialize(dealt.withColumn(PART, F.spark_partition_id()))
    sums = {"n": F.count(F.lit(1)), **{f"s_{c}": F.sum(c) for c in cols}}
    pieces = dealt.groupBy(*by, PART).agg(*[v.alias(f"_{k}") for k, v in sums.items()])
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    earlier = lambda k, c: F.coalesce(F.sum(k).over(before), F.lit(0)).cast(pieces.schema[k].dataType).alias(c)
    pieces = pieces.select(*by, PART, *[earlier(f"_{k}", f"_before_{k}") for k in sums], *[F.sum(f"_s_{c}").over(whole).alias(f"tot_{c}") for c in cols])
    small = checked_broadcast(pieces) if groups is None else bounded_broadcast(pieces, groups + n)
    out = null_safe_join(dealt, small, [*by, PART])
    inside = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.select(
        *df.columns, (F.row_number().over(inside) - 1 + F.col("_before_n")).alias("idx"),
        *[(F.sum(c).over(inside) + F.col(f"_before_s_{c}")).alias(f"cum_{c}") for c in cols], *[f"tot_{c}" for c in cols], PART)


def next_in_order(df: DataFrame, by, order, cols) -> DataFrame:
    """``df`` (from ``running_totals``) with next_c of the following row of its group, null after the last.

    Inside a piece by a window; a piece's last row takes the first row of the group's next piece: a row
    a piece, so groups + partitions rows."""
    by, order, cols = list(by), list(order), list(cols)
    first = df.groupBy(*by, PART).agg(*[F.min_by(c, "idx").alias(f"_first_{c}") for c in cols])
    along = Window.partitionBy(*by).orderBy(PART)
    first = first.select(*by, PART, *[F.lead(f"_first_{c}").over(along).alias(f"_first_{c}") for c in cols])
    out = null_safe_join(df, checked_broadcast(first), [*by, PART])
    inside = Window.partitionBy(*by, PART).orderBy(*order)
    return out.select(*df.columns, *[F.coalesce(F.lead(c).over(inside), F.col(f"_first_{c}")).alias(f"next_{c}") for c in cols])
