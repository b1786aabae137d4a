"""One collapsed score table, from which the score reports are derived.

Rows are summed by (group, score), in one partial aggregation over narrow columns, and the result is
dealt by ranges of (group, score descending) with running totals (``plans.prefix``).  Gains, KS, AUC, ROC
points, PSI, score bands and histograms all read this table; only gains reads rows
again, those of the tied scores that a bin border cuts.

A NaN score is a missing score, like null: last in the order, in no average, band or curve.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.plans.broadcast import materialize
from scorelens.plans.prefix import running_totals

SCORE = "_score"
MONEY = "decimal(18,2)"


def clean_score(df: DataFrame, score: str) -> Column:
    c = F.col(score)
    return F.when(~F.isnan(c), c) if isinstance(df.schema[score].dataType, (T.DoubleType, T.FloatType)) else c


def measures(target: str, balance: str | None = None) -> dict[str, Column]:
    """What is summed by score: rows, classes, classes with a score, and the balance of the classes."""
    bad, good, scored = F.col(target) == 1, F.col(target) == 0, F.col(SCORE).isNotNull()
    out = {
        "n": F.count(F.lit(1)), "bad": F.count(F.when(bad, 1)), "good": F.count(F.when(good, 1)),
        "pos": F.count(F.when(bad & scored, 1)), "neg": F.count(F.when(good & scored, 1)), "scnt": F.count(SCORE), "ssum": F.sum(SCORE),
    }
    if balance:
        out["bbal"] = F.coalesce(F.sum(F.when(bad, F.col(balance))), F.lit(0).cast(MONEY))
        out["gbal"] = F.coalesce(F.sum(F.when(good, F.col(balance))), F.lit(0).cast(MONEY))
    return out


@dataclass(frozen=True)
class ScoreTable:
    """``rows``: (by..., _score, n, bad, good, pos, neg, scnt, ssum[, bbal, gbal], idx, cum_*, tot_*) by score descending."""

    rows: DataFrame
    by: tuple[str, ...]
    balance: str | None

    def of(self, values, column: str | None = None) -> DataFrame:
        """Rows of some values of the (first) grouping column."""
        return self.rows.where(F.col(column or self.by[0]).isin(list(values)))


def score_table(df: DataFrame, score: str = "score", target: str | None = "target", by=(), balance: str | None = None, parts: int | None = None, groups: int | None = None) -> ScoreTable:
    """One pass over the columns that are used; stored in the shared folder.  ``groups`` bounds the number of
    groups, if known.  Without a ``target`` the classes are 0."""
    by = list(by)
    groups = groups if by else 1
    label = F.lit(None).cast("int") if target is None else F.col(target)
    narrow = df.select(*by, clean_score(df, score).alias(SCORE), label.alias("_label"), *([balance] if balance else []))
    sums = measures("_label", balance)
    cells = narrow.groupBy(*by, SCORE).agg(*[v.alias(k) for k, v in sums.items()])
    summed = [c for c in sums if c not in ("scnt", "ssum")]
    return ScoreTable(materialize(running_totals(cells, by, [F.desc_nulls_last(SCORE)], summed, parts, groups)), tuple(by), balance)
