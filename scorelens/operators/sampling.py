"""Deterministic sampling: stratified per class and a 70/30 dev/val split.

Rows are ordered by md5(key || '#' || seed); the first floor(frac * n_class) rows
of each class are drawn.  Reruns and other engines (DuckDB) draw the same rows.

The order is never made.  The hash of the last drawn row of each class is found by counting prefixes:
hashes by their first digits, then, inside the prefix that holds the cut, by further digits, until few
are left.  The sample is then a filter on (class, hash) - no join, window, union or shuffle of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.plans.broadcast import materialize

DIGITS = 4  # hexadecimal digits a round: at most 65,536 counts a class come to the driver
FEW = 10_000  # hashes that are looked at one by one


def hash_order_key(key: str, seed: int) -> Column:
    """Hash of the key as text; a null key counts as empty text."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"#{seed}")))


def hash_cuts(df: DataFrame, key: str, seed: int, group: Column, m_of: Callable[[object, int], int],
              digits: int = DIGITS, few: int = FEW) -> dict:
    """{group value: greatest hash that is drawn, "" for none}: of the n rows of a group, the m_of(group, n) of
    least hash.  For groups of few different values.  Reads ``df`` once (the hashes are stored)."""
    hashed = materialize(df.select(group.alias("g"), hash_order_key(key, seed).alias("h")))
    cuts: dict = {}
    open_: dict = {}  # group -> (prefix that holds the cut, rows still to draw from it, rows in it)
    counts = hashed.groupBy("g", F.substring("h", 1, digits).alias("p")).count().collect()
    by_group: dict = {}
    for r in counts:
        by_group.setdefault(r["g"], []).append((r["p"], r["count"]))

    def narrow(g, found, m):
        """The cut is in one of ``found`` (prefix, count): settle it, or leave its prefix open."""
        for p, n in sorted(found):
            if m <= n:
                if m == n:
                    cuts[g] = p.ljust(32, "f")
                else:
                    open_[g] = (p, m, n)
                return
            m -= n

    for g, found in by_group.items():
        m = m_of(g, sum(n for _, n in found))
        if m <= 0:
            cuts[g] = ""
        else:
            narrow(g, found, m)
    while open_:
        todo, open_ = open_, {}
        for g, (p, m, n) in todo.items():
            rows = hashed.where(F.col("g").eqNullSafe(F.lit(g)) & F.col("h").startswith(p))
            if n <= few or len(p) >= 32:
                by_hash = rows.groupBy("h").count().collect()
                for h, c in sorted((r["h"], r["count"]) for r in by_hash):
                    cuts[g] = h
                    m -= c
                    if m <= 0:
                        break
            else:
                longer = rows.groupBy(F.substring("h", 1, len(p) + digits).alias("p")).count().collect()
                narrow(g, [(r["p"], r["count"]) for r in longer], m)
    return cuts


def is_first(key: str, seed: int, group: Column, cuts: dict) -> Column:
    """Whether a row is among the first of its group by hash (null for a group without a cut)."""
    h, out = hash_order_key(key, seed), None
    for g, cut in cuts.items():
        here = group.eqNullSafe(F.lit(g))
        out = F.when(here, h <= F.lit(cut)) if out is None else out.when(here, h <= F.lit(cut))
    return F.lit(False) if out is None else out


def stratified_sample(df: DataFrame, target: str = "target", key: str = "row_id", frac1: float = 0.7,
                      frac0: float = 0.7, seed: int = 1, **work) -> DataFrame:
    """Per-class sample without replacement: floor(frac * n_class) rows of each
    class (the reference's parameters are fractions despite their names).  A
    class-1 fraction of 1 keeps class 1 whole.  Rows outside {0, 1} are not drawn.

    ``key`` is meant to be unique: rows that share the key of the last drawn row are all drawn."""
    def m_of(value, n):
        return math.floor(float(frac1 if value == 1 else frac0) * float(n))

    src = df.where(F.col(target).isin(0, 1))
    group = F.col(target)
    return src.where(is_first(key, seed, group, hash_cuts(src, key, seed, group, m_of, **work)))


def dev_val_split(df: DataFrame, key: str = "row_id", test_size: float = 0.3, seed: int = 1,
                  col: str = "split", **work) -> DataFrame:
    """Exact-size random split, not stratified: ceil(test_size * n) rows go to
    'val', the rest to 'dev' (sklearn's sizes).  ``key`` is meant to be unique, as above."""
    def m_of(_, n):
        return n - math.ceil(float(test_size) * float(n))

    group = F.lit(0)
    dev = is_first(key, seed, group, hash_cuts(df, key, seed, group, m_of, **work))
    return df.withColumn(col, F.when(dev, F.lit("dev")).otherwise(F.lit("val")))
