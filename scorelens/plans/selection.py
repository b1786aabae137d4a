"""Exact order statistics of many columns by narrowing cells around the wanted ranks.

1. One aggregation gives each column's range and count.
2. The range is cut into cells, and the rows of each cell are counted: tasks count by cell with array
   operations, and their counts are summed by cell; each cell also knows its least and greatest value.
3. Only cells that hold a wanted rank go on, cut again, until a cell has a single value.  After the
   first round their values (a small share of the rows) are stored, so that later rounds read them only;
   when few are left, their different values are counted at once.

No row is shuffled or put into a window: shuffles carry a row per cell and task.  What comes to the
driver is at most ``CELLS`` cells or values a round.  Cells are of equal width in the first rounds; every third
round they are split by sign, or are of equal width in the logarithm, so that any spread of magnitudes
is narrowed in a few rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.plans.broadcast import materialize

CELLS = 16_384  # cells a round, over all columns
FEW = 20_000  # values that are counted one by one
MOST_ROUNDS = 200


@dataclass(frozen=True)
class Span:
    low: float | None
    high: float | None
    n: int


@dataclass
class _Cell:
    column: int
    low: float
    high: float
    before: int  # values of the column below the cell
    n: int
    ranks: list[int]


def column_spans(df: DataFrame, columns: dict[str, Column], extra=()) -> tuple[dict[str, Span], object]:
    """({name: Span}, row of ``extra`` aggregates) of double columns, null left out (one action)."""
    aggs = [a for i, x in enumerate(columns.values()) for a in (F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}"), F.count(x).alias(f"_n{i}"))]
    if not aggs:
        return {}, None
    row = df.agg(*aggs, *extra).first()
    return {c: Span(row[f"_lo{i}"], row[f"_hi{i}"], int(row[f"_n{i}"])) for i, c in enumerate(columns)}, row


#: How a cell is cut: evenly, evenly in the logarithm of positive or of negative values, by sign, or its ends apart.
LINEAR, LOG, MINUS_LOG, SIGN, ENDS = range(5)


def _cut(cell: _Cell, cells: int, logarithm: bool) -> tuple[int, float, float]:
    """(way, start, width): the latter on the way's scale; ``SIGN`` and ``ENDS`` have three cells."""
    low, high, way = cell.low, cell.high, LINEAR
    if logarithm and low > 0:
        low, high, way = math.log(low), math.log(high), LOG
    elif logarithm and high < 0:
        low, high, way = -math.log(-low), -math.log(-high), MINUS_LOG
    elif logarithm:
        return SIGN, 0.0, 0.0
    width = high / cells - low / cells
    return (way, low, width) if 0 < width < float("inf") else (ENDS, 0.0, 0.0)


def _placed(columns: int, todo: list[_Cell], cells: int, logarithm: bool):
    """Function of a batch of double columns: (t, cell, v) arrays of the values that lie in one of the cells to do, column by
    column, with the cell inside it (never decreasing in v)."""
    tables = []
    for i in range(columns):
        rows = sorted((c.low, c.high, t, *_cut(c, cells, logarithm)) for t, c in enumerate(todo) if c.column == i)
        tables.append([np.array(x) for x in zip(*rows)])

    def place(batch):
        for i, table in enumerate(tables):
            column = batch.column(i).drop_null()
            if not table or not len(column):
                continue
            low, high, t, way, start, width = table
            v = column.to_numpy(zero_copy_only=False) + 0.0  # no negative zero
            own = np.searchsorted(low, v, "right") - 1
            inside = (own >= 0) & (v <= high[own])
            v, own = v[inside], own[inside]
            kind = way[own]
            cell = np.zeros(len(v), np.int64)
            even = kind == LINEAR
            cell[even] = np.clip(np.floor((v[even] - start[own[even]]) / width[own[even]]), 0, cells - 1)
            for o in np.unique(own[(kind == LOG) | (kind == MINUS_LOG)]).tolist():
                # by borders, as a logarithm need not keep the order of neighbouring values
                sign = 1.0 if way[o] == LOG else -1.0
                borders = sign * np.exp(sign * (start[o] + width[o] * np.arange(1, cells)))
                cell[own == o] = np.searchsorted(np.maximum.accumulate(borders), v[own == o], "right")
            cell[kind == SIGN] = np.sign(v[kind == SIGN]) + 1
            ends = kind == ENDS
            cell[ends] = np.where(v[ends] <= low[own[ends]], 0, np.where(v[ends] >= high[own[ends]], 2, 1))
            yield t[own], cell, v

    return place


def _values(df: DataFrame, columns: dict[str, Column], todo: list[_Cell]) -> DataFrame:
    """(t, v): values in one of the cells to do."""
    place = _placed(len(columns), todo, 2, False)

    def run(batches):
        for batch in batches:
            for t, _, v in place(batch):
                yield pa.record_batch([pa.array(t.astype(np.int32)), pa.array(v)], names=["t", "v"])

    return df.select(*[x.cast("double").alias(f"x{i}") for i, x in enumerate(columns.values())]).mapInArrow(run, "t int, v double")


def _counted(df: DataFrame, columns: dict[str, Column], todo: list[_Cell], cells: int, logarithm: bool) -> DataFrame:
    """(t, cell, lo, hi, n) of the cells of the cells to do that hold values."""
    place, each, n_cells = _placed(len(columns), todo, cells, logarithm), max(cells, 3), len(todo)

    def run(batches):
        n, lo, hi = np.zeros(n_cells * each, np.int64), np.full(n_cells * each, np.inf), np.full(n_cells * each, -np.inf)
        for batch in batches:
            for t, cell, v in place(batch):
                at = t * each + cell
                n += np.bincount(at, minlength=len(n))
                np.minimum.at(lo, at, v)
                np.maximum.at(hi, at, v)
        held = np.flatnonzero(n)
        yield pa.record_batch([pa.array(x) for x in ((held // each).astype(np.int32), (held % each).astype(np.int32), lo[held], hi[held], n[held])], names=["t", "cell", "lo", "hi", "n"])

    parts = df.select(*[x.cast("double").alias(f"x{i}") for i, x in enumerate(columns.values())]).mapInArrow(run, "t int, cell int, lo double, hi double, n long")
    return parts.groupBy("t", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def select_ranks(df: DataFrame, columns: dict[str, Column], ranks: dict[str, list[int]], spans: dict[str, Span],
                 cells: int = CELLS, most_counted: int = FEW) -> dict[str, dict[int, float]]:
    """{name: {rank: value}}: values at 0-based ranks of the ascending order of each double column, null left out
    (NaN must be null).  ``cells`` a round and ``most_counted`` values one by one change the work, not the result."""
    names = list(columns)
    found: dict[str, dict[int, float]] = {c: {} for c in names}
    todo = []

    def settle(cell: _Cell) -> None:
        if not cell.ranks:
            return
        if cell.low == cell.high:
            found[names[cell.column]].update((r, cell.low) for r in cell.ranks)
        elif cell.n == 2:
            found[names[cell.column]].update((r, cell.low if r == cell.before else cell.high) for r in cell.ranks)
        else:
            todo.append(cell)

    for i, c in enumerate(names):
        s = spans[c]
        if s.n and ranks.get(c):
            settle(_Cell(i, float(s.low), float(s.high), 0, s.n, sorted(set(ranks[c]))))
    source, here = df, columns
    for turn in range(MOST_ROUNDS):
        if not todo:
            return found
        few = sum(c.n for c in todo) <= most_counted
        each = max(4, cells // len(todo))
        if few:
            counted = _values(source, here, todo).groupBy("t", "v").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
        else:
            counted = _counted(source, here, todo, each, turn % 3 == 2).collect()
        old, todo = todo, []
        at = {t: c.before for t, c in enumerate(old)}
        for r in sorted(counted, key=lambda r: (r["t"], r["lo"])):
            c, start = old[r["t"]], at[r["t"]]
            at[r["t"]] = start + r["n"]
            settle(_Cell(c.column, r["lo"], r["hi"], start, r["n"], [k for k in c.ranks if start <= k < start + r["n"]]))
        left = sum(c.n for c in todo)
        if todo and 4 * left < sum(c.n for c in old):
            # later rounds read the values of the cells that are left, by column
            kept = materialize(_values(source, here, todo))
            owner = F.element_at(F.array(*[F.lit(c.column) for c in todo]), F.col("t") + 1)
            source = kept.withColumn("c", owner)
            here = {c: F.when(F.col("c") == i, F.col("v")) for i, c in enumerate(names)}
    raise RuntimeError("order statistics did not settle")


def _positions(n: int, p: float) -> tuple[int, int, float]:
    at = (n - 1) * p
    return math.floor(at), math.ceil(at), at


def select_quantiles(df: DataFrame, columns: dict[str, Column], probs, spans: dict[str, Span], **work) -> dict[str, list]:
    """{name: [quantile per prob]} with the usual linear rule: pos = p * (n - 1),
    lo + (hi - lo) * (pos - floor(pos)).  A column without values has None."""
    ranks = {c: [r for p in probs for r in _positions(spans[c].n, p)[:2]] if spans[c].n else [] for c in columns}
    values = select_ranks(df, columns, ranks, spans, **work)
    out = {}
    for c in columns:
        out[c] = []
        for p in probs:
            if not spans[c].n:
                out[c].append(None)
                continue
            low, high, at = _positions(spans[c].n, p)
            a, b = values[c][low], values[c][high]
            out[c].append(a if low == high else a + (b - a) * (at - low))
    return out


def exact_quantiles(df: DataFrame, cols, probs, **work) -> dict[str, list]:
    """{column: [quantile per prob]}; null and NaN are skipped."""
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    spans, _ = column_spans(df, clean)
    return select_quantiles(df, clean, probs, spans, **work) if clean else {}


def kll_quantiles(df: DataFrame, columns: dict[str, Column], probs, k: int = 800) -> dict[str, list]:
    """Approximate quantiles from KLL sketches of size ``k``: a sketch per group of input partitions, merged
    in a second step, so that no task merges the sketches of all tasks."""
    groups = F.pmod(F.spark_partition_id(), F.lit(64))
    parts = df.groupBy(groups.alias("g")).agg(*[F.kll_sketch_agg_double(x, k).alias(f"s{i}") for i, x in enumerate(columns.values())])
    merged = parts.agg(*[F.kll_merge_agg_double(f"s{i}").alias(f"s{i}") for i in range(len(columns))])
    at = F.array(*[F.lit(float(p)) for p in probs])
    row = merged.select(*[F.when(F.kll_sketch_get_n_double(f"s{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", at)).alias(f"q{i}") for i in range(len(columns))]).first()
    return {c: [None] * len(probs) if row[f"q{i}"] is None else list(row[f"q{i}"]) for i, c in enumerate(columns)}
