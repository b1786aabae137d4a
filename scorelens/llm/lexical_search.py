"""Operator 12: rank all documents for many queries at once, sharing what the queries have in common.

1. Items become terms with their repeats.  Blocks of items are dealt so that the terms of one block
   (what the driver mines and each task holds) are bounded by a parameter.
2. ``share_terms`` mines term sets that several items of a block share: terms of the same items are one
   set, and then the two symbols that most items hold together become a new symbol, again and again.
   This gives a DAG: leaves are terms, inner nodes are shared sets, each item is the sum of a few nodes.
3. One pass over the texts stores each document's counts of the block's terms, and the corpus counts follow.
4. The scoring pass takes documents by the batch: each leaf's and each shared set's partial
   accumulator (one integer a document) is computed once, items add the accumulators of their nodes.
   Each task keeps the best of each item, and a window over these gives the ranks.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.llm.common import LEAST_LONG, blocks_of, stored

#: Bytes outside terms become blanks; A-Z are lower-cased before.
_TERM_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Integers that a task holds in its accumulators at once.
CELLS = 2**22


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order, with repeats."""
    return (text or "").encode().lower().translate(_TERM_BYTES).split()


@dataclass
class Plan:
    """Query-sharing DAG: nodes 0..len(leaves)-1 are (term, repeats), the others sums of two earlier nodes."""

    leaves: list[tuple[int, int]]
    left: np.ndarray
    right: np.ndarray
    items: list[list[int]]

    @property
    def nodes(self) -> int:
        return len(self.leaves) + len(self.left)

    def additions(self) -> int:
        """Additions for one document; without sharing it would be the items' terms less the items."""
        return len(self.left) + sum(len(x) - 1 for x in self.items if x)


def share_terms(items: list[Counter], most_mined: int = 2000) -> Plan:
    """Mine shared term sets among ``items`` (term to repeats) and return the DAG that evaluates them.

    Items of more than ``most_mined`` different symbols take no part in the search for pairs (its cost
    is the square); they still use sets of terms of the same items.  This changes the work only, not a score."""
    held = defaultdict(list)
    for i, item in enumerate(items):
        for leaf in sorted(item.items()):
            held[leaf].append(i)
    leaves = sorted(held)
    number = {leaf: k for k, leaf in enumerate(leaves)}
    left: list[int] = []
    right: list[int] = []

    def node(a: int, b: int) -> int:
        left.append(a)
        right.append(b)
        return len(leaves) + len(left) - 1

    same = defaultdict(list)
    for leaf in leaves:
        same[tuple(held[leaf])].append(number[leaf])
    where: dict[int, set[int]] = {}
    for owners, symbols in sorted(same.items()):
        if len(owners) > 1:
            symbols = [functools.reduce(node, symbols)]
        for s in symbols:
            where[s] = set(owners)
    of = defaultdict(set)
    for s, owners in where.items():
        for i in owners:
            of[i].add(s)
    shared = {i: sorted(s for s in of[i] if len(where[s]) > 1) for i in range(len(items))}
    together = Counter((a, b) for i in shared if len(shared[i]) <= most_mined for k, a in enumerate(shared[i]) for b in shared[i][k + 1 :])
    heap = [(-n, a, b) for (a, b), n in together.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, a, b = heapq.heappop(heap)
        both = where[a] & where[b]
        if len(both) < -n:
            if len(both) > 1:
                heapq.heappush(heap, (-len(both), a, b))
            continue
        made = node(a, b)
        where[made] = both
        where[a] -= both
        where[b] -= both
        beside = Counter()
        for i in both:
            of[i] -= {a, b}
            if len(of[i]) <= most_mined:
                beside.update(s for s in of[i] if len(where[s]) > 1)
            of[i].add(made)
        for s, n in beside.items():
            if n > 1:
                heapq.heappush(heap, (-n, s, made))
    return Plan(leaves, np.array(left, np.int64), np.array(right, np.int64), [sorted(of[i]) for i in range(len(items))])


def _levels(plan: Plan) -> list[np.ndarray]:
    """Inner nodes (from 0) by level: those of one level need nodes of earlier levels only."""
    level = np.zeros(plan.nodes, np.int64)
    first = len(plan.leaves)
    for k, (a, b) in enumerate(zip(plan.left, plan.right)):
        level[first + k] = 1 + max(level[a], level[b])
    inner = level[first:]
    return [np.flatnonzero(inner == x) for x in range(1, int(inner.max(initial=0)) + 1)]


class Accumulators:
    """Scores of a batch of documents for all items of a plan."""

    def __init__(self, plan: Plan, weights: np.ndarray):
        self.plan, self.levels = plan, _levels(plan)
        term = np.array([t for t, _ in plan.leaves], np.int64)
        self.factor = (weights[term] * np.array([k for _, k in plan.leaves], np.int64))[:, None] if len(term) else np.zeros((0, 1), np.int64)
        self.term = term
        self.ends = np.cumsum([0, *map(len, plan.items)])
        self.members = np.array([n for x in plan.items for n in x], np.int64)
        self.filled = np.flatnonzero(np.diff(self.ends) > 0)

    def scores(self, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """items x documents, from ``tf`` (terms x documents) and the documents' ``m``."""
        acc = np.zeros((self.plan.nodes, len(m)), np.int64)
        first = len(self.term)
        share = (1_000_000_000 * tf) // np.maximum(1000 * tf + 12 * m, 1)
        acc[:first] = share[self.term] * self.factor
        for at in self.levels:
            acc[first + at] = acc[self.plan.left[at]] + acc[self.plan.right[at]]
        out = np.zeros((len(self.plan.items), len(m)), np.int64)
        if len(self.filled):
            out[self.filled] = np.add.reduceat(acc[self.members], self.ends[self.filled], axis=0)
        return out


class Best:
    """The ``k`` best (score, then least id, nulls first) of each item among all rows shown."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.floor = np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, id, whether the id is null

    def show(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.floor[:, None])
        new = (item, scores[item, at], ids[at], nulls[at].astype(np.int64))
        self.rows = [np.concatenate(x) for x in zip(self.rows, new)]
        if len(self.rows[0]) > 4 * self.items * self.k:
            self.prune()

    def prune(self) -> None:
        item, score, ids, nulls = self.rows
        order = np.lexsort((ids, -nulls, -score, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(self.items))
        rank = np.arange(len(item)) - first[item]
        self.rows = [x[order][rank < self.k] for x in self.rows]
        full = rank == self.k - 1
        self.floor[item[full]] = score[order][full]


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, item_id, term, repeats): a row for each different term of each item row; a number for each row."""

    def run(batches):
        for batch in batches:
            rows = [(q, i, Counter(terms(t))) for q, i, t in zip(*(batch.column(c).to_pylist() for c in ("query", "item_id", "text")))]
            yield pa.record_batch(
                [pa.array([q for q, _, c in rows for _ in c], pa.int64()), pa.array([i for _, i, c in rows for _ in c], pa.int64()),
                 pa.array([t for _, _, c in rows for t in c], pa.binary()), pa.array([n for _, _, c in rows for n in c.values()], pa.int64())],
                names=["query", "item_id", "term", "repeats"],
            )

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).withColumn("query", F.monotonically_increasing_id())
    return rows.mapInArrow(run, "query long, item_id long, term binary, repeats long")


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_terms, terms, counts): of each whole text the number of terms, and which terms of the
    vocabulary it has how often (little-endian 32-bit and 64-bit integers)."""

    def run(batches):
        of = vocabulary.get
        for batch in batches:
            n, which, counts = [], [], []
            for text in batch.column("text").to_pylist():
                found = terms(text)
                held = Counter(map(of, found))
                held.pop(None, None)
                n.append(len(found))
                which.append(np.fromiter(held.keys(), "<i4", len(held)).tobytes())
                counts.append(np.fromiter(held.values(), "<i8", len(held)).tobytes())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(which, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n_terms", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_terms long, terms binary, counts binary")


def document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary: summed in tasks, then by term."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            for which in batch.column(0).to_pylist():
                df[np.frombuffer(which, "<i4")] += 1
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for row in counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


def _ranked(counted: DataFrame, accumulators: Accumulators, queries: list[tuple[int, int | None]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, item_id, doc_id, score): each task's best of each item."""
    size = int(accumulators.term.max(initial=-1)) + 1
    step = max(1, CELLS // max(1, accumulators.plan.nodes + size + len(queries)))

    def run(batches):
        best = Best(len(queries), k)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                tf = np.zeros((size, part.num_rows), np.int64)
                for d, (which, counts) in enumerate(zip(part.column("terms").to_pylist(), part.column("counts").to_pylist())):
                    tf[np.frombuffer(which, "<i4"), d] = np.frombuffer(counts, "<i8")
                m = 75 + (25 * part.column("n_terms").to_numpy() * n_docs) // max(n_terms, 1)
                ids = part.column("doc_id")
                best.show(accumulators.scores(tf, m), ids.fill_null(LEAST_LONG).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        best.prune()
        item, score, ids, nulls = best.rows
        yield pa.record_batch(
            [pa.array([queries[i][0] for i in item], pa.int64()), pa.array([queries[i][1] for i in item], pa.int64()),
             pa.array(ids, pa.int64(), mask=nulls.astype(bool)), pa.array(score)],
            names=["query", "item_id", "doc_id", "score"],
        )

    return counted.mapInArrow(run, "query long, item_id long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", terms_per_block: int = 50_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0.

    Every item is compared with every row of ``docs``.  Equal scores rank by ascending doc_id, null
    first; a null id is returned as null.  Rows of ``docs`` count one by one, so rows that share an id may
    each have a rank; rows of ``items`` are queries of their own, even if they share an id.  Null or empty texts
    have no terms: such a document is in no result and such an item has no rows.  Empty tables
    give an empty table.  Other columns are not read, so their names can't clash.
    ``terms_per_block`` bounds the different terms of the items that are mined and held at once
    (about; blocks are dealt by hash); each block reads the texts once more.
    """
    spark = docs.sparkSession
    asked = stored(item_terms(items, item_col, item_text_col), "search-items")
    blocks = blocks_of(asked.count(), terms_per_block)
    block = F.expr(f"pmod(xxhash64(query), {blocks}L)")
    found = []
    for b in range(blocks):
        rows = sorted((r["query"], r["term"], r["repeats"], r["item_id"]) for r in asked.where(block == b).collect())
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for _, t, _, _ in rows}))}
        queries = sorted({q: i for q, _, _, i in rows}.items())
        held = {q: Counter() for q, _ in queries}
        for q, t, n, _ in rows:
            held[q][vocabulary[bytes(t)]] = n
        counted = stored(term_counts(docs, vocabulary, id_col, text_col), "search-counts")
        n_docs, n_terms = counted.agg(F.count(F.when(F.col("n_terms") > 0, 1)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        df = document_frequencies(counted, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        accumulators = Accumulators(share_terms([held[q] for q, _ in queries]), weights)
        found.append(_ranked(counted, accumulators, queries, n_docs, n_terms, k))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("query", "item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
