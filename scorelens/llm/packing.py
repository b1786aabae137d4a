"""Operator 6: pack token ids into sequences by cutting-stock column generation.

1. Each text is encoded once and cut into full sequences, a half and a rest; (start, length, crc32) of each
   piece are known then, so the ids themselves need not be stored.
2. The histogram of piece lengths (at most 2048 numbers) goes to the driver; a linear program over
   patterns, priced by a knapsack, says how often each pattern is used.  Rounded patterns and the bins
   of what is left use every piece once.
3. Pieces are ranked inside their length class, in buckets so that a class with a third of all pieces
   is spread, and the k-th piece of a class takes the k-th place of that class in the plan.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.llm import cutting_stock
from scorelens.llm.chunk_ids import chunk_ids
from scorelens.llm.common import blocks_of, stored

#: Texts encoded at once; bounds a Python worker's memory.
SLICE = 256


def cuts(n: int, max_tokens: int) -> list[tuple[int, int]]:
    """Pieces of a text of n ids: full sequences, then half a one if there is as much, then the rest.

    Halves pair up, and rests under a half fit together almost without loss."""
    ends = list(range(max_tokens, n + 1, max_tokens))
    full = ends[-1] if ends else 0
    if n - full >= max_tokens // 2:
        ends.append(full + max_tokens // 2)
    if not ends or ends[-1] < n:
        ends.append(n)
    return list(zip([0, *ends[:-1]], ends))


def _cut(tokenizer_file: str, max_tokens: int, end_id: int, with_ids: bool):
    def run(batches):
        encode = chunk_ids(tokenizer_file)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = {k: [] for k in ("id", "start", "length", "crc", "total", "ids")}
                for i, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start, stop in cuts(len(ids), max_tokens):
                        piece = ids[start:stop]
                        raw = piece.tobytes()
                        for k, v in zip(rows, (i, start, len(piece), zlib.crc32(raw), len(ids), raw if with_ids else None)):
                            rows[k].append(v)
                kinds = dict(zip(rows, [pa.int64()] * 5 + [pa.binary()]))
                yield pa.record_batch([pa.array(v, kinds[k]) for k, v in rows.items()], names=list(rows))

    return run


def places(histogram: dict[int, int], max_tokens: int, width: int):
    """(class, rank) -> (sequence, place): sorted keys and what they stand for, from the plan."""
    classes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[c] for c in classes], np.int64)
    keys, firsts, each, bases, slots = [], [], [], [], []
    taken, sequence = np.zeros(len(classes), np.int64), 0
    for counts, bins in cutting_stock.plan(classes, demand, max_tokens // width):
        slot = 0
        for i in np.flatnonzero(counts):
            keys.append((int(classes[i]) << 44) + int(taken[i]))
            firsts.append(taken[i])
            each.append(counts[i])
            bases.append(sequence)
            slots.append(slot)
            taken[i] += counts[i] * bins
            slot += int(counts[i])
        sequence += bins
    order = np.argsort(keys)
    return [np.array(x, np.int64)[order] for x in (keys, firsts, each, bases, slots)]


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048,
         end_id: int = 1, width: int = 4, with_ids: bool = False, pieces_per_bucket: int = 50_000) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, the
    little-endian 32-bit ids, if asked for).

    A text's ids are those of the tokenizer and ``end_id``.  Texts are cut by ``cuts``; a
    sequence holds ``max_tokens`` at most.  Classes are ``width`` tokens wide, which is what a piece may
    waste.  Null or empty text: the end id alone.  Repeated rows are packed each; a null id stays null.
    An empty table gives an empty one.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    schema = "id long, start long, length long, crc long, total long, ids binary"
    pieces = stored(plain.mapInArrow(_cut(tokenizer_file, max_tokens, end_id, with_ids), schema), "packing-pieces")
    pieces = pieces.withColumn("cls", F.ceil(F.col("length") / width))
    sizes = pieces.groupBy("cls").count().collect()  # at most max_tokens / width rows
    rows = sum(r["count"] for r in sizes)
    keys, firsts, each, bases, slots = places({r["cls"]: r["count"] for r in sizes}, max_tokens, width)

    buckets = blocks_of(rows, pieces_per_bucket)
    pieces = pieces.withColumn("bucket", F.expr(f"pmod(xxhash64(id, start, crc), {buckets})"))
    before = Window.partitionBy("cls").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("cls", "bucket").count().select("cls", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("cls", "bucket").orderBy("id", "start", "crc")) - 1
    ranked = pieces.withColumn("inside", inside).join(offsets, ["cls", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))

    @F.pandas_udf("sequence long, slot long")
    def place(cls: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (cls.to_numpy() << 44) + rank.to_numpy(), side="right") - 1
        back = rank.to_numpy() - firsts[at]
        return pd.DataFrame({"sequence": bases[at] + back // each[at], "slot": slots[at] + back % each[at]})

    placed = ranked.withColumn("p", place("cls", "rank"))
    earlier = Window.partitionBy("p.sequence").orderBy("p.slot").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select(
        F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"),
        F.col("p.sequence").alias("sequence_id"), F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"), "ids",
    )
    return out if with_ids else out.drop("ids")
