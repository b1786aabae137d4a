"""Operator 1: drop lines that many documents share, by a sharded minimal perfect hash.

1. Each document's distinct line keys become 128-bit hashes; one aggregation
   (partial on the map side, so a line in a third of all documents is a few
   rows) gives documents per key and the largest id.
2. Keys found twice or more go to shards by hash.  Each shard is a minimal
   perfect hash with arrays of fingerprints, counts and largest ids.
3. Documents stand in blocks.  A block asks a shard for each of its keys once
   (so a hot line is at most one question per block), the shard probes its
   arrays, and the answers (only keys that lose lines) meet the block's texts.

Lines themselves are never joined; texts are shuffled once, by block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm import mphf
from scorelens.llm.common import BLANKS, blocks_of, guarded, replace_columns, stored, with_id

#: Answers of more blocks than this go to further copies of a shard.
BLOCKS_PER_COPY = 16_384
STATS = ["n_lines", "n_dropped"]


def line_digest(line: str, min_chars: int) -> bytes | None:
    """Hash of a line's key (stripped, A-Z lower-cased), None for keys that are too short."""
    key = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def _keys(min_chars: int):
    def run(batches):
        for batch in batches:
            block, ids, digests = [], [], []
            for b, i, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = {line_digest(x, min_chars) for x in text.split("\n")} if text else set()
                found.discard(None)
                digests += found
                block += [b] * len(found)
                ids += [i] * len(found)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.record_batch(
                [pa.array(block, pa.int64()), pa.array(ids, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())],
                names=["block", "id", "h1", "h2"],
            )

    return run


def line_keys(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """(block, id, h1, h2) of each document's distinct line keys; docs has __block and __id."""
    return docs.select("__block", "__id", text_col).mapInArrow(_keys(min_chars), "block long, id long, h1 long, h2 long")


def build_index(keys: DataFrame, keys_per_shard: int = 200_000, min_copies: int = 2) -> tuple[DataFrame, int]:
    """Sharded index over the distinct hashes that ``min_copies`` documents or more hold.

    Returns rows (shard, sizes, bits, fingerprints, counts, last_ids) and the number of shards."""
    counts = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    counts = stored(counts.where(F.col("n") >= min_copies), "line-counts")
    shards = blocks_of(counts.count(), keys_per_shard)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["h1"].to_numpy().view(np.uint64), pdf["h2"].to_numpy().view(np.uint64)
        sizes, bits = mphf.build(a, b)
        at = mphf.Lookup(sizes, bits)(a, b)
        prints, counted, last = (np.empty(len(a), np.int64) for _ in range(3))
        prints[at], counted[at], last[at] = pdf["h2"], pdf["n"], pdf["last"]
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "sizes": [sizes.tobytes()], "bits": [np.packbits(bits).tobytes()], "prints": [prints.tobytes()], "counts": [counted.tobytes()], "lasts": [last.tobytes()]})

    schema = "shard long, sizes binary, bits binary, prints binary, counts binary, lasts binary"
    return counts.withColumn("shard", F.expr(f"pmod(h1, {shards}L)")).groupBy("shard").applyInPandas(build, schema), shards


def probe(asked: DataFrame, index: DataFrame, shards: int, blocks: int, min_docs: int) -> DataFrame:
    """(block, h1, h2, last) for each asked (block, h1, h2) whose key at least ``min_docs`` documents hold."""
    copies = blocks_of(blocks, BLOCKS_PER_COPY)
    asked = asked.withColumn("shard", F.expr(f"pmod(h1, {shards}L)")).withColumn("copy", F.expr(f"block % {copies}L"))
    index = index.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        out = left.select(["block", "h1", "h2"])
        if not left.num_rows or not right.num_rows:
            return out.slice(0, 0).append_column("last", pa.array([], pa.int64()))
        row = {c: right.column(c)[0].as_py() for c in ("sizes", "bits", "prints", "counts", "lasts")}
        sizes = np.frombuffer(row["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sizes.sum()].astype(bool)
        prints, counts, lasts = (np.frombuffer(row[c], np.int64) for c in ("prints", "counts", "lasts"))
        h1, h2 = (left.column(c).to_numpy() for c in ("h1", "h2"))
        at = mphf.Lookup(sizes, bits)(h1.view(np.uint64), h2.view(np.uint64))
        hit = (at >= 0) & (prints[at] == h2) & (counts[at] >= min_docs)
        return out.filter(pa.array(hit)).append_column("last", pa.array(lasts[at[hit]]))

    return asked.groupBy("shard", "copy").cogroup(index.groupBy("shard", "copy")).applyInArrow(look, "block long, h1 long, h2 long, last long")


@guarded
def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
                docs_per_block: int = 1000) -> DataFrame:
    """All rows and columns of ``docs``; the text keeps the lines that are not dropped, and
    ``n_lines`` (before dropping) and ``n_dropped`` are added.

    A key of ``min_chars`` code points or more that ``min_docs`` rows or more hold loses its lines
    except in the rows with the largest id that holds it (all of them there, repeats too).
    Null or empty text: one empty line, and the text is ''.  A null id is the smallest id.  Repeated
    rows count as documents each; rows that share the largest id all keep the line.  An empty table
    gives an empty table; input columns named like an added column are replaced.
    """
    keep = replace_columns(docs, STATS)
    blocks = blocks_of(docs.count(), docs_per_block)
    dealt = with_id(docs.select(keep), id_col, "__id").withColumn("__block", F.expr(f"pmod(xxhash64(__id), {blocks}L)"))
    keys = line_keys(dealt, text_col, min_chars)
    index, shards = build_index(keys)
    answers = probe(keys.select("block", "h1", "h2").distinct(), index, shards, blocks, min_docs)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.select(keep).schema] + [T.StructField(c, T.LongType()) for c in STATS])

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        lasts = right.column("last").to_pylist()
        h = np.stack([right.column("h1").to_numpy(), right.column("h2").to_numpy()], 1).astype("<i8")
        last = {row.tobytes(): i for row, i in zip(h, lasts)}
        texts, n_lines, n_dropped = [], [], []
        for i, text in zip(left.column("__id").to_pylist(), left.column(text_col).to_pylist()):
            lines = (text or "").split("\n")
            kept = lines
            if last:
                kept = [x for x in lines if last.get(line_digest(x, min_chars), i) == i]
            texts.append("\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        kind = left.schema.field(text_col).type
        cols = [pa.array(texts, kind) if c == text_col else left.column(c) for c in keep]
        return pa.table([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*keep, *STATS])

    return dealt.groupBy("__block").cogroup(answers.groupBy("block")).applyInArrow(drop, schema)
