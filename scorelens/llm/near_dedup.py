"""Operator 7: near-duplicate documents by MinHash bands and sequential Bayesian verification.

1. Each text becomes a set of word shingles, a class (hash of the set: copies are one class), a
   signature and band keys.  Only classes go on.
2. Bands: classes that share a band key are a bucket; buckets with the same members count once.
   In a bucket, members are compared batch by batch of their signatures and dropped once the
   posterior chance of reaching the similarity is under the miss probability.  What survives gives a
   spanning set of edges (never all pairs), and its components are clumps: two linked texts are in
   one clump.
3. In a clump, survivors of the same comparison are verified on the full shingle sets; verified
   links give the components.

Buckets and clumps beyond a size are dealt in pairs of blocks, so no task holds more than two
blocks and no pair is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.common import WordHashes, blocks_of, came_in, free_name, stored, with_id
from scorelens.llm.components import components
from scorelens.llm.shingles import band_keys, banding, link_group, shingle_set, signature, similar

#: Members of a block; a group holds one block, or two of a larger bucket or clump.
BLOCK = 4_000
#: Shingles of a block (8 bytes each).
BLOCK_SHINGLES = 2_000_000
#: Class rows (some 50 bytes each) up to which the list of texts to verify is broadcast.
BROADCAST_ROWS = 400_000


def _describe(size: int, bands: int, rows: int):
    n = bands * rows

    def run(batches):
        words = WordHashes()
        for batch in batches:
            out = {"id": batch.column(0), "h": batch.column(2), "n": [], "cls": [], "sig": [], "keys": []}
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size, words)
                out["n"].append(len(s))
                if len(s):
                    sig = signature(s, n)
                    out["cls"].append(xxhash.xxh3_128_digest(s.tobytes()))
                    out["sig"].append(sig.astype(np.uint16).tobytes())
                    out["keys"].append(band_keys(sig, bands, rows).view(np.int64))
                else:
                    for c in ("cls", "sig", "keys"):
                        out[c].append(None)
            yield pa.record_batch([out["id"], out["h"], pa.array(out["n"], pa.int64()), pa.array(out["cls"], pa.binary()), pa.array(out["sig"], pa.binary()), pa.array(out["keys"], pa.list_(pa.int64()))], names=list(out))

    return run


def _dealt(members: DataFrame, group: str, n: str, gather: int) -> DataFrame:
    """Adds the columns part (what is handed to one call) and sub (a group, or a pair of its blocks)."""
    blocks = F.ceil(F.col(n)).cast("long")
    own = F.expr(f"pmod(xxhash64(cls, 1), {n}_blocks)")
    df = members.withColumn(f"{n}_blocks", F.greatest(blocks, F.lit(1).cast("long"))).withColumn("own", own)
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col(f"{n}_blocks") - 1), lambda other: F.struct(F.least(F.col("own"), other).alias("i"), F.greatest(F.col("own"), other).alias("j")))
    df = df.withColumn("pair", F.explode(pair))
    df = df.withColumn("sub", F.xxhash64(group, "pair.i", "pair.j"))
    small = F.expr(f"pmod(xxhash64({group}, 2), {gather}L)")
    return df.withColumn("part", F.when(F.col(f"{n}_blocks") == 1, small).otherwise(F.col("sub"))).drop("own", "pair", f"{n}_blocks")


def _groups(subs: np.ndarray):
    order = np.argsort(subs, kind="stable")
    cuts = np.flatnonzero(np.diff(subs[order])) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def _edge_table(classes, edges) -> pa.Table:
    return pa.table({"a": pa.array([classes[i] for i, _ in edges], pa.binary()), "b": pa.array([classes[j] for _, j in edges], pa.binary())})


def candidate_clumps(described: DataFrame, least: float, miss: float) -> DataFrame:
    """(cls, clump): classes whose signatures may be similar, directly or through others."""
    one = described.where("cls is not null").select("cls", "sig", "keys").dropDuplicates(["cls"])
    one = stored(one, "near-classes")
    keyed = one.select("cls", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("cls").alias("low"), F.bit_xor(F.xxhash64("cls")).alias("x")).where("size > 1")
    buckets = buckets.groupBy("size", "low", "x").agg(F.min("key").alias("key")).select("key", (F.col("size") / BLOCK).alias("load"))
    members = stored(keyed.join(buckets, "key"), "near-buckets")
    gather = blocks_of(members.count(), 2 * BLOCK)

    def link(t: pa.Table) -> pa.Table:
        classes = t.column("cls").to_pylist()
        sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(classes), -1)
        edges = []
        for g in _groups(t.column("sub").to_numpy()):
            edges += [(g[i], g[j]) for i, j in link_group(sigs[g], least, miss)]
        return _edge_table(classes, edges)

    dealt = _dealt(members, "key", "load", gather).join(one.select("cls", "sig"), "cls")
    edges = dealt.select("part", "sub", "cls", "sig").groupBy("part").applyInArrow(link, "a binary, b binary")
    return components(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "near-clumps").select(F.col("node").alias("cls"), F.col("root").alias("clump"))


def verified_links(docs: DataFrame, described: DataFrame, clumps: DataFrame, size: int, percent: int, n_hashes: int, miss: float) -> DataFrame:
    """Edges (a, b) between classes, verified on full sets, that span all components."""
    reps = described.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.min("n").alias("n"))
    loads = clumps.join(reps, "cls")
    per = loads.groupBy("clump").agg(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES).alias("load"))
    needed = stored(loads.join(per, "clump").select("cls", "clump", "id", "load"), "near-needed")
    count = needed.count()
    gather = blocks_of(count, 1000)
    side = F.broadcast(needed) if count <= BROADCAST_ROWS else needed
    # the signatures are made anew from the texts: cheaper than another shuffle of signatures
    texts = docs.select(F.col("__id").alias("id"), F.col("__text").alias("text")).join(side, "id")
    dealt = _dealt(texts, "clump", "load", gather)

    def link(t: pa.Table) -> pa.Table:
        subs = t.column("sub").to_numpy()
        classes = t.column("cls").to_pylist()
        raw = t.column("set").to_pylist()
        sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(classes), -1)
        edges = []
        for g in _groups(subs):
            g = np.array(list({classes[i]: i for i in g}.values()))  # repeated rows
            sets = [np.frombuffer(raw[i], np.uint64) for i in g]
            sizes = np.array([len(s) for s in sets])
            flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
            check = lambda leader, rows, sets=sets, flat=flat, starts=starts, sizes=sizes: similar(sets[leader], flat, starts, sizes, rows, percent)
            edges += [(g[i], g[j]) for i, j in link_group(sigs[g], percent / 100, miss, check)]
        return _edge_table(classes, edges)

    sets = dealt.select("part", "sub", "cls", "text").mapInArrow(_sets_and_signatures(size, n_hashes), "part long, sub long, cls binary, sig binary, set binary")
    return sets.groupBy("part").applyInArrow(link, "a binary, b binary")


def _sets_and_signatures(size: int, n: int):
    def run(batches):
        words = WordHashes()
        for batch in batches:
            keep, sets, sigs = [], [], []
            for i, (cls, text) in enumerate(zip(batch.column("cls").to_pylist(), batch.column("text").to_pylist())):
                s = shingle_set(text, size, words)
                if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == cls:  # else an id that two texts share
                    keep.append(i)
                    sets.append(s.tobytes())
                    sigs.append(signature(s, n).astype(np.uint16).tobytes())
            kept = batch.select(["part", "sub", "cls"]).take(pa.array(keep, pa.int64()))
            yield pa.record_batch([*kept.columns, pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], names=["part", "sub", "cls", "sig", "set"])

    return run


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
                    miss: float = 1e-6) -> DataFrame:
    """(id, h, n_shingles, component_id), one row per row of ``docs``; h is xxhash64 of the text.

    Texts are linked when 100 * intersection >= percent * union of their sets of ``shingle``-word
    shingles (A-Z lower-cased; fewer words are one shingle).  component_id is the smallest id that
    links reach, the own id included.  Null, empty or blank texts have no shingles and no links.  Equal
    texts are linked.  A null id stays null and is the smallest id (component_id then is -2**63); rows that share an id
    are texts of their own.  An empty table gives an empty one.  ``miss`` bounds the chance that the
    bands, or one look of the Bayesian comparison, lose a pair at the similarity itself.
    """
    bands, rows = banding(percent / 100, miss)
    plain = with_id(docs.select(F.col(id_col).alias("__in"), F.col(text_col).alias("__text")), "__in", "__id")
    described = stored(plain.select("__id", "__text", F.xxhash64("__text")).mapInArrow(_describe(shingle, bands, rows), "id long, h long, n long, cls binary, sig binary, keys array<long>"), "near-described")
    clumps = stored(candidate_clumps(described, percent / 100, miss), "near-clumped")
    links = verified_links(plain, described, clumps, shingle, percent, bands * rows, miss)
    roots = components(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "near-links")
    firsts = described.where("cls is not null").groupBy("cls").agg(F.min("id").alias("first"))
    firsts = firsts.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = firsts.groupBy("root").agg(F.min("first").alias("low"))
    by_class = firsts.join(lowest, "root").select("cls", "low")
    return described.select("id", "h", "n", "cls").join(by_class, "cls", "left").select(came_in("id").alias("id"), "h", F.col("n").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component (see ``near_components``).

    Rows that share id and text are one document and stay together; texts without words stay."""
    found = near_components(docs, id_col, text_col, shingle, percent)
    gone = stored(found.where("id > component_id").select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct(), "near-gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    i, h = free_name(docs, "near_id"), free_name(docs, "near_hash")
    side = side.select(F.col("__id").alias(i), F.col("__h").alias(h))
    keyed = with_id(docs, id_col, i).withColumn(h, F.xxhash64(text_col))
    return keyed.join(side, [i, h], "left_anti").select(docs.columns)
