"""Operator 11: prefix trie of conversations in sharded double arrays.

1. ``numbered_turns`` gives each turn its place: turns are sorted by ranges of (conversation, turn), so
   a conversation with a third of all rows is spread over tasks, and each task numbers its rows.
2. ``rebuilt_segments`` makes a conversation of a shared head and its own turns, as segments of at most
   ``segment_turns`` turns.  A node is known by 128 bits: the exclusive or of the hashes of its turns
   together with their depths, so the node where a segment starts follows from the segments before it.
3. Segments go to shards by ranges of their first prefixes.  A shard numbers its turns densely, packs a
   double array (BASE, CHECK) and walks it with every segment; what the segments carry is
   summed by node.  Nodes that several shards share are merged by their 128 bits.
4. Sums over subtrees need no walk from leaf to root.  Each node is owned by its smallest member, which
   then owns all that follows on its path; T is the sum of what one conversation owns.  A subtree's sum is the
   sum of T over the node's members (the same walk again, carrying T) less what the node's owner owns
   above it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.llm.common import blocks_of, mix64, ragged, stored
from scorelens.llm.double_array import DoubleArray
from scorelens.plans.broadcast import checked_broadcast
from scorelens.session import shuffle_partitions

NODE = ["n1", "n2"]
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Nodes of one owner that a window holds in one partition.
CHUNK = 4096
TURN = np.dtype([("d1", "<i8"), ("d2", "<i8"), ("chars", "<i8")])


def _number(batches):
    """Sorted turns to (conv_id, part, place, d1, d2, chars); places count from 1 within this partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        rows = np.arange(len(conv))
        first = np.maximum.accumulate(np.where(np.r_[True, conv[1:] != conv[:-1]], rows, 0))
        place = rows - first + 1
        if conv[0] == last:
            place[first == 0] += seen
        last, seen = conv[-1], place[-1]
        digests, chars = [], []
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
            raw = role.encode()
            digests.append(xxhash.xxh3_128_digest(len(raw).to_bytes(8, "little") + raw + text.encode()))
            chars.append(len(text))
        d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        yield pa.record_batch(
            [pa.array(conv), pa.array(np.full(len(conv), part)), pa.array(place), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(chars, pa.int64())],
            names=["conv_id", "part", "place", "d1", "d2", "chars"],
        )


def numbered_turns(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv_id, pos, d1, d2, chars): place of each turn from 1, 128-bit hash of role and text, code points of the text.

    By turn, null first, then role, then text; null role and text are empty.  Rows with a null
    conversation belong to none and are left out."""
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))),
    ).where("conv_id is not null")
    ranges = [F.col("conv_id"), F.asc_nulls_first("turn"), F.substring("role", 1, 32), F.substring("text", 1, 64)]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *ranges)
    dealt = dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    turns = stored(dealt.mapInArrow(_number, "conv_id long, part long, place long, d1 long, d2 long, chars long"), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = turns.groupBy("conv_id", "part").agg(F.max("place").alias("n")).withColumn("before", F.sum("n").over(before))
    # one conversation a partition at most began in an earlier one
    carried = checked_broadcast(parts.where("before > 0").select("conv_id", "part", "before"))
    return turns.join(carried, ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "d1", "d2", "chars")


def _marks(d: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each turn at its depth."""
    z = mix64(depth.astype(np.uint64) * _GOLD)
    return mix64(d["d1"].view(np.uint64) ^ z), mix64(d["d2"].view(np.uint64) + z)


def _running(marks: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exclusive or from the start of its sequence to each place; sequences stand one after another."""
    total = np.bitwise_xor.accumulate(marks) if len(marks) else marks
    before = np.where(starts > 0, total[np.maximum(starts, 1) - 1] if len(total) else 0, 0).astype(np.uint64)
    return total ^ np.repeat(before, lengths)


def _packed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Turns of all rows, and start, length and first depth of each row."""
    raw = batch.column("turns").to_pylist()
    lengths = np.fromiter((len(x) // TURN.itemsize for x in raw), np.int64, len(raw))
    return np.frombuffer(b"".join(raw), TURN), np.cumsum(lengths) - lengths, lengths, batch.column("depth").to_numpy()


def _segments(batches):
    """Turn lists to packed turns, their 128 bits (s1, s2) and the bits of the first one to four turns."""
    for batch in batches:
        lists = batch.column("turns")
        flat, lengths = lists.flatten(), np.asarray(lists.value_lengths().fill_null(0), np.int64)
        turns = np.zeros(len(flat), TURN)
        for c in TURN.names:
            turns[c] = flat.field(c).to_numpy()
        starts, depth = np.cumsum(lengths) - lengths, batch.column("depth").to_numpy()
        m1, m2 = _marks(turns, ragged(depth, lengths))
        p1, p2 = _running(m1, starts, lengths), _running(m2, starts, lengths)
        at = lambda p, k: np.where(lengths > 0, p[np.clip(starts + np.minimum(k, lengths) - 1, 0, max(len(p) - 1, 0))] if len(p) else 0, 0).astype(np.uint64).view(np.int64)
        ends = starts + lengths
        packed = [turns[s:e].tobytes() for s, e in zip(starts, ends)]
        bits = [pa.array(x) for x in (at(p1, lengths), at(p2, lengths), at(p1, 1), at(p1, 2), at(p1, 3), at(p1, 4))]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seg"), pa.array(depth), pa.array(packed, pa.binary()), *bits], names=["conv_id", "seg", "depth", "turns", "s1", "s2", "r1", "r2", "r3", "r4"])


def rebuilt_segments(turns: DataFrame, shared: int, base, head, segment_turns: int) -> DataFrame:
    """(conv_id, seg, depth, turns, start1, start2, s1, s2, r1..r4): each conversation as a head of the first ``head``
    turns of conversation ``base``, then its own turns after its first ``head``, in segments.

    ``base`` and ``head`` are columns of conv_id; ``head`` is at most ``shared``.  A conversation without turns has one empty segment."""
    turn = F.struct("pos", "d1", "d2", "chars")
    heads = turns.where(F.col("pos") <= shared).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("opening"))
    convs = turns.select("conv_id").distinct().withColumn("base", base)
    own = turns.withColumn("head", head).where("pos > head").withColumn("seg", F.expr(f"(pos - head - 1) div {segment_turns}L"))
    own = own.groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list(turn)).alias("own"))
    bare = lambda c: F.transform(c, lambda t: F.struct(t["d1"].alias("d1"), t["d2"].alias("d2"), t["chars"].alias("chars")))
    none = F.array().cast("array<struct<d1:bigint,d2:bigint,chars:bigint>>")
    opening = F.coalesce(F.slice(bare("opening"), F.lit(1), head.cast("int")), none)
    rows = convs.join(heads, "base", "left").select("conv_id", opening.alias("opening")).join(own, "conv_id", "left")
    rows = rows.withColumn("seg", F.coalesce("seg", F.lit(0).cast("long")))
    mine = F.coalesce(bare("own"), none)
    rows = rows.select(
        "conv_id", "seg",
        F.when(F.col("seg") == 0, F.lit(1)).otherwise(F.size("opening") + F.col("seg") * segment_turns + 1).cast("long").alias("depth"),
        F.when(F.col("seg") == 0, F.concat("opening", mine)).otherwise(mine).alias("turns"),
    )
    segments = stored(rows.mapInArrow(_segments, "conv_id long, seg long, depth long, turns binary, s1 long, s2 long, r1 long, r2 long, r3 long, r4 long"), "segments")
    # where the segments after the first start: the bits of all segments before
    long_ = segments.where("seg > 0").select("conv_id").distinct()
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    bits = [F.coalesce(F.bit_xor(s).over(before), F.lit(0)).cast("long").alias(f"start{s[1]}") for s in ("s1", "s2")]
    starts = segments.select("conv_id", "seg", "s1", "s2").join(long_, "conv_id", "left_semi").select("conv_id", "seg", *bits)
    later = segments.where("seg > 0").join(starts, ["conv_id", "seg"])
    zero = F.lit(0).cast("long")
    return stored(segments.where("seg = 0").withColumns({"start1": zero, "start2": zero}).unionByName(later), "started")


def _shard(carried: list[str]):
    """One shard: dense turn ids, double array, walk; (node, parent, depth, chars, conv_id, sums) of its nodes."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        batch = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        turns, starts, lengths, depth = _packed(batch)
        column = lambda c: batch.column(c).to_numpy()
        pair = lambda a, b: np.stack([a, b], 1).view([("a", "<i8"), ("b", "<i8")])[:, 0]
        _, ids = np.unique(pair(turns["d1"], turns["d2"]), return_inverse=True)
        opened, which = np.unique(pair(column("start1"), column("start2")), return_inverse=True)
        # a sequence begins with the node where its segment starts: ids below len(opened)
        at = starts + np.arange(len(starts))
        symbols = np.empty(len(turns) + len(starts), np.int64)
        inner = np.ones(len(symbols), bool)
        inner[at] = False
        symbols[at], symbols[inner] = which, ids + len(opened)
        trie = DoubleArray(symbols, at, lengths + 1)
        node = trie.walk(symbols, at, lengths + 1)[inner]
        level = ragged(depth, lengths)
        new = {"depth": level, "chars": turns["chars"]}
        row = np.repeat(np.arange(len(starts)), lengths)
        for k, marks in enumerate(_marks(turns, level), 1):
            start = column(f"start{k}").view(np.uint64)
            here = _running(marks, starts, lengths) ^ np.repeat(start, lengths)
            parent = np.r_[np.uint64(0), here[:-1]] if len(here) else here
            parent[starts[lengths > 0]] = start[lengths > 0]
            new[f"n{k}"], new[f"p{k}"] = here.view(np.int64), parent.view(np.int64)
        found, first, inverse = np.unique(node, return_index=True, return_inverse=True)
        least = np.full(len(found), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, column("conv_id")[row])
        sums = {}
        for c in carried:
            sums[c] = np.zeros(len(found), np.int64)
            np.add.at(sums[c], inverse, column(c)[row])
        out = {c: np.ascontiguousarray(x[first]) for c, x in new.items()} | {"conv_id": least} | sums
        yield pa.record_batch([pa.array(out[c]) for c in out], names=list(out))

    return run


def node_sums(segments: DataFrame, carried: list[str], shards: int) -> DataFrame:
    """(n1, n2, p1, p2, depth, chars, conv_id, *carried): for each node, the sums of ``carried`` over the
    segments that lead through it, and the least conv_id of them."""
    keys = ["start1", "start2", "r1", "r2", "r3", "r4", "s1"]
    schema = "depth long, chars long, n1 long, p1 long, n2 long, p2 long, conv_id long" + "".join(f", {c} long" for c in carried)
    local = segments.select("turns", "depth", *keys, "conv_id", *carried).repartitionByRange(shards, *keys).mapInArrow(_shard(carried), schema)
    same = [F.first(c).alias(c) for c in ("p1", "p2", "depth", "chars")]
    return local.groupBy(*NODE).agg(*same, F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in carried))


def _ends(batches):
    """Sorted (n1, n2, conv_id) to the SHA-256 of each node's ids; a node's ids are never held together."""
    node, digest, out = None, None, []

    def done():
        if digest is not None:
            out.append((*node, digest.hexdigest()))

    for batch in batches:
        for n1, n2, conv in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "conv_id"))):
            if (n1, n2) != node:
                done()
                node, digest = (n1, n2), hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        if out:
            yield _ends_batch(out)
            out.clear()
    done()
    yield _ends_batch(out)


def _ends_batch(rows):
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["n1", "n2", "ends_sha256"])


def _above(nodes: DataFrame) -> DataFrame:
    """``nodes`` with above_saved and above_leaf: what the node's owner owns above it.

    Summed in chunks of depths, so that a very long conversation is more than one window."""
    nodes = nodes.withColumn("chunk", F.expr(f"depth div {CHUNK}L"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    chunks = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = nodes.groupBy("conv_id", "chunk").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    earlier = totals.select("conv_id", "chunk", *(F.sum(c).over(chunks).alias(f"earlier_{c}") for c in ("saved", "leaf"))).where("earlier_saved is not null")
    out = nodes.join(checked_broadcast(earlier), ["conv_id", "chunk"], "left")
    both = lambda c: (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.coalesce(f"earlier_{c}", F.lit(0))).alias(f"above_{c}")
    return out.select(*NODE, "p1", "p2", "depth", "conv_id", "n_convs", "n_children", both("saved"), both("leaf"))


def conversation_trie(conversations: DataFrame, shared: int = 5, base=None, head=None, segment_turns: int = 256,
                      turns_per_shard: int = 500_000, **columns: str) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the prefix trie.

    ``base`` and ``head`` are columns over conv_id that say from which conversation the first ``head``
    (at most ``shared``) turns come; by default each conversation keeps its own.  ``columns`` names
    conv_col, turn_col, role_col, text_col.  Turns stand by turn (null first), equal turns by role, then by
    text; repeated rows are turns of their own.  Null role or text is empty.  A null conversation is none:
    its rows are left out.  No conversations: no nodes, not even the root.  Other columns are not
    read, so their names can't clash.
    """
    base = F.col("conv_id") if base is None else base
    head = F.lit(0).cast("long") if head is None else head.cast("long")
    spark = conversations.sparkSession
    turns = numbered_turns(conversations, **columns)
    segments = rebuilt_segments(turns, shared, base, head, segment_turns)
    size = segments.agg(F.coalesce(F.sum(F.length("turns")), F.lit(0))).first()[0]
    n_turns = size // TURN.itemsize
    shards = max(blocks_of(n_turns, turns_per_shard), min(shuffle_partitions(spark), blocks_of(n_turns, 5_000)))

    # equal segments that start at one node are one sequence
    key = ["depth", "start1", "start2", "s1", "s2"]
    different = segments.where(F.length("turns") > 0).groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.first(c).alias(c) for c in ("turns", "r1", "r2", "r3", "r4")))
    zero = F.lit(0).cast("long")
    no_parent = {c: F.lit(None).cast("long") for c in ("p1", "p2")}
    root = segments.where("seg = 0").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("n1"), zero.alias("n2"), *(c.alias(n) for n, c in no_parent.items()), zero.alias("depth"), zero.alias("chars"), "conv_id", "n_convs")
    nodes = stored(node_sums(different, ["n_convs"], shards).unionByName(root), "nodes")

    kids = nodes.where("p1 is not null").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    valued = nodes.join(kids, NODE, "left").select(
        *NODE, "p1", "p2", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"),
    )
    valued = stored(valued, "valued")
    owned = valued.groupBy("conv_id").agg(F.sum("saved").alias("t_saved"), F.sum("leaf").alias("t_leaf")).where("t_saved > 0 or t_leaf > 0")
    carrying = stored(segments.join(owned, "conv_id"), "carrying")
    whole = carrying.where("seg = 0").agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("t_saved", "t_leaf")))
    walked = node_sums(carrying.where(F.length("turns") > 0), ["t_saved", "t_leaf"], shards).select(*NODE, "t_saved", "t_leaf")
    walked = walked.unionByName(whole.select(zero.alias("n1"), zero.alias("n2"), "t_saved", "t_leaf"))

    finals = segments.groupBy("conv_id").agg(F.bit_xor("s1").alias("n1"), F.bit_xor("s2").alias("n2"))
    ends = finals.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(_ends, "n1 long, n2 long, ends_sha256 string")
    names = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return (
        _above(valued).join(walked, NODE).join(ends, NODE, "left").join(names, ["p1", "p2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            (F.col("t_leaf") - F.col("above_leaf")).alias("n_leaves"), (F.col("t_saved") - F.col("above_saved")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
