"""Conversation prefix trie: against a plain restatement, on odd rows, over small segments and shards."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens.llm.conversation_trie import conversation_trie
from scorelens.llm.double_array import DoubleArray

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The contract, written with dicts: {(smallest member, depth): the other columns}."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1]) if node else 0
    out = {}
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[min(of), len(node)] = (parent, len(of), kids.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
    return out


def run(spark, rows, **options):
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 6
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("pos", "part", "base", "n1", "depth", "turns")})
    found = conversation_trie(docs, shared=5, base=conv - conv % 100, head=head, **options).collect()
    out = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in found}
    assert len(out) == len(found)
    return out


def conversations(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-30, 330), n):
        for turn in range(r.choice([1, 2, 3, 5, 8, 13])):
            rows.append((c, turn, r.choice(["user", "assistant"]), r.choice(["", "a", "bb", "日本", "x" * 40])))
    return rows


@pytest.mark.parametrize("seed,segment,shard", [(1, 256, 500_000), (2, 2, 20), (3, 3, 7)])
def test_against_plain(spark, seed, segment, shard):
    rows = conversations(seed)
    assert run(spark, rows, segment_turns=segment, turns_per_shard=shard) == plain(rows)


def test_copies_and_long_conversations(spark):
    same = [(t, "user", f"turn {t}") for t in range(7)]
    rows = [(c, *turn) for c in range(0, 300, 3) for turn in same] + [(301, t, "user", f"turn {t % 2}") for t in range(400)]
    assert run(spark, rows, segment_turns=50, turns_per_shard=100) == plain(rows)


def test_odd_rows(spark):
    rows = [(100, None, "user", "first"), (100, 2, None, "x"), (100, 1, "user", None), (101, 5, "user", "first"), (101, 5, "user", "first"),
            (None, 1, "user", "nobody"), (205, 1, "user", "y" * 100_000), (-7, 0, "b", "tie"), (-7, 0, "a", "tie"), (-7, 0, "a", "sooner")]
    found = run(spark, rows)
    assert found == plain(rows)
    assert run(spark, []) == {}
    assert run(spark, [(None, 1, "user", "nobody")]) == {}


def test_own_turns_alone(spark):
    rows = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "u", "b")]
    found = {(r["conv_id"], r["depth"]): (r["n_convs"], r["n_children"]) for r in conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {(1, 0): (2, 1), (1, 1): (2, 1), (2, 2): (1, 0)}


def test_double_array():
    r = random.Random(5)
    for width in (1, 3, 1000):
        sequences = [[r.randrange(width) for _ in range(r.randrange(1, 9))] for _ in range(400)]
        lengths = np.array([len(s) for s in sequences])
        starts, flat = np.cumsum(lengths) - lengths, np.array([x for s in sequences for x in s])
        trie = DoubleArray(flat, starts, lengths)
        nodes = trie.walk(flat, starts, lengths)
        of = {}
        for s, a, n in zip(sequences, starts, lengths):
            for d in range(n):
                assert of.setdefault(tuple(s[: d + 1]), nodes[a + d]) == nodes[a + d]
        assert len(set(of.values())) == len(of) == trie.nodes - 1
        for s in sequences[:50]:
            longer = np.array([*s, width - 1])
            assert trie.walk(longer, np.array([0]), np.array([len(longer)]))[-1] == of.get(tuple(longer), -1)
