"""Ranked lexical search: against plain scoring, sharing among queries, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scorelens.llm.lexical_search import Accumulators, rank_documents, share_terms, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, k):
    held = [(i, words(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for doc, w in held:
            m = 75 + (25 * len(w) * n_docs) // max(n_terms, 1)
            tf = Counter(w)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in words(text) if tf[t])
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def make(spark, docs, items):
    clash = {c: F.lit("mine") for c in ("rank", "score", "query", "term", "n_terms")}
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash), spark.createDataFrame(items, "item_id long, text string").withColumns(clash)


def test_terms():
    for text in ("Ab-c1_2 É·x\x00y", "", "ÀÉ İ ß 日本語 it's", "[a]{b}~\x7f`c`"):
        assert [t.decode() for t in terms(text)] == words(text)
    assert terms(None) == []


def test_against_plain(spark):
    r = random.Random(3)
    vocabulary = ["the", "of", "été", "日本", *(f"w{i}" for i in range(60))]
    text = lambda n: " ".join(r.choices(vocabulary, k=n, weights=[9, 7, 3, 3, *[1] * 60]))
    docs = [(i, text(r.choice([0, 1, 5, 30, 200]))) for i in range(300)] + [(400 + i, "the same copy of w1 w2") for i in range(60)]
    items = [(i, text(12)) for i in range(25)] + [(90, text(12) + " w1 w2 w1"), (91, "the same copy of w1 w2"), (92, "nowhere")]
    a, b = make(spark, docs, items)
    expected = plain(docs, items, 20)
    for per_block in (50_000, 40):
        found = sorted((tuple(x) for x in rank_documents(a.repartition(5), b, k=20, terms_per_block=per_block).collect()), key=str)
        assert found == expected


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \t"), (None, "alpha beta"), (4, "alpha beta"), (5, "alpha beta"), (5, "alpha beta"), (6, "alpha " * 50_000), (None, None)]
    items = [(1, "alpha"), (None, "beta"), (2, None), (3, ""), (4, "alpha alpha gamma")]
    a, b = make(spark, docs, items)
    found = sorted((tuple(x) for x in rank_documents(a, b, k=3).collect()), key=str)
    assert found == plain(docs, items, 3)
    assert [x[2] for x in sorted(found, key=lambda x: x[1]) if x[0] is None] == [None, 4, 5]
    assert rank_documents(a.limit(0), b).count() == 0 and rank_documents(a, b.limit(0)).count() == 0


def test_shared_sets_are_computed_once():
    r = random.Random(9)
    common = [Counter(r.sample(range(40), 8)) for _ in range(6)]
    items = [sum((c for c in r.sample(common, 2)), Counter({50 + i: 2})) for i in range(30)] + [Counter(), Counter({1: 1})]
    for most in (2000, 0):
        plan = share_terms(items, most)
        weights = np.arange(100) % 17 + 1
        tf, m = np.random.default_rng(1).integers(0, 4, (100, 7)), np.arange(75, 82)
        got = Accumulators(plan, weights).scores(tf, m)
        share = (10**9 * tf) // np.maximum(1000 * tf + 12 * m, 1)
        want = np.stack([sum((n * weights[t] * share[t] for t, n in item.items()), np.zeros(7, np.int64)) for item in items])
        assert (got == want).all()
        alone = sum(len(i) - 1 for i in items if i)
        assert plan.additions() < (0.5 if most else 0.95) * alone
