"""The stages one after another, each against what it must do to its own input."""

import collections
import random

import corpus_pipeline
from scorelens.llm.common import WordHashes
from scorelens.llm.pii import base_spans
from scorelens.llm.shingles import shingle_set

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen.append({r["doc_id"]: r for r in docs.collect()} if "sequence_id" not in docs.columns else docs.collect())
        assert "sequence_id" in docs.columns or docs.columns == columns
    rules, lines, near, pii, packed = seen
    assert 0 < len(rules) < 200 and set(lines) == set(rules) and set(near) < set(lines)

    shared = collections.Counter()
    for r in rules.values():
        shared.update({x.strip(" \t\x0b\x0c\r").encode().lower() for x in r["text"].split("\n") if len(x.strip(" \t\x0b\x0c\r")) >= 40})
    many = {k for k, n in shared.items() if n >= 5}
    left = collections.Counter(k for r in lines.values() for k in {x.strip(" \t\x0b\x0c\r").encode().lower() for x in r["text"].split("\n")} if k in many)
    assert all(n == 1 for n in left.values())

    words = WordHashes()
    sets = {i: set(shingle_set(r["text"], 5, words).tolist()) for i, r in lines.items()}
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    kept = [s for i, s in sets.items() if i in near and s]
    assert not any(alike(a, b) for x, a in enumerate(kept) for b in kept[:x])
    for i in set(lines) - set(near):  # what went is like something smaller
        assert any(j < i and alike(sets[i], sets[j]) for j in sets)

    assert set(pii) == set(near) and not any(base_spans(r["text"]) for r in pii.values())
    assert all(r["text"] == near[i]["text"] for i, r in pii.items() if not base_spans(near[i]["text"]) and "[" not in r["text"])
    assert {r["doc_id"] for r in packed} == set(pii)


def test_copies_of_a_junk_text_do_not_drop_their_language(spark):
    """A symbol-junk Spanish text copied to a third of all rows: the clean Spanish texts stay."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    words = "que el en y los la casa perro gato noche camino viento piedra libro mesa agua".split()
    clean = [(i, " ".join(rng.choice(words) for _ in range(120)) + ".") for i in range(30)]
    junk = "##%|^& " * 60 + " ".join(rng.choice(words) for _ in range(60))
    docs = spark.createDataFrame(clean + [(100 + i, junk) for i in range(600)], "doc_id long, text string")
    assert corpus_pipeline.rules(spark, docs, SF).where(F.col("doc_id") < 30).count() == 30
