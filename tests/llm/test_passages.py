"""Passage dedup: which keys repeat, against a plain count; recall of the bands against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scorelens.llm import passage_dedup as P

SF = "/root/testdata/sf0.01/documents.parquet"


def _rows(texts, bands=3, min_words=25):
    make, _ = P._key_rows(bands, min_words)
    batch = lambda part: pa.record_batch([pa.array([i for i, _ in part], pa.int64()), pa.array([t for _, t in part])], names=["id", "text"])
    return pa.Table.from_batches([b for s in range(0, len(texts), 7) for b in make([batch(texts[s : s + 7])])])


def test_rows_that_pass_are_those_with_a_second_document():
    r = random.Random(4)
    sentences = [" ".join(f"w{r.randrange(500)}" for _ in range(r.randrange(6, 30))) + "." for _ in range(40)]
    texts = [(r.randrange(60), " ".join(r.choices(sentences, k=r.randrange(6)))) for _ in range(100)] + [(90, sentences[0]), (91, None), (-(2**63), sentences[1])]
    rows = _rows(texts).to_pandas()
    ids = defaultdict(set)
    own = rows[rows["kind"].isin([P.OPEN, P.KNOWN])]
    for k, i in zip(own["key"], own["id"]):
        ids[k].add(i)
    want = sorted((x.key, x.id, x.idx, x.start, x.cls) for x in own.itertuples() if len(ids[x.key]) > 1)
    for step in (1, 3, 1000):
        got = []
        for home in range(3):
            part = rows[rows["home"] % 3 == home].sort_values(["key", "kind", "id"], kind="stable")
            table = pa.Table.from_pandas(part, preserve_index=False)
            for out in P._repeated(b for s in range(0, len(part), step) for b in table.slice(s, step).combine_chunks().to_batches()):
                got += [(x["key"], x["id"], x["idx"], x["start"], x["cls"]) for x in out.to_pylist() if x["kind"] != P.COUNT]
        assert sorted(got) == want


def test_bands_find_similar_units_of_the_test_corpus(spark):
    units, sets, keys = P.Units(), {}, {}
    for (text,) in spark.read.parquet(SF).select("text").collect():
        first, end, shingles = units(text)
        cls, k = P.unit_keys(first, end, shingles, 3)
        for c, row, a, b in zip(cls.tolist(), k.tolist(), first, end):
            if c not in sets:
                sets[c], keys[c] = frozenset(shingles[a : b - P.SHINGLE + 1].tolist()), set(row)
    holders = defaultdict(list)
    for c, s in sets.items():
        for x in s:
            holders[x].append(c)
    common = defaultdict(int)
    for of in holders.values():
        for i, a in enumerate(of):
            for b in of[i + 1 :]:
                common[a, b] += 1
    alike = [(a, b) for (a, b), n in common.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    found = sum(bool(keys[a] & keys[b]) for a, b in alike)
    assert len(alike) > 40 and found >= 0.98 * len(alike), (found, len(alike))


def test_copies_lose_all_but_the_smallest(spark, make_docs):
    r = random.Random(1)
    text = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) + ("." if i % 11 == 10 else "") for i in range(n))
    passage = text(60)
    docs = [(i, f"{text(40)} {passage} {text(40)}") for i in range(6)] + [(10 + i, passage) for i in range(20)] + [(None, text(30)), (50, None)]
    out = {x["doc_id"]: x for x in P.repeated_passages(make_docs(docs).repartition(4)).collect()}
    assert len(out) == len(docs) and None in out and out[0]["n_removed"] == 0 and out[50]["n_units"] == 0
    assert all(out[i]["words_removed"] >= 25 and out[i]["class_id"] == 0 for i in [*range(1, 6), *range(10, 30)])
    assert np.all([x["words_removed"] <= 120 for x in out.values()])
    assert P.repeated_passages(make_docs(docs).where(F.lit(False))).count() == 0


def test_texts_are_hashed_together(monkeypatch):
    r = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(w + ("." if r.random() < 0.1 else "") for w in r.choice(words, n)) for n in (0, 3, 24, 25, 26, 48, 49, 50, 200, 400) * 6]
    texts += ["", None, "a b c d e " * 40, "x\ny\nz"]
    make, _ = P._key_rows(3, 25)
    rows = lambda some: sorted(x for b in make(some) for x in zip(*(c.to_pylist() for c in b.columns)) if x[1] != P.MARK)
    batch = lambda i, t: pa.record_batch([pa.array(i, pa.int64()), pa.array(t, pa.string())], names=["__id", "__text"])
    alone = rows([batch([i], [t]) for i, t in enumerate(texts)])
    calls, plain = [], P.blocks
    monkeypatch.setattr(P, "blocks", lambda *a: calls.append(1) or plain(*a))
    together = rows([batch(list(range(len(texts))), texts)])
    unlike = lambda found: sorted((x[0], *x[2:8]) for x in found)  # noqa: E731  (a key's kind and home depend on its batch)
    assert unlike(together) == unlike(alone) and len(calls) == 1


def _bucket_of_chance(n, seed=5):
    """Sets of a bucket that share one shingle only, and a copy with one shingle less of every tenth."""
    r = np.random.default_rng(seed)
    sets = [np.unique(np.append(r.integers(0, 2**64, 4 + i % 20, dtype=np.uint64), np.uint64(77))) for i in range(n)]
    return sets + [np.delete(s, np.flatnonzero(s != 77)[0]) for s in sets[::10]]


def _alike(sets, percent=80):
    jaccard = lambda a, b: 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
    return {(j, i) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j])}


def _sketches(sets):
    return np.array([np.bitwise_or.reduce(P.bits(s)) for s in sets], np.uint64).view(np.int64)


def test_sets_that_share_a_shingle_by_chance_are_not_compared(monkeypatch):
    sets, compared, plain = _bucket_of_chance(300), [], P.similar
    monkeypatch.setattr(P, "similar", lambda one, flat, starts, sizes, rows, percent: compared.append(len(rows)) or plain(one, flat, starts, sizes, rows, percent))
    n = len(sets)
    t = pa.table({"key": pa.array([9] * n, pa.int64()), "cls": pa.array(range(n), pa.int64()), "set": [s.tobytes() for s in sets]})
    out = P._verify(80)(t)
    want = _alike(sets)
    assert len(want) > 15 and {(b, a) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())} == want
    assert sum(compared) <= 5 * n, sum(compared)  # all pairs are 54,285


def test_classes_with_partners_are_all_that_may_be_similar():
    sets = _bucket_of_chance(200) + [np.array([77, i], np.uint64) for i in range(3)]
    r, n = np.random.default_rng(6), len(sets)
    sub = np.where(np.arange(n) < 120, 5, r.integers(10, 60, n))  # a large bucket and small ones
    sketch, words = _sketches(sets), np.array([len(s) + P.SHINGLE - 1 + (i % 7 == 0) for i, s in enumerate(sets)], np.int32)
    order = r.permutation(n)
    t = pa.table({"sub": sub[order], "key": sub[order] + 1000, "cls": order, "id": order + 5, "words": words[order], "sketch": sketch[order]})
    got = P._with_partners(80)(t)
    near = lambda i, j: 180 * (int(sketch[i]) % 2**64 ^ int(sketch[j]) % 2**64).bit_count() <= 20 * int(words[i] + words[j] - 2 * P.SHINGLE + 2)
    want = {i for i in range(n) for j in range(n) if i != j and sub[i] == sub[j] and near(i, j)}
    assert sorted(got["cls"].to_pylist()) == sorted(want) and got["id"].to_pylist() == [c + 5 for c in got["cls"].to_pylist()]
    assert got["key"].to_pylist() == [int(sub[c]) + 1000 for c in got["cls"].to_pylist()]
    assert {i for pair in _alike(sets) if sub[pair[0]] == sub[pair[1]] for i in pair} <= want and len(want) < n // 2
    assert P._with_partners(80)(t.slice(0, 0)).num_rows == 0


def test_sketches_lose_no_similar_pair():
    r = np.random.default_rng(7)
    for percent in (50, 80, 95):
        for _ in range(400):
            both, a, b = (r.integers(0, 2**64, k, dtype=np.uint64) for k in r.integers([4, 0, 0], [120, 8, 8]))
            one, other = np.append(both, a), np.append(both, b)
            if 100 * len(both) >= percent * (len(both) + len(a) + len(b)):
                sketch = _sketches([one, other]).view(np.uint64)
                assert P.may_be_similar(sketch[0], sketch[1:], np.array([len(one) + len(other)]), percent).all()


def test_unit_sketches_and_sent_rows(spark, monkeypatch):
    units = P.Units()
    first, end, shingles = units("a b c d e f g. h i j k l m n o p q r. a b c d e f g.\nshort\na a a a a a a a")
    want = [np.bitwise_or.reduce(P.bits(shingles[a : b - P.SHINGLE + 1])) for a, b in zip(first, end)]
    assert len(want) == 4 and P.unit_sketches(first, end, shingles).view(np.uint64).tolist() == [int(x) for x in want]
    r = random.Random(8)
    texts = [(i % 40 - 5, " ".join(f"w{r.randrange(30)}" + "." * (r.random() < 0.2) for _ in range(r.randrange(0, 90))) + r.choice(["", "\nx y", "\n" * 3])) for i in range(70)] + [(-(2**63), "a b c d e f. " * 9), (99, None)]
    key = lambda t: sorted(zip(*(t[c].to_pylist() for c in [*P._ROW, "home"])))
    whole = _rows(texts)
    monkeypatch.setattr(P, "SENT", 7)
    assert key(_rows(texts)) == key(whole)
    out = P._by_key(spark.createDataFrame(whole.to_pandas(), ", ".join(f"{n} {t}" for n, t in P._ROW.items()) + ", home long")).toArrow()
    columns = [c for c in P._ROW]
    assert out.column_names == columns and sorted(zip(*(out[c].to_pylist() for c in columns))) == sorted(zip(*(whole[c].to_pylist() for c in columns)))
