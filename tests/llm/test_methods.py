"""The methods against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from scorelens.llm import cutting_stock, mphf
from scorelens.llm.chunk_ids import ChunkIds
from scorelens.llm.common import WordHashes
from scorelens.llm.components import components
from scorelens.llm.line_dedup import dedup_lines
from scorelens.llm.multiset_hash import added, fingerprint_edits, removed, with_fingerprint, with_next
from scorelens.llm.near_dedup import near_components
from scorelens.llm.passage_dedup import repeated_passages
from scorelens.llm.piece_sampling import Sampler, pieces
from scorelens.llm.pii import KINDS, Finder, base_spans, candidates, digits_of, luhn
from scorelens.llm.shingles import banding, link_group, looks, shingle_set, signature

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = "the of and to in that a thin red fox runs over under seven hills with some old stones near water".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def test_perfect_hash_is_minimal_and_rejects_others():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, (2, 5000)).astype(np.uint64)
    find = mphf.Lookup(*mphf.build(a, b))
    assert sorted(find(a, b)) == list(range(5000))
    assert find(a[:0], b[:0]).size == 0 and (find(b, a) < 5000).all()
    with pytest.raises(ValueError):
        mphf.build(a[[0, 0]], b[[0, 0]])


def test_line_dedup_by_hand(make_docs):
    long = "This line is shared by five documents or more."
    rows = [(i, f"own {i}\n {long.upper() if i % 2 else long}\t\nend {i}") for i in range(6)] + [(9, f"{long}\n{long}")] + [(10 + i, "x" * 39) for i in range(8)]
    out = {r["doc_id"]: r for r in dedup_lines(make_docs(rows), docs_per_block=2).collect()}
    assert all(out[i]["text"] == f"own {i}\nend {i}" and out[i]["n_dropped"] == 1 for i in range(6))
    assert out[9]["n_dropped"] == 0 and all(out[10 + i]["n_dropped"] == 0 for i in range(8))


def test_fingerprints_against_python(make_docs):
    rng = random.Random(3)
    texts = ["\n".join(sentence(rng, 12) + "." for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    docs = make_docs([(i * 7 % 101, t) for i, t in enumerate(texts)])
    rows = sorted(fingerprint_edits(docs).collect(), key=lambda r: -r["doc_id"])
    by_id = {i * 7 % 101: t for i, t in enumerate(texts)}
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        own, other = by_id[r["doc_id"]], by_id[nxt["doc_id"]]
        cut = len(own) // 3
        assert r["edited_sha256"] == hashlib.sha256((own[: len(own) - cut] + other[:cut]).encode()).hexdigest()
    assert np.mean([r["near_edited"] for r in rows]) > 0.4 > 0.2 > np.mean([r["near_next"] for r in rows])


def test_next_rows_over_many_ranges(spark):
    ids = random.Random(5).sample(range(1000), 60)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "__id long, t string")
    got = {r["__id"]: r["__next_t"] for r in with_next(df, ["t"], F.lit(0), per_range=7).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"t{j}" for i, j in zip(order, order[1:] + order[:1])}


def test_fingerprints_add_and_remove_paragraphs_in_any_order(spark):
    df = spark.createDataFrame([("a b. c\nd, e", "f! g", "f! g\nd, e\na b. c")], "x string, y string, z string")
    for c in "xyz":
        df = with_fingerprint(df, c, f"f{c}")
    r = df.select("fz", added(F.col("fx"), F.col("fy")).alias("sum"), removed(F.col("fz"), F.col("fy")).alias("less"), "fx").first()
    assert r["sum"] == r["fz"] and r["less"] == r["fx"]


def test_sampling_follows_the_lattice_and_decodes():
    vocabulary = pieces(PIECES)
    sample = Sampler(vocabulary, 1.0)
    texts = ["", "  ", " a", "a  b ", "foo\n bar", "▁", " ▁ x▁", "日本語 \x00 é\t\r\n 😀", "x" * 3000, "a\0▁b"]
    keys = np.arange(len(texts)).astype(np.uint64)
    out = sample(texts, keys)
    assert [b"".join(vocabulary.raw[i] for i in x).decode() for x in out] == texts
    assert all((a == sample([t], keys[i : i + 1])[0]).all() for i, (a, t) in enumerate(zip(out, texts)))

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in vocabulary.ids:
                for rest in ways(s[k:]):
                    yield (vocabulary.ids[s[:k]], *rest)

    every = {w: math.prod(1 / (1 + vocabulary.rank[i]) for i in w) for w in ways("▁thes")}
    n = 20_000
    seen = collections.Counter(tuple(x) for x in sample([" thes"] * n, np.arange(n).astype(np.uint64)))
    assert set(seen) <= set(every) and max(abs(seen[w] / n - p / sum(every.values())) for w, p in every.items()) < 0.02


def test_classifier_on_rows_not_learned_from(spark):
    from scorelens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op4_quality_classifier"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_language_on_rows_not_learned_from(spark):
    from scorelens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op10_language_id"](spark, sf).where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_language_learns_from_different_texts_when_one_is_hot(make_docs):
    from scorelens.llm import language_id

    rng = random.Random(12)
    of = {"en": WORDS, "xx": "zuk ploq vrem dastik mulyo qerr hjalp snorv tikke wabbo".split()}
    text = lambda lang: " ".join(rng.choice(of[lang]) for _ in range(30))
    hot = text("xx")
    rows = [(i, text("en"), "en") for i in range(300)] + [(1000 + i, text("xx"), "xx") for i in range(60)] + [(2000 + i, hot, "xx") for i in range(6000)]
    model = language_id.fit(make_docs(rows), max_rows=20)
    assert model.langs.count("xx") == 4 == model.langs.count("en")
    assert [p[0] for p in model.predict([text("xx") for _ in range(20)])] == ["xx"] * 20


def test_repeated_passages_inside_other_text(make_docs):
    rng = random.Random(8)
    text = lambda n: ". ".join(sentence(rng, rng.randrange(6, 11)) for _ in range(n)) + "."
    passage, near = text(8), text(1)
    rows = [(i, text(5) + " " + passage + " " + text(5)) for i in (3, 5, 8)] + [(i, text(10)) for i in range(20, 30)]
    rows += [(40, text(2)), (41, f"{near} {rows[0][1]}")]
    out = {r["doc_id"]: r for r in repeated_passages(make_docs(rows)).collect()}
    assert all(out[i]["n_repeated"] >= 6 for i in (3, 5, 8)) and out[3]["n_removed"] == 0
    assert out[5]["class_id"] == 3 and out[8]["kept_in"] == [3] and out[41]["class_id"] == 3
    assert all(out[i]["n_repeated"] == 0 and out[i]["class_id"] == i for i in [*range(20, 30), 40])


@pytest.mark.parametrize("sep", [" ", "\n"])
def test_passage_of_51_words_in_mid_sentence(make_docs, sep):
    """No sentence of it is whole in the hosts, or every line has one word."""
    rng = random.Random(21)
    passage = sep.join(sentence(rng, 51).split())
    host = lambda: f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}."
    rows = [(i, host()) for i in (3, 5, 8)] + [(20, sentence(rng, 120)), (30, "the same " * 3000)]
    out = {r["doc_id"]: r for r in repeated_passages(make_docs(rows)).collect()}
    for i in (5, 8):
        r, words = out[i], rows[(5, 8).index(i) + 1][1].split()
        taken = [w for a, b in zip(r["ranges"][::2], r["ranges"][1::2]) for w in words[a:b]]
        assert r["class_id"] == 3 and r["kept_in"] == [3] and r["words_removed"] == len(taken) >= 25
        assert " ".join(taken) in " ".join(passage.split())
    assert out[3]["n_removed"] == 0 < out[3]["n_repeated"] and all(out[i]["n_repeated"] == 0 for i in (20, 30))


def test_near_paragraphs_are_verified_by_jaccard(make_docs):
    rng = random.Random(9)
    words = sentence(rng, 60).split()
    one = " ".join(words)
    close, far = " ".join([*words[:-2], "new1", "new2"]), " ".join(w if i % 9 else "new" for i, w in enumerate(words))
    out = {r["doc_id"]: r for r in repeated_passages(make_docs([(1, one), (2, close), (3, far)])).collect()}
    assert out[2]["class_id"] == 1 and out[2]["n_removed"] == 1 and out[3]["class_id"] == 3


def test_chunk_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(BPE)
    rng = random.Random(2)
    texts = ["", " ", "a  b ", "foo.\n bar", "x\t y", "don't you'll'", "a<|endoftext|>b <|endoftext|>", "\x1c b\x85 c", "é ñ... ?!", "日本 語。", "1,234.5 a."]
    texts += ["".join(rng.choices("ab .,'\n\t é1!?  ", k=60)) for _ in range(300)]
    encode = ChunkIds(BPE, most=50)
    for _ in range(2):
        assert [list(x) for x in encode(texts)] == [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]


def test_cutting_stock_uses_every_item_once_and_wastes_little():
    rng = np.random.default_rng(4)
    sizes, demand = np.unique(rng.integers(1, 256, 3000), return_counts=True)
    plan = cutting_stock.plan(sizes, demand, 512)
    assert (sum(c * n for c, n in plan) == demand).all() and all(c @ sizes <= 512 for c, _ in plan)
    bins = sum(n for _, n in plan)
    assert bins <= 1.02 * math.ceil((sizes * demand).sum() / 512)


def test_packing_covers_all_ids(spark):
    from tokenizers import Tokenizer

    from scorelens.llm.queries import QUERIES

    sf, slow = "/root/testdata/sf0.001", Tokenizer.from_file(BPE)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_cutting_stock_packing"](spark, sf).collect()
    of, fill = collections.defaultdict(list), collections.Counter()
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        of[r["doc_id"]].append(r)
    for i, text in docs.items():
        ids, at = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in of[i]:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and sum(fill.values()) / (2048 * len(fill)) > 0.97


def brute_components(docs, size, percent):
    words, sets = WordHashes(), {}
    for i, t in docs:
        sets[i] = set(shingle_set(t, size, words).tolist())
    low = {i: i for i in sets}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                low[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("block", [4000, 6])
def test_near_dedup_of_a_large_loose_group(make_docs, monkeypatch, block):
    """Copies with edits, many pairs just beside the threshold; also with buckets and clumps dealt in blocks."""
    from scorelens.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(6)
    base = sentence(rng, 150).split()
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i * 3, " ".join(w)))
    rows += [(1000 + i, sentence(rng, 40)) for i in range(30)] + [(2000 + i, "same text in all of these rows") for i in range(20)]
    got = {r["id"]: r["component_id"] for r in near_components(make_docs(rows), shingle=3, percent=85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_bands_and_looks_keep_their_miss_probability():
    for least in (0.8, 0.85):
        bands, rows = banding(least)
        assert (1 - least**rows) ** bands <= 1e-6 and bands * rows <= 200
        start, stop, needed = looks(bands * rows, least, 1e-6)[0]
        rng = np.random.default_rng(0)
        assert (rng.binomial(stop, least, 200_000) < needed).mean() < 1e-4
    a = shingle_set("a b c d e f", 3, WordHashes())
    assert (signature(a, 64) == signature(a[::-1].copy(), 64)).all()


def test_link_group_joins_all_without_listing_pairs():
    sigs = np.zeros((500, 64), np.uint16)
    assert len(link_group(sigs, 0.8, 1e-6)) == 499
    apart = np.arange(64 * 40, dtype=np.uint16).reshape(40, 64)
    assert link_group(apart, 0.8, 1e-6) == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits_of(m)) <= 19 and luhn(digits_of(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits_of(m)) <= 15),
}


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab0123456789..--  @+()", k=60)) for _ in range(4000)]
    texts += ["a@b@c.de.fg@h.ij", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (017) 555-7713 ", "0001.2.3.4", "x" * 100_000 + "@", "1 " * 50_000, "1." * 50_000]
    for t in texts:
        plain = [(k, *m.span()) for k, (p, ok) in PLAIN.items() if len(t) < 1000 for m in re.finditer(p, t) if ok(m[0])]
        if len(t) < 1000:
            assert base_spans(t) == sorted(plain, key=lambda s: (s[1], KINDS.index(s[0])))
        else:
            base_spans(t)


def test_finder_adds_forms_that_the_rules_miss_and_leaves_plain_text_alone():
    finder = Finder(["the thin fox and the hills", "some old stones near water"])
    text = "the write to joe.fox (at) hills (dot) org or call 555-123-4567 now"
    found = [(k, text[a:b]) for k, a, b, _ in finder.spans(text)]
    assert ("email", "joe.fox (at) hills (dot) org") in found and any(k == "phone" for k, _ in found)
    for clean in ("the fox at the hills", "in 1990-2000 about 3.14159 or 12.5 of 400", "token e0199300263184ab", ""):
        assert finder.spans(clean) == [] and (clean or candidates(clean) == [])


def test_numbers_beside_numbers_are_proposed_and_found():
    card = "4111 1111 1111 1111"
    long = " ".join(str(x) for x in range(10, 60))
    for text, kind, wanted in [
        (f"card {card} 2024 now", "card", [card]), (f"the fox 12 {card} and", "card", [card]), (f"x {long} {card} {long} y", "card", [card]),
        ("call 555 123 4567 555 234 5678 now", "phone", ["555 123 4567", "555 234 5678"]), ("tel (555) 123-4567 (555) 234-5678 x", "phone", ["(555) 123-4567", "(555) 234-5678"]),
    ]:
        assert set(wanted) <= {text[a:b] for k, a, b in candidates(text) if k == kind}
    finder = Finder(["the thin fox and the hills", "some old stones near water"])
    for text, wanted in [(f"card {card} 2024 now", {card}), ("call 555 123 4567 555 234 5678 now", {"555 123 4567", "555 234 5678"}), ("tel (555) 123-4567 (555) 234-5678 x", {"(555) 123-4567", "(555) 234-5678"})]:
        assert {text[a:b] for _, a, b, _ in finder.spans(text)} == wanted
    assert len(candidates("1 " * 20_000 + "1234567 " * 2000)) < 19 * 22_000  # linear in the groups of digits


@pytest.mark.parametrize("span", ["john (AT) mail (DOT) com", "john at mail.com", "john AT mail DOT com"])
def test_written_out_addresses_are_candidates_in_any_text(span):
    for rest in ("", " and see a@b"):
        assert span in {f"x {span}{rest}"[a:b] for k, a, b in candidates(f"x {span}{rest}") if k == "email"}


def test_registered_oracles_hold(spark):
    from scorelens.llm.queries import ORACLES, QUERIES
    from scorelens.oracle_check import compare, duck

    sf = "/root/testdata/sf0.001"
    con = duck(sf)
    for name, sql in ORACLES.items():
        r = compare(spark, sf, name, QUERIES[name], sql, con)
        assert r["cols_ok"] and r["hash_ok"], r


def test_every_operator_has_its_query():
    from scorelens.llm.queries import QUERIES

    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
