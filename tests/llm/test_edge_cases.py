"""Every operator on odd rows and on an empty table."""

import public_tokenizers
from pyspark.sql import functions as F

from scorelens.llm import language_id, quality_classifier
from scorelens.llm.line_dedup import dedup_lines
from scorelens.llm.multiset_hash import fingerprint_edits
from scorelens.llm.near_dedup import near_components, near_dedup
from scorelens.llm.packing import pack
from scorelens.llm.passage_dedup import repeated_passages
from scorelens.llm.piece_sampling import decode, sample_encode
from scorelens.llm.pii import Finder, find_pii, redact
from scorelens.llm.quality_rules import quality_rules

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_line_dedup(odd_docs, no_docs):
    out = dedup_lines(odd_docs).collect()
    assert len(out) == 10 and {r["n_lines"] for r in out if r["doc_id"] == 3} == {2}
    assert all(r["text"] == "" and r["n_dropped"] == 0 for r in out if r["doc_id"] in (1, 2))
    assert out[0]["kept"] == "mine" and not isinstance(out[0]["n_lines"], str)  # a clashing column is replaced
    assert dedup_lines(no_docs).count() == 0


def test_fingerprints(odd_docs, no_docs):
    rows = fingerprint_edits(odd_docs).collect()
    assert len(rows) == 10
    empty = {r["fingerprint"] for r in rows if r["n_chars"] == 0}
    assert len(empty) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprint_edits(no_docs).count() == 0


def test_pieces(odd_docs, no_docs):
    out = decode(sample_encode(odd_docs, PIECES), PIECES)
    assert out.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0 and out.count() == 10
    assert {tuple(r["ids"]) for r in out.where("doc_id = 5").collect()}.__len__() == 1
    assert decode(sample_encode(no_docs, PIECES), PIECES).count() == 0


def test_quality_classifier(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, 1, 0), (6, 0, 0), (7, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    for docs, n in ((odd_docs, 10), (no_docs, 0)):
        out = quality_classifier.score_quality(docs, quality_classifier.fit(docs, labels)).collect()
        assert len(out) == n and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    none = quality_classifier.fit(odd_docs, labels.limit(0))
    assert quality_classifier.score_quality(odd_docs, none).count() == 10


def test_passages(odd_docs, no_docs):
    out = {r["doc_id"]: r for r in repeated_passages(odd_docs).collect()}
    assert len(out) == 9 and out[1]["n_units"] == 0 and out[5]["n_removed"] == 0 and out[5]["class_id"] == 5
    assert repeated_passages(no_docs).count() == 0


def test_packing(odd_docs, no_docs):
    out = pack(odd_docs, BPE).collect()
    assert sum(r["doc_tokens"] for r in out if r["doc_id"] in (1, 2, 8)) == 3  # the end id alone
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)
    assert pack(no_docs, BPE).count() == 0


def test_near_dedup(odd_docs, no_docs):
    out = near_components(odd_docs, shingle=3, percent=85).collect()
    assert len(out) == 10 and {r["component_id"] for r in out if r["id"] == 5} == {5}
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["id"] for r in out if r["id"] in (1, 2, 3, 8))
    assert near_dedup(odd_docs).count() == 10 and near_dedup(no_docs).count() == 0


def test_ids_come_back_as_they_were(odd_docs):
    clash = odd_docs.withColumns({c: F.lit("mine") for c in ("__id", "__h", "near_id", "near_hash", "language_text", "__language_text")})
    for docs in (odd_docs, clash):
        out = near_components(docs, shingle=3, percent=85).collect()
        assert sum(r["id"] is None for r in out) == 1
        assert near_dedup(docs).where("doc_id is null").count() == 1
    found = language_id.identify(clash, language_id.fit(clash))
    assert found.count() == 10 and "__language_text" in found.columns


def test_own_column_names_do_not_clash(spark, odd_docs):
    own = ["__id", "__block", "__text", "__lines", "__words", "__n", "__hash", "__quality_text", "__piece_id", "__piece_text", "__piece_ids", "__h"]
    clash = odd_docs.withColumns({c: F.lit("mine") for c in own})
    none = quality_classifier.fit(odd_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    encoded = sample_encode(clash, PIECES)
    for out in (dedup_lines(clash), quality_rules(clash), quality_classifier.score_quality(clash, none), encoded, decode(encoded, PIECES)):
        rows = out.collect()
        assert len(rows) == 10 and all(rows[0][c] == "mine" for c in own)
    renamed = odd_docs.withColumnsRenamed({"text": "__text", "doc_id": "__id"})
    out = dedup_lines(renamed, id_col="__id", text_col="__text")
    assert {"__id", "__text"} <= set(out.columns) and out.count() == 10
    assert quality_rules(renamed, text_col="__text", output=["__id"]).columns[0] == "__id"


def test_only_letters_have_a_language(make_docs):
    docs = make_docs([(1, "\u00b2 \u00bd \u2167", "es"), (2, "uno dos", "es"), (3, "_ 12", "es")])
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, language_id.fit(docs, max_rows=5)).collect()}
    assert out[1] == out[3] == "und"


def test_pii(odd_docs, no_docs):
    finder = Finder(["and the of it"], examples=1500)
    out = {r["doc_id"]: [s["kind"] for s in r["pii_spans"]] for r in find_pii(odd_docs, finder).collect()}
    assert out[1] == [] and out[7] == ["email", "phone"]
    texts = {r["doc_id"]: r["text"] for r in redact(odd_docs, finder).collect()}
    assert texts[1] is None and texts[7].endswith("a [EMAIL] [PHONE]".replace("a ", ""))
    assert find_pii(no_docs, finder).count() == 0


def test_quality_rules(odd_docs, no_docs):
    out = {r["doc_id"]: r for r in quality_rules(odd_docs).collect()}
    assert out[1]["base_failed"] and out[1]["kept"] is False and out[3]["n_words"] == 0
    assert out[4]["n_words"] == 60_000 and out[5]["n_words"] == 6 and out[7]["n_words"] == 8
    assert quality_rules(no_docs).count() == 0


def test_language(odd_docs, no_docs):
    for docs, n in ((odd_docs, 10), (no_docs, 0)):
        out = language_id.identify(docs, language_id.fit(docs)).collect()
        assert len(out) == n
        assert all(r["lang_pred"] == "und" for r in out if not r["text"] or not r["text"].strip())
