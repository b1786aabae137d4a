"""Registered queries of the operators: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from scorelens.llm import language_id, quality_classifier
from scorelens.llm.common import LEAST_LONG, held_out, table
from scorelens.llm.conversation_trie import conversation_trie
from scorelens.llm.lexical_search import rank_documents
from scorelens.llm.licence_scan import scan_licences
from scorelens.llm.line_dedup import dedup_lines
from scorelens.llm.multiset_hash import fingerprint_edits
from scorelens.llm.near_dedup import near_components
from scorelens.llm.packing import pack
from scorelens.llm.passage_dedup import repeated_passages
from scorelens.llm.piece_sampling import decode, sample_encode
from scorelens.llm.pii import KINDS, find_pii
from scorelens.llm.quality_rules import quality_rules
from scorelens.llm.sql import CONVERSATION_TRIE_SQL, LEXICAL_SEARCH_SQL, LINE_DEDUP_SQL, NEAR_DEDUP_SQL, quality_rules_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return deco


@register("op1_line_dedup", LINE_DEDUP_SQL)
def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@register("op9_quality_rules", quality_rules_sql())
def op9_quality_rules(spark, sf_dir):
    out = quality_rules(table(spark, sf_dir, "documents"), output=["doc_id"])
    return out.drop("char_distance", "word_distance")


@register("op7_minhash_near_dedup", NEAR_DEDUP_SQL)
def op7_minhash_near_dedup(spark, sf_dir):
    out = near_components(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    kept = F.coalesce("id", F.lit(LEAST_LONG)) == F.col("component_id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


@register("op2_multiset_fingerprints")
def op2_multiset_fingerprints(spark, sf_dir):
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@register("op6_cutting_stock_packing")
def op6_cutting_stock_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op8_pii_spans")
def op8_pii_spans(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"), output=["doc_id"])
    rules = F.filter("pii_spans", lambda s: s["base"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *(_of_kind(rules, kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(written(rules), 256).alias("base_sha256"), written("pii_spans").alias("spans"),
    )


def _of_kind(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@register("op4_quality_classifier")
def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score_quality(docs, model, output=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@register("op10_language_id")
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs), output=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@register("op5_passage_dedup")
def op5_passage_dedup(spark, sf_dir):
    out = repeated_passages(table(spark, sf_dir, "documents"))
    listed = [F.array_join(c, ",").alias(c) for c in ("kept_in", "removed", "ranges")]
    return out.select("doc_id", "n_units", "n_repeated", "n_removed", "words_removed", "class_id", *listed)


@register("op3_piece_sampling")
def op3_piece_sampling(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sample_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    decoded = decode(encoded, model)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


@register("op11_conversation_trie", CONVERSATION_TRIE_SQL)
def op11_conversation_trie(spark, sf_dir):
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 6
    return conversation_trie(table(spark, sf_dir, "conversations"), shared=5, base=conv - conv % 100, head=head)


@register("op12_lexical_search", LEXICAL_SEARCH_SQL)
def op12_lexical_search(spark, sf_dir):
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


@register("op13_license_scan")
def op13_license_scan(spark, sf_dir):
    found = scan_licences(table(spark, sf_dir, "documents"), output=["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *(F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")), "score")
