"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet to the shared scratch folder and read back as the next one's docs.
Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers

from scorelens.llm.common import stored, table
from scorelens.llm.line_dedup import dedup_lines
from scorelens.llm.near_dedup import near_dedup
from scorelens.llm.packing import pack
from scorelens.llm.pii import redact
from scorelens.llm.quality_rules import quality_rules


def rules(spark, docs, sf_dir):
    """Documents that the quality rules keep; the language references count each different text once."""
    return quality_rules(docs, each_text_once=True).where("kept").select(docs.columns)


def lines(spark, docs, sf_dir):
    """Texts without the lines that five documents or more share (the largest doc_id keeps them)."""
    return dedup_lines(docs).select(docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document (the smallest doc_id) of each group linked by five-word shingles at 0.8 or more."""
    return near_dedup(docs)


def personal_data(spark, docs, sf_dir):
    """Texts with their personal data replaced by its kind in brackets."""
    return redact(docs)


def packing(spark, docs, sf_dir):
    """Pieces of the documents' ids, packed into sequences of at most 2048."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", packing),
]
#: SQL can't express near-duplicate search, the PII model and byte-pair ids together; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
