"""Licence scan: phrases against plain search, expressions by hand, odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scorelens.llm.licence_scan import BASE_PHRASES, Scanner, evaluate, postfix, scan_licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    places = sorted((i, label) for phrase, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, sorted({x for _, x in places})


def read(expression):
    tokens = re.findall(r"[()]|[^\s()]+", expression)
    labels, obligation, written = evaluate(postfix(tokens))
    return sorted(labels), obligation, written


def test_phrases_against_plain_search():
    r, scanner = random.Random(2), Scanner()
    pieces = ["gnu", "general", "public", "license", "apache", "MIT", "License", "cc", "CC-BY", "by", "été", "x", "cc_by", "GNU General Public License", "日本"]
    for _ in range(400):
        text = "".join(r.choice(pieces) + r.choice([" ", "  ", "\n", ", ", "-", "", "·"]) for _ in range(r.randrange(60)))
        found = scanner.scan(text)
        assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"], found["base_labels"]) == plain(text), text
        assert set(found["base_labels"]) <= set(found["labels"]) and 0 <= found["score"] <= 1 and (found["score"] > 0) == bool(found["labels"])


@pytest.mark.parametrize("text,written,obligation", [
    ("mit", "mit", 0),
    ("mit or apache-2.0 and gpl-2.0", "(mit or (apache-2.0 and gpl-2.0))", 0),
    ("( mit or apache-2.0 ) and gpl-2.0", "((mit or apache-2.0) and gpl-2.0)", 2),
    ("gpl-2.0 with classpath-exception-2.0 or agpl-3.0", "(gpl-2.0 with classpath-exception-2.0 or agpl-3.0)", 1),
    ("mit and bsd-3-clause and isc", "((mit and bsd-3-clause) and isc)", 0),
    ("mit or", "mit", 0),
    ("( mit or ( gpl-3.0+ and", "(mit or gpl-3.0+)", 0),
    ("mit ) or gpl-3.0", "mit", 0),
    ("acme-1 and lgpl-2.1", "(acme-1 and lgpl-2.1)", 1),
    ("and mit", "", None),
    ("", "", None),
])
def test_expressions(text, written, obligation):
    assert read(text)[1:] == (obligation, written)


def test_tags_and_notices():
    scan = Scanner().scan
    found = scan("// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Linux-syscall-note) */\nint x;")
    assert found["labels"] == ["gpl", "gpl-2.0-only", "mit"] and found["n_base"] == 0 and found["findings"][0]["obligation"] == 0
    assert scan('{"license": "Apache-2.0", "x": 1}')["labels"] == ["apache", "apache-2.0"]
    assert scan("Licence: see the file")["labels"] == [] and scan("license:")["labels"] == []
    assert scan("under the GNU General Public License, version 3.")["labels"] == ["gpl", "gpl-3.0"]
    assert scan("Licensed under CC BY-NC 4.0.")["labels"] == ["cc-by", "cc-by-nc"]
    assert scan("Permission is hereby granted,\n free of charge, to any person obtaining a copy")["labels"] == ["mit"]
    assert scan("the general public has an MIT student with a license")["score"] == 0
    deep = scan("SPDX-License-Identifier: " + "(" * 50_000 + "mit" + " or gpl-2.0)" * 50_000)
    assert deep["labels"] == ["gpl", "gpl-2.0", "mit"] and deep["findings"][0]["obligation"] == 0


def test_odd_rows(odd_docs, no_docs):
    out = scan_licences(odd_docs).collect()
    assert len(out) == 10 and all(r["n_words"] == 0 and r["first_word"] is None and r["labels"] == [] for r in out if r["doc_id"] in (1, 2, 3, 8))
    assert {r["n_words"] for r in out if r["doc_id"] == 4} == {60_000} and out[0]["__note"] == "mine" and out[0]["score"] == 0.0
    assert scan_licences(no_docs).count() == 0
    clash = odd_docs.withColumns({c: F.lit(1) for c in ("licence_text", "n_base", "findings")})
    assert scan_licences(clash).count() == 10 and scan_licences(clash, output=["licence_text", "doc_id"]).columns[:2] == ["licence_text", "doc_id"]
