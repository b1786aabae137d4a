"""Operator 13: licence notices by an Aho-Corasick automaton, licence expressions by a shunting yard.

1. A text becomes its words (A-Z lower-cased), joined by single blanks.  One automaton finds all
   phrases in one pass over that string; the places of a hit are counted in words.
2. A second automaton finds identifier tags ("SPDX-License-Identifier:" and the like) in the
   lower-cased text.  What follows a tag on its line is read as a licence expression: the shunting
   yard puts ids, ``and``, ``or``, ``with`` and brackets into postfix order, and a stack evaluates it
   to its labels and its obligation.
Both automata are small and fixed; each text is scanned whole, in its own task, with no shuffle.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm.common import free_name, replace_columns

# Fixed values of the task: phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Further notices; longer ones say more than the base phrase inside them.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "apache license version 2 0": "apache-2.0",
    "apache software license": "apache",
    "apache 2 0 license": "apache-2.0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "bsd license": "bsd",
    "2 clause bsd license": "bsd-2-clause",
    "3 clause bsd license": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "boost software license": "bsl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}

TAGS = ["spdx-license-identifier:", "license-expression:", "license_expression:", '"license":', "license:", "licence:"]

#: Families of identifiers: an id is of the longest family it equals or continues with - or a digit.
#: The number is the obligation: 0 permissive, 1 weak copyleft, 2 strong copyleft, 3 restricted use or network copyleft.
FAMILIES = {
    "mit": 0, "apache": 0, "bsd": 0, "isc": 0, "zlib": 0, "unlicense": 0, "cc0": 0, "0bsd": 0, "bsl": 0, "python": 0, "psf": 0, "postgresql": 0, "cc-by": 0,
    "lgpl": 1, "mpl": 1, "epl": 1, "cddl": 1, "artistic": 1,
    "gpl": 2, "gfdl": 2, "eupl": 2, "osl": 2, "cc-by-sa": 2,
    "agpl": 3, "cc-by-nc": 3, "cc-by-nd": 3, "cc-by-nc-sa": 3, "cc-by-nc-nd": 3, "sspl": 3,
}
#: How sure one kind of evidence is.
WEIGHTS = {"tag": 0.95, "phrase": 0.8, "notice": 0.7}

_RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[\x20\x09\"',]*([()]|[a-z0-9][a-z0-9.+_-]*)")
#: Bytes outside words become blanks; A-Z are lower-cased before.
_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def family(identifier: str) -> str | None:
    """Family of a lower-cased identifier (gpl-3.0-or-later: gpl), None if it is of none."""
    found = [f for f in FAMILIES if identifier == f or identifier.startswith(f + "-") or (identifier.startswith(f) and identifier[len(f) :][0].isdigit())]
    return max(found, key=len) if found else None


def postfix(tokens) -> list[tuple[str, str]]:
    """Shunting yard: (kind, token) in postfix order, kind ``id`` or ``op``.

    Reads as far as the tokens make an expression.  A last operator without a right side and
    brackets that are not closed are left out; a closing bracket without its opening one ends it."""
    out: list[tuple[str, str]] = []
    waiting: list[str] = []
    operand_next = True
    for token in tokens:
        if operand_next:
            if token == "(":
                waiting.append(token)
                continue
            if token == ")" or token in _RANK:
                break
            out.append(("id", token))
            operand_next = False
        elif token == ")":
            if "(" not in waiting:
                break
            while (top := waiting.pop()) != "(":
                out.append(("op", top))
        elif token in _RANK:
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[token]:
                out.append(("op", waiting.pop()))
            waiting.append(token)
            operand_next = True
        else:
            break
    if operand_next:
        while waiting and waiting[-1] == "(":
            waiting.pop()
        if waiting:
            waiting.pop()
    out += [("op", token) for token in reversed(waiting) if token != "("]
    return out


def evaluate(steps: list[tuple[str, str]]) -> tuple[frozenset, int | None, str]:
    """(labels, obligation, the expression with all brackets) of a postfix expression.

    ``or`` leaves the choice, so the lesser obligation holds; ``and`` asks for both, so the greater;
    ``with`` names an exception, which lowers the obligation of a copyleft licence by one.  An id
    of no family has no label and obligation None, which never lowers another."""
    stack: list[tuple[frozenset, int | None, str]] = []
    for kind, token in steps:
        if kind == "id":
            of = family(token)
            labels = frozenset({of, token.rstrip("+")}) if of else frozenset()
            stack.append((labels, FAMILIES.get(of), token))
            continue
        right, left = stack.pop(), stack.pop()
        known = [x for x in (left[1], right[1]) if x is not None]
        if token == "with":
            lowered = left[1] - 1 if left[1] in (1, 2, 3) else left[1]
            stack.append((left[0], lowered, f"{left[2]} with {right[2]}"))
        else:
            chosen = (min if token == "or" else max)(known) if known else None
            stack.append((left[0] | right[0], chosen, f"({left[2]} {token} {right[2]})"))
    return stack[-1] if stack else (frozenset(), None, "")


def _tokens(line: str):
    at = 0
    while found := _TOKEN.match(line, at):
        yield found[1]
        at = found.end()


def _automaton(words) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word, value in words:
        made.add_word(word, value)
    made.make_automaton()
    return made


class Scanner:
    """Both automata; ``scan`` gives the findings of one text."""

    def __init__(self):
        phrases = [(p, "phrase", label) for p, label in BASE_PHRASES.items()] + [(p, "notice", label) for p, label in NOTICES.items()]
        self.phrases = _automaton((f" {p} ", (len(p) + 2, kind, label)) for p, kind, label in phrases)
        self.tags = _automaton((tag, tag) for tag in TAGS)

    def scan(self, text: str | None) -> dict:
        raw = (text or "").encode().lower()
        words = raw.translate(_WORD_BYTES).split()
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
        hits = sorted((end + 1 - n, kind, label) for end, (n, kind, label) in self.phrases.iter(joined))
        findings, word, at = [], 0, 0
        for start, kind, label in hits:
            word, at = word + joined.count(" ", at, start), start
            findings.append({"kind": kind, "labels": [label], "first_word": word, "expression": None, "obligation": FAMILIES.get(family(label))})
        places = [f["first_word"] for f in findings if f["kind"] == "phrase"]
        findings += self._tagged(raw)
        base = sorted({f["labels"][0] for f in findings if f["kind"] == "phrase"})
        doubt = 1.0
        for kind, _ in sorted({(f["kind"], label) for f in findings for label in f["labels"]}):
            doubt *= 1 - WEIGHTS[kind]
        return {
            "n_words": len(words), "n_base": len(places), "first_word": places[0] if places else None, "last_word": places[-1] if places else None,
            "base_labels": base, "labels": sorted({label for f in findings for label in f["labels"]}), "score": 1 - doubt, "findings": findings,
        }

    def _tagged(self, raw: bytes) -> list[dict]:
        if b"licen" not in raw:
            return []
        lowered, out, read = raw.decode(), [], -1
        for end, _ in self.tags.iter(lowered):
            if end == read:  # "license:" also ends longer tags
                continue
            read = end
            stop = lowered.find("\n", end)
            labels, obligation, written = evaluate(postfix(_tokens(lowered[end + 1 : stop if stop >= 0 else len(lowered)])))
            if labels:
                out.append({"kind": "tag", "labels": sorted(labels), "first_word": None, "expression": written, "obligation": obligation})
        return out


FINDING = "array<struct<kind:string,labels:array<string>,first_word:bigint,expression:string,obligation:int>>"
ADDED = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "array<string>", "labels": "array<string>", "score": "double", "findings": FINDING}


def scan_licences(docs: DataFrame, text_col: str = "text", output: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` with the licences found in the whole text.

    Added: n_words; n_base, first_word, last_word (places of base phrases, from word 0; null without
    any); base_labels and labels (sorted); score (0 without a finding, else 1 minus the product of
    the doubts of each different kind and label); findings with kind (phrase, notice, tag), labels, first_word of
    phrases and notices, and of tags the expression with all brackets and its obligation (0 permissive to
    3 restricted; null if unknown).
    ``output`` names the input columns to carry (all by default; those named like an added one are
    replaced).  Null text counts as empty: no words, no findings.  Rows are independent, so ties,
    repeated rows and null ids need no rule; an empty table gives an empty table.
    """
    keep = replace_columns(docs.select(output or docs.columns), list(ADDED))
    text = free_name(docs, "licence_text")
    added = T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in ADDED.items()))
    schema = T.StructType([*docs.select(keep).schema.fields, *added.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        scanner = Scanner()
        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column(text).to_pylist()]
            columns = [pa.array([x[c] for x in found], kind) for c, kind in zip(ADDED, kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *ADDED])

    return docs.select(*keep, F.col(text_col).alias(text)).mapInArrow(run, schema)
