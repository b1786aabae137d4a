"""PII without caps: long addresses, long runs, many spans in one text; contexts under copies."""

import random
import time

import pytest
from pyspark.sql import functions as F

from scorelens.llm import pii


@pytest.fixture(scope="module")
def finder():
    r = random.Random(1)
    return pii.Finder([" ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(9)) for _ in range(50)])


def test_whole_addresses_of_any_length(finder):
    for user, host in (("a" * 80, "mail.com"), ("bob", "a.b.c.d.e.f.g.h.com"), ("bob", "x" * 70 + ".org")):
        text = f"write to {user} (at) {host} today"
        spans = [s for s in finder.spans(text) if s[0] == "email"]
        assert [(s, e) for _, s, e, _ in spans] == [(9, 9 + len(user) + 6 + len(host))], (user, host)


def test_candidates_are_not_cut():
    many = "call 1 2 3 4 5 6 7 8 9 0 now"
    assert ("phone", 5, 24) in pii.candidates(many)
    wide = "card 4111 1111" + " " * 60 + "1111 1111 end"
    assert ("card", 5, len(wide) - 4) in pii.candidates(wide)


def test_many_spans_in_one_text_take_seconds(finder):
    text = " ".join(f"user{i}@mail{i}.com" for i in range(100_000))
    start = time.time()
    assert len(finder.spans(text)) == 100_000
    assert len(finder.spans(" ".join(f"555-123-{1000 + i % 9000}" for i in range(3000)))) > 2000
    finder.spans("at-" * 300_000)
    assert time.time() - start < 60


def test_intervals():
    r = random.Random(2)
    spans = [(s, s + r.randrange(1, 6)) for s in (r.randrange(200) for _ in range(30))]
    found = pii.Intervals(spans)
    for s in range(0, 210):
        for e in (s + 1, s + 4):
            assert found.meets(s, e) == any(a < e and s < b for a, b in spans) == bool(found.within(s, e))


def test_copies_do_not_fill_the_contexts(spark, make_docs, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "Finder", lambda contexts: seen.append(contexts))
    docs = [(i, "the same text " * 10) for i in range(2000)] + [(3000 + i, f"{i} " + "another text of words " * 5) for i in range(50)]
    pii.fit_finder(make_docs(docs), most_contexts=40)
    assert len(seen[0]) == 40
    pii.fit_finder(make_docs(docs).where(F.lit(False)))
    assert seen[1] == []
