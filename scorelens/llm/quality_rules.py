"""Operator 9 [native]: quality rules with distribution divergence, in SQL functions only.

Base counts (words, symbols, repeated lines and word triples) and two
histograms of each text, the shares of character classes and of common words,
are compared with language references by Jensen-Shannon distance.  The
references are means over all rows of the input, or over its different texts
(``each_text_once``), so that copies of one text do not outweigh a language.
One pass over the texts stores the counts; the references and the verdicts are
made from them.  No text is shuffled.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.llm.common import BLANKS, guarded, replace_columns, stored

#: Six frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that"],
    "de": ["der", "die", "und", "den", "von", "zu"],
    "fr": ["le", "et", "les", "des", "un", "la"],
    "es": ["que", "el", "en", "y", "los", "la"],
}
#: Character classes of the histogram: A-Z, digits, these points, other ASCII symbols, white space,
#: and all that is left (small letters and characters beyond ASCII).
POINTS = ".,;:!?'\"()-"
N_CLASSES, N_COMMON = 6, 6
#: Up to so many different repeated triples are looked up one by one.
FEW = 8
WORD_BREAK = r"[\x20\x09-\x0D]+"
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]


def _without(text: str, kind: str) -> Column:
    return F.regexp_replace(text, f"[{kind}]+", "")


def split_words(df: DataFrame, text: str) -> DataFrame:
    """Adds __words, the maximal runs without white space, and __word_chars."""
    inner = F.btrim(F.col(text), F.lit(BLANKS))
    df = df.withColumn("__words", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_BREAK)))
    return df.withColumns({"__n": F.size("__words"), "__word_chars": F.length(F.array_join("__words", ""))})


def base_counts(df: DataFrame, text: str) -> DataFrame:
    """Adds the base counts of column ``text`` (not null, split by split_words).  Every step is linear
    in the text, apart from the sort, which only texts with a repeated triple need."""
    df = df.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    triples = F.transform("__words", lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)))
    df = df.withColumn("__triples", F.slice(triples, 1, F.greatest(F.col("__n") - 2, F.lit(0))))
    repeats = F.size(F.array_distinct("__triples")) < F.size("__triples")
    df = df.withColumn("__sorted", F.when(repeats, F.sort_array("__triples")))
    df = df.withColumn("__twice", F.array_distinct(F.filter("__sorted", lambda h, i: h == F.get("__sorted", i + 1))))
    # few different triples repeat: look each position up; many: sort the positions
    few = F.filter(F.transform("__triples", lambda h, i: F.when(F.array_contains("__twice", h), i)), lambda i: i.isNotNull())
    placed = F.sort_array(F.transform("__triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__placed", F.when(F.size("__twice") > FEW, placed))
    pairs = F.zip_with("__placed", F.slice("__placed", 2, F.col("__n")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    many = F.flatten(F.filter(pairs, lambda x: x.isNotNull()))
    df = df.withColumn("__starts", F.when(F.size("__twice") > FEW, many).when(F.size("__twice") > 0, few))
    covered = F.array_distinct(F.flatten(F.transform("__starts", lambda i: F.array(i, i + 1, i + 2))))
    counts = {
        "n_words": F.col("__n"),
        "word_chars": F.col("__word_chars"),
        "n_symbols": F.length(_without(text, "^#*$%&|<>")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.when(F.col("__starts").isNull(), 0).otherwise(F.size(covered)),
    }
    return df.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("__lines", "__triples", "__sorted", "__twice", "__placed", "__starts")


def histograms(df: DataFrame, text: str) -> DataFrame:
    """Adds __chars (counts of the classes), __language (the list of COMMON_WORDS with most hits, the
    first among equals) and __common (counts of its words, then of all other words)."""
    df = df.withColumn("__rest", _without(text, r"a-z\x20\x{80}-\x{10FFFF}")).withColumn("__all", F.length(text))
    shown = [F.length(_without("__rest", "^" + kind)) for kind in ("A-Z", "0-9", POINTS)]
    symbols = F.length(_without("__rest", "A-Z0-9\\x09-\\x0D" + POINTS))
    df = df.withColumn("__shown", F.array(*shown, symbols, F.col("__all") - F.col("__word_chars")))
    df = df.withColumn("__chars", F.concat("__shown", F.array(F.col("__all") - F.aggregate("__shown", F.lit(0), lambda a, x: a + x))))
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    df = df.withColumn("__hits", F.filter("__words", lambda w: w.isin(every)))
    df = df.withColumns({f"__f{i}": F.size("__hits") - F.size(F.array_remove("__hits", w)) for i, w in enumerate(every)})
    own = [F.array(*(f"__f{every.index(w)}" for w in words)) for words in COMMON_WORDS.values()]
    sums = [functools.reduce(operator.add, (F.col(f"__f{every.index(w)}") for w in words)) for words in COMMON_WORDS.values()]
    df = df.withColumn("__most", F.greatest(*sums)).withColumn("__language", F.coalesce(*(F.when(x == F.col("__most"), g + 1) for g, x in enumerate(sums))))
    df = df.withColumn("__own", F.coalesce(*(F.when(F.col("__language") == g + 1, x) for g, x in enumerate(own))))
    df = df.withColumn("__common", F.concat("__own", F.array(F.col("__n") - F.col("__most"))))
    return df.drop("__rest", "__shown", "__hits", "__most", "__own", *(f"__f{i}" for i in range(len(every))))


def features(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """The columns ``keep`` with all counts, stored in the shared scratch folder: texts are read once."""
    df = docs.select(*keep, F.coalesce(text_col, F.lit("")).alias("__text"))
    df = df.withColumn("__hash", F.xxhash64("__text"))
    df = histograms(base_counts(split_words(df, "__text"), "__text"), "__text")
    return stored(df.drop("__text", "__words", "__word_chars"), "quality-features")


def references(counts: DataFrame, min_chars: int = 200, min_words: int = 50, each_text_once: bool = False) -> dict[str, list[list[float]]]:
    """Mean shares of each language's texts: {'__chars': [per language], '__common': [per language]}.

    All rows of ``features`` with ``min_chars`` and ``min_words`` count alike, or with ``each_text_once``
    all different texts (by hash).  One row per language (four) comes to the driver.  A language without
    such rows gets an empty list: nothing is compared with it."""
    df = counts.where((F.col("__all") >= min_chars) & (F.col("__n") >= min_words))
    parts = {"__chars": ("__all", N_CLASSES), "__common": ("__n", N_COMMON + 1)}
    shares = {f"{c}{i}": F.get(c, F.lit(i)) / F.col(n) for c, (n, size) in parts.items() for i in range(size)}
    df = df.select("__language", "__hash", *(x.alias(c) for c, x in shares.items()))
    if each_text_once:
        df = df.groupBy("__language", "__hash").agg(*(F.first(c).alias(c) for c in shares))
    found = {r["__language"]: r for r in df.groupBy("__language").agg(*(F.avg(c).alias(c) for c in shares)).collect()}
    return {c: [[found[g + 1][f"{c}{i}"] for i in range(size)] if g + 1 in found else [] for g in range(len(COMMON_WORDS))] for c, (_, size) in parts.items()}


def _distance(counts: str, total: str, of_language: list[list[float]]) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits) to the reference of __language."""
    refs = F.array(*(F.array(*map(F.lit, ref)) if ref else F.array().cast("array<double>") for ref in of_language))

    def term(count, q):
        p = count / F.col(total)
        m = (p + q) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (part(p) + part(q)) / 2

    ref = F.element_at(refs, F.col("__language"))
    terms = F.zip_with(counts, ref, term)
    return F.when(F.size(ref) == 0, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))


@guarded
def quality_rules(docs: DataFrame, text_col: str = "text", output: list[str] | None = None, max_char_distance: float = 0.25,
                  max_word_distance: float = 0.22, min_chars: int = 200, min_words: int = 50, each_text_once: bool = False) -> DataFrame:
    """All rows of ``docs``, its columns (or those in ``output``) with the base counts, base_failed,
    the two distances and kept.

    base_failed: under 50 words, or over half of the words in repeated triples.  A distance is 0 (not
    compared) under ``min_chars`` code points or ``min_words`` words; beyond its maximum the row is
    not kept.  Null or empty text: no words, base_failed, not kept.  Repeated rows get equal results
    (and count as rows of the references, so that many copies of a text draw its language's reference
    to it; with ``each_text_once`` they count as one), an empty table gives an empty one; input columns
    named like an added one are replaced.
    """
    keep = [c for c in replace_columns(docs, RULES) if output is None or c in output]
    df = features(docs, keep, text_col)
    refs = references(df, min_chars, min_words, each_text_once)
    enough = (F.col("__all") >= min_chars) & (F.col("__n") >= min_words)
    df = df.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "char_distance": F.when(enough, _distance("__chars", "__all", refs["__chars"])).otherwise(0.0),
        "word_distance": F.when(enough, _distance("__common", "__n", refs["__common"])).otherwise(0.0),
    })
    kept = ~F.col("base_failed") & (F.col("char_distance") <= max_char_distance) & (F.col("word_distance") <= max_word_distance)
    return df.withColumn("kept", kept).select(*keep, *RULES)
