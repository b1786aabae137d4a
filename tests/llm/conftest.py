import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text) or (doc_id, text, lang)."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty, blank, very long and repeated texts, repeated rows, a null id, an extra column that clashes."""
    from pyspark.sql import functions as F

    words = " ".join(f"word{i % 977} of the" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, words), (5, "one two three. four five six"), (5, "one two three. four five six"),
            (None, "no id here at all"), (6, "x" * 50_000), (7, "▁ ünï 日本 \x00 a@b.cd +1 (222) 333-4444"), (8, None, None)]
    df = make_docs(rows)
    clash = ["n_lines", "kept", "score", "lang_pred", "pii_spans", "ids", "n_words", "__note"]
    return df.select("*", *(F.lit("mine").alias(c) for c in clash))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
