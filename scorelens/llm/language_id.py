"""Operator 10: language of a text by its nearest centroid of TF-IDF n-gram vectors.

Document frequencies are counted over all rows to learn from; each language's vectors (of a bounded
sample) are clustered into several centroids by cosine.  A text gets the language of the nearest
centroid, and is flagged as rejected if that is farther than nearly all vectors the language was
learned from.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm.common import free_name, held_out, replace_columns
from scorelens.llm.ngrams import byte_grams

LETTER = regex.compile(r"\p{L}")
ADDED = ["lang_pred", "score", "rejected"]
#: Texts in a matrix at once, and the range of text hashes.
SLICE, RANGE = 256, 2**52


#: A-Z become a-z; ASCII characters that are no letters become blanks.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counts(text: str, bits: int) -> np.ndarray:
    """Counts of hashed 3-grams of bytes of the text's words, with one blank around each."""
    words = b" ".join(text.encode().translate(LETTERS).split())
    return np.bincount(byte_grams(b" " + words + b" ", 3, bits), minlength=2**bits)


def vectors(texts: list[str], idf: np.ndarray, bits: int) -> np.ndarray:
    """TF-IDF rows (logarithmic counts) of unit length."""
    x = np.stack([counts(t, bits) for t in texts]).astype(np.float32)
    x = np.log1p(x, out=x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids of spherical k-means; starts from vectors far from each other."""
    rng = np.random.default_rng(seed)
    centers = x[[int(rng.integers(len(x)))]]
    while len(centers) < min(k, len(x)):
        far = 1 - (x @ centers.T).max(axis=1)
        centers = np.vstack([centers, x[int(far.argmax())]])
    for _ in range(rounds):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centers[j] for j in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers.astype(np.float32)


class Model:
    def __init__(self, langs: list[str], centers: np.ndarray, least: np.ndarray, idf: np.ndarray, bits: int):
        self.langs, self.centers, self.least, self.idf, self.bits = langs, centers, least, idf, bits

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        able = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        for s in range(0, len(able), SLICE):
            rows = able[s : s + SLICE]
            cosine = vectors([texts[i] for i in rows], self.idf, self.bits) @ self.centers.T
            for i, best, value in zip(rows, cosine.argmax(axis=1), cosine.max(axis=1)):
                out[i] = (self.langs[best], float(min(max(value, 0.0), 1.0)), bool(value < self.least[best]))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = 13, centroids: int = 4,
        max_rows: int = 1500, reject: float = 0.005) -> Model:
    """Learn from rows with a language and a letter that are not held out.  Of each language's
    different texts the ``max_rows`` with the least hashes are clustered, so copies neither fill the sample
    nor leave it empty; frequencies come from all rows."""
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"))
    known = known.where(F.col("t").rlike(r"\p{L}"))

    def frequencies(batches):
        df, langs = np.zeros(2**bits, np.int64), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                df += counts(text, bits) > 0
                langs[lang] = langs.get(lang, 0) + 1
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array([None] * len(at), pa.string()), pa.array(df[at])], names=["gram", "lang", "n"])
        yield pa.record_batch([pa.array([None] * len(langs), pa.int64()), pa.array(list(langs), pa.string()), pa.array(list(langs.values()), pa.int64())], names=["gram", "lang", "n"])

    found = known.mapInArrow(frequencies, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")).collect()
    by_lang = {r["lang"]: r["n"] for r in found if r["gram"] is None}
    df = np.zeros(2**bits)
    for r in found:
        if r["gram"] is not None:
            df[r["gram"]] = r["n"]
    idf = (np.log((1 + sum(by_lang.values())) / (1 + df)) + 1).astype(np.float32)
    if not by_lang:
        return Model([], np.zeros((0, 2**bits), np.float32), np.zeros(0), idf, bits)
    # the rate is set on different texts, with room for chance; the least hashes of them are taken below
    texts = known.withColumn("h", F.expr(f"pmod(xxhash64(t, 6), {RANGE}L)"))
    different = texts.select("lang", "h").distinct().groupBy("lang").count().collect()
    share = F.create_map(*(x for r in different for x in (F.lit(r["lang"]), F.lit(min(1.0, (1.1 * max_rows + 100) / r["count"])))))
    sample = texts.where(F.col("h") < F.element_at(share, F.col("lang")) * RANGE).groupBy("lang", "h").agg(F.min("t").alias("t"))

    def vector_rows(batches):
        for b in batches:
            yield pa.record_batch([b.column("lang"), b.column("h"), pa.array([vectors([t], idf, bits)[0].tobytes() for t in b.column("t").to_pylist()], pa.binary())], names=["lang", "h", "x"])

    rows = sample.mapInArrow(vector_rows, "lang string, h long, x binary")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(r, np.float32) for r in sorted(set(pdf.nsmallest(max_rows, "h")["x"]))])
        centers = cluster(x, centroids)
        cosine = x @ centers.T
        own = cosine.argmax(axis=1)
        least = [float(np.quantile(cosine[own == j, j], reject)) if (own == j).any() else 1.0 for j in range(len(centers))]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(centers), "center": [c.tobytes() for c in centers], "least": least})

    made = sorted(rows.groupBy("lang").applyInPandas(learn, "lang string, center binary, least double").collect(), key=lambda r: (r["lang"], r["center"]))
    return Model([r["lang"] for r in made], np.stack([np.frombuffer(r["center"], np.float32) for r in made]), np.array([r["least"] for r in made]), idf, bits)


def identify(docs: DataFrame, model: Model, text_col: str = "text", output: list[str] | None = None) -> DataFrame:
    """All rows of ``docs``, its columns (or those in ``output``) with lang_pred, score (cosine, 0 to 1)
    and rejected.

    Null texts, and texts without a letter, are ``und`` (score 0, rejected), as are all if nothing was
    learned.  Equal texts get equal results, an empty table gives an empty one; input columns named like
    an added one are replaced."""
    keep = [c for c in replace_columns(docs, ADDED) if output is None or c in output]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    text = free_name(docs, "language_text")

    def run(batches):
        for batch in batches:
            p = model.predict(batch.column(text).to_pylist())
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array([x[0] for x in p], pa.string()), pa.array([x[1] for x in p], pa.float64()), pa.array([x[2] for x in p], pa.bool_())], names=[*keep, *ADDED])

    return docs.select(*keep, F.col(text_col).alias(text)).mapInArrow(run, schema)
