"""Operator 4: quality classifier, a support vector machine with naive Bayes features.

N-gram indicators are scaled by the log ratio of their class counts, rows get unit length, and a
hinge-loss linear model is fitted by dual coordinate descent.  A sigmoid, fitted on a part that the
model has not seen and weighted to the true class shares, turns margins into probabilities.

Learning uses a bounded sample of the labelled rows (``max_rows``, half from each class); it runs in
one task, and two arrays of weights, of a fixed size, come back.  Scoring reads each text once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm.common import guarded, held_out, replace_columns
from scorelens.llm.ngrams import QualityFeatures

ADDED = ["score", "predicted"]


def count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of the smoothed shares of each indicator in class 1 and class 0."""
    sums = [np.bincount(np.concatenate([r for r, k in zip(rows, y) if k == c] or [np.zeros(0, int)]), minlength=size) + smooth for c in (1, 0)]
    ratio = np.log(sums[0] / sums[0].sum()) - np.log(sums[1] / sums[1].sum())
    ratio[(sums[0] + sums[1]) < 2 * smooth + 2] = 0.0  # met once or never
    return ratio


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model on rows scaled by ``ratio`` to unit length."""
    rng, w, bias = np.random.default_rng(seed), np.zeros(len(ratio)), 0.0
    values = [ratio[r] for r in rows]
    values = [v / max(np.sqrt(v @ v), 1e-12) for v in values]
    sign, alpha = np.where(y == 1, 1.0, -1.0), np.zeros(len(rows))
    norm = np.array([v @ v for v in values]) + 1.0  # the bias is a feature of value 1
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def sigmoid_of_margins(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))) by Newton steps on the weighted log loss."""
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ [a, b], -30, 30)))
        gradient = x.T @ (weight * (p - y)) + [1e-3 * a, 1e-3 * b]
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    def __init__(self, weight: np.ndarray, square: np.ndarray, bias: float, a: float, b: float):
        self.weight, self.square, self.bias, self.a, self.b = weight, square, bias, a, b

    def margin(self, row: np.ndarray) -> float:
        norm = float(np.sqrt(self.square[row].sum()))
        return float(self.weight[row].sum()) / norm + self.bias if norm > 0 else self.bias

    def score(self, row: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(row) + self.b, -30, 30))))


def fit_rows(rows: list[np.ndarray], y: np.ndarray, size: int, share: float) -> Model:
    """The model of sampled rows; ``share`` is that of class 1 among all labelled rows."""
    if len(set(y)) < 2:  # one class, or nothing: a constant
        p = min(max(share, 0.02), 0.98)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(p / (1 - p))))
    part = np.arange(len(rows)) % 5 == 0
    if len(set(y[part])) == 2 and len(set(y[~part])) == 2:
        inner, outer = np.flatnonzero(~part), np.flatnonzero(part)
    else:
        inner = outer = np.arange(len(rows))

    def fit(at):
        own = [rows[i] for i in at]
        ratio = count_ratios(own, y[at], size)
        w, bias = dual_descent(own, y[at], ratio)
        return Model(ratio * w, ratio**2, bias, 1.0, 0.0)

    first = fit(inner)
    margin = np.array([first.margin(rows[i]) for i in outer])
    weight = np.where(y[outer] == 1, share / max(y[outer].mean(), 1e-9), (1 - share) / max(1 - y[outer].mean(), 1e-9))
    a, b = sigmoid_of_margins(margin, y[outer].astype(float), weight)
    full = fit(np.arange(len(rows)))
    return Model(full.weight, full.square, full.bias, a, b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_rows: int = 10_000, bits: int = 17) -> Model:
    """Learn from labelled rows that are not held out: of each class the rows with the least id hashes,
    some ``max_rows`` / 2.  Null labels and ids don't count; of several labels of an id the largest holds."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("__y"))
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    least = F.coalesce(*(F.when(F.col("__y") == y, F.lit(min(1.0, max_rows / 2 / n))) for y, n in counts.items()), F.lit(0.0)) if counts else F.lit(0.0)
    chosen = known.where(F.expr("pmod(xxhash64(" + id_col + ", 4), 1000003)") < least * 1000003)  # about max_rows ids: broadcast
    size = 2**bits + 64

    def describe(batches):
        make = QualityFeatures(bits)
        for batch in batches:
            rows = [make(t or "").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["id", "y", "row"])

    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen.select(F.col(id_col).cast("long").alias("id"), F.col("__y").cast("long").alias("y"))), "id")
    sample = sample.select("id", "t", "y").mapInArrow(describe, "id long, y long, row binary")
    total = sum(counts.values())

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "row"])
        m = fit_rows([np.frombuffer(r, np.int32) for r in pdf["row"]], pdf["y"].to_numpy(), size, counts.get(1, 0) / max(total, 1))
        return pd.DataFrame({"weight": [m.weight.tobytes()], "square": [m.square.tobytes()], "bias": [m.bias], "a": [m.a], "b": [m.b]})

    found = sample.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(learn, "weight binary, square binary, bias double, a double, b double").collect()
    if not found:
        return fit_rows([], np.zeros(0, int), size, 0.5)
    r = found[0]
    return Model(np.frombuffer(r["weight"]), np.frombuffer(r["square"]), r["bias"], r["a"], r["b"])


@guarded
def score_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7, output: list[str] | None = None) -> DataFrame:
    """All rows of ``docs``, its columns (or those in ``output``) with score (0 to 1) and predicted.

    Null or empty text has no n-grams: its score is that of the bias.  Equal texts get equal scores, an
    empty table gives an empty one; input columns named like an added one are replaced."""
    keep = [c for c in replace_columns(docs, ADDED) if output is None or c in output]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    bits = int(np.log2(len(model.weight) - 64))

    def run(batches):
        make = QualityFeatures(bits)
        for batch in batches:
            s = np.array([model.score(make(t or "")) for t in batch.column("__quality_text").to_pylist()], float)
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, *ADDED])

    return docs.select(*keep, F.col(text_col).alias("__quality_text")).mapInArrow(run, schema)
