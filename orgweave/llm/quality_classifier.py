"""Quality classifier: positive-unlabelled learning with a non-negative risk.

Trusted positives are rows labelled 1; everything else is unlabelled web text.
A logistic model over surface counts of the whole text is fitted by minimising

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

where the second term is the risk of the unseen negatives, held at zero or
above. The class prior is estimated without negatives as well: a first model
tells positives from unlabelled rows, and the smallest ratio of unlabelled to
positive mass above a score is the share of positives among the unlabelled.

The model is fitted on a bounded sample (``max_rows`` rows of each kind, taken
by a hash of the id); every whole text is scored. Labels, language, source and
id are no inputs of the score.

Odd input: a null text scores like an empty one; without any positive row every
score is 0.5; a null label is no label and a null id belongs to the training
side but has no label; repeated rows get the same score each; input columns
named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.llm.common import without

RESULTS = ["held_out", "score", "predicted"]
THRESHOLD = 0.7
MAX_ROWS = 20_000

_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: str | None) -> np.ndarray:
    """Surface counts of one text: shares of signs and letter cases, word and line repetition."""
    raw = (text or "").encode()
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256).astype(np.float64)
    upper, lower = hist[65:91].sum(), hist[97:123].sum()
    words = (text or "").split()
    lines = (text or "").split("\n")
    w = max(len(words), 1)
    different = len(set(words))
    twins = sum(map(eq, words, words[1:]))
    shares = [upper / max(upper + lower, 1), hist[48:58].sum() / max(n, 1), hist[128:].sum() / max(n, 1),
              hist[10] / max(n, 1), twins / w, different / w, different / w ** 0.75,
              1 - len(set(lines)) / len(lines), len(words) / len(lines) / (20 + len(words) / len(lines))]
    return np.concatenate([np.sqrt(np.maximum(shares, 0)), np.sqrt(hist[list(_SIGNS)] / w),
                           [np.log1p(len(words)) / 10, n / w / (8 + n / w)]])


N_FEATURES = len(features(""))


@dataclass
class Model:
    """Standardised logistic weights."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam with a falling rate from zero weights."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for i in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - i / (steps + 1)) * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.999 ** i)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled scores: the least U/P mass ratio above a positive quantile."""
    cuts = np.quantile(positive, np.linspace(0.05, 0.6, 23))
    ratios = [np.mean(unlabelled >= c) / max(np.mean(positive >= c), 1e-9) for c in cuts]
    return float(np.clip(min(ratios), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> Model:
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]) for x in (positive, unlabelled))

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def told_apart(w: np.ndarray) -> np.ndarray:
        return p.T @ (sigmoid(p @ w) - 1) / len(p) + u.T @ sigmoid(u @ w) / len(u) + decay * w

    first = _descend(told_apart, p.shape[1], steps // 2, rate)
    prior = estimate_prior(p @ first, u @ first)

    def risk(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negatives = u.T @ sigmoid(zu) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
        # below zero the model overfits the negatives: step back on that term alone
        if negative < 0:
            return -of_negatives + decay * w
        return prior * (p.T @ (sigmoid(zp) - 1)) / len(p) + of_negatives + decay * w

    w = _descend(risk, p.shape[1], steps, rate)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of at most ``max_rows`` positive and as many unlabelled rows of the training side."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    sure = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("least"), F.max("quality").alias("most"))
    sure = sure.where("least = 1 and most = 1").where(~held_out(F.col("doc_id"))).select("doc_id")
    share = max_rows / max(sure.count(), 1)
    positive = sure.where(part < share).limit(max_rows).withColumn("__llm_positive", F.lit(True))
    train = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    rest = max_rows / max(docs.select("doc_id").where(~held_out(F.col("doc_id"))).count(), 1)
    # at most max_rows ids are broadcast
    chosen = train.join(F.broadcast(positive), "doc_id", "left").withColumn(
        "__llm_free", part < rest).where("__llm_positive or __llm_free")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"positive": pdf["sure"], "free": pdf["free"],
                                "x": [features(t).tolist() for t in pdf["text"]]})

    # the texts are measured where they lie; only their counts come together, 3 * max_rows rows at most
    rows = chosen.select("text", F.coalesce("__llm_positive", F.lit(False)).alias("sure"),
                         F.coalesce("__llm_free", F.lit(False)).alias("free")).mapInPandas(
        measure, "positive boolean, free boolean, x array<double>").limit(3 * max_rows).toPandas()
    x = np.array(rows["x"].tolist()).reshape(-1, N_FEATURES)
    return x[rows["positive"].to_numpy(dtype=bool)], x[rows["free"].to_numpy(dtype=bool)]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """Fit on the rows whose id isn't held out; None without positives."""
    positive, unlabelled = _sample(docs, labels, max_rows)
    return fit(positive, unlabelled) if len(positive) and len(unlabelled) else None


def score_texts(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """Add held_out, score and predicted to every row."""
    docs = without(docs, RESULTS)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES))
                            if model else np.full(len(texts), 0.5))

    return docs.withColumns({"held_out": held_out(F.col("doc_id")), "score": score("text")}).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    return score_texts(docs, train(docs, labels, max_rows), threshold)
