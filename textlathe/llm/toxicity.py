"""Toxicity: subword-bag embeddings, averaged, into a linear softmax; embeddings and softmax are trained together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import first_by_hash, fold, labelled, texts_of
from .subwords import BUCKETS, bag, mean_weights


@dataclass
class ToxicityModel:
    """`weights`: of each bucket, the difference of the two class scores of its vector, so that a text's score is a mean
    of them. `scale` and `shift`, by the logarithm of the number of characters: how a mean is turned into log odds."""

    weights: np.ndarray
    scale: tuple[float, float]
    shift: tuple[float, float]

    def score(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(log_odds(mean_weights(texts, self.weights, len(texts)), sizes(texts), np.array([*self.scale, *self.shift])))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sizes(texts: list[str | None]) -> np.ndarray:
    return np.log1p(np.array([len(t or "") for t in texts], float)) / 10


def log_odds(mean: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (p[0] + p[1] * size) * mean + p[2] + p[3] * size


def train(texts: list[str], y: np.ndarray, odds: float, *, dim: int = 16, epochs: int = 16, batch: int = 500, gain: float = 150.0, rate: float = 0.02, spread: float = 0.005, least_steps: int = 192, least_texts: int = 3, least_share: float = 0.01, decay: float = 2e-4, seed: int = 0) -> ToxicityModel:
    """Fits the vectors of all buckets and the softmax jointly by Adam. `odds`: of label 1 among all labelled rows; the
    sample's classes are weighted to it. One in five texts is kept from the fit, to turn means into log odds."""
    if len(texts) < 20 or y.min() == y.max():
        share = odds / (1 + odds)
        level = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        return ToxicityModel(np.zeros(BUCKETS, np.float32), (0.0, 0.0), (level, 0.0))
    rng = np.random.default_rng(seed)
    kept = rng.random(len(y)) < 0.2
    fitted = np.flatnonzero(~kept)
    row, col, value = bag([texts[i] for i in fitted])
    spread_over = np.bincount(col, minlength=BUCKETS)  # in how many texts each bucket is: a text has one entry for one
    common = (spread_over >= max(least_texts, least_share * len(fitted)))[col]
    row, col, value = row[common], col[common], value[common]
    order = np.argsort(row, kind="stable")
    row, col, value = row[order], col[order], value[order]
    ends = np.searchsorted(row, np.arange(len(fitted) + 1))
    target = y[fitted].astype(float)
    importance = np.where(y == 1, odds / (1 + odds) / y.mean(), 1 / (1 + odds) / (1 - y.mean()))
    weight = importance[fitted]

    vectors = rng.normal(0, spread, (BUCKETS, dim)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.3, (dim, 2)).astype(np.float32), 0.0
    moments = [np.zeros_like(vectors), np.zeros_like(vectors), np.zeros_like(softmax), np.zeros_like(softmax)]
    batch = min(batch, max(32, len(fitted) // 8))
    epochs = max(epochs, least_steps // -(-len(fitted) // batch))
    steps, step = epochs * -(-len(fitted) // batch), 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(fitted))
        for at in range(0, len(fitted), batch):
            ids = shuffled[at : at + batch]
            take = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in ids])
            local, c, v = np.repeat(np.arange(len(ids)), ends[ids + 1] - ends[ids]), col[take], value[take]
            # with two classes only the difference of the class scores matters, so one number per bucket goes forward
            difference = softmax[:, 1] - softmax[:, 0]
            logit = gain * np.bincount(local, weights=v * (vectors @ difference)[c], minlength=len(ids)) + bias
            error = (sigmoid(logit) - target[ids]) * weight[ids] / len(ids)
            back = gain * np.bincount(c, weights=v * error[local], minlength=BUCKETS)
            touched = np.flatnonzero(back)
            to_softmax = (vectors.T @ back.astype(np.float32))[:, None] * np.array([[-1, 1]], np.float32)
            to_vectors = (back[touched, None] * difference[None, :]).astype(np.float32)
            now = rate * (1 - step / steps)
            step += 1
            for what, at_, grad, (m, s) in ((vectors, touched, to_vectors, moments[:2]), (softmax, slice(None), to_softmax, moments[2:])):
                grad = grad + decay * what[at_]
                m[at_] = 0.9 * m[at_] + 0.1 * grad
                s[at_] = 0.99 * s[at_] + 0.01 * grad * grad
                what[at_] -= now * m[at_] / (np.sqrt(s[at_]) + 1e-8)
            bias -= 2.5 * now * gain * error.sum()
    weights = (gain * (vectors @ (softmax[:, 1] - softmax[:, 0]))).astype(np.float32)
    rest = [texts[i] for i in np.flatnonzero(kept)]
    scale = calibrate(mean_weights(rest, weights, len(rest)), sizes(rest), y[kept], importance[kept], bias)
    return ToxicityModel(weights, (scale[0], scale[1]), (scale[2], scale[3]))


def calibrate(mean: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray, bias: float, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression of y on the mean, with slope and offset linear in the size; from (1, 0, bias, 0)."""
    start = p = np.array([1.0, 0.0, bias, 0.0])
    if not len(y):
        return p
    x = np.column_stack([mean, mean * size, np.ones_like(mean), size])
    for _ in range(50):
        q = sigmoid(x @ p)
        grad = x.T @ ((q - y) * weight) / len(y) + ridge * (p - start)
        curve = (x * (q * (1 - q) * weight)[:, None]).T @ x / len(y) + ridge * np.eye(4)
        move = np.linalg.solve(curve, grad)
        p = p - move * min(1.0, 2.0 / (np.abs(move).max() + 1e-9))
    return p


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_out: int = 0, max_rows: int = 3000, max_chars: int = 100_000) -> ToxicityModel:
    """A model from at most `max_rows` labelled texts of either class, none of them in the held-out fold. Texts of more
    than `max_chars` characters are scored like all others, but not learnt from, so that the sample is bounded in bytes
    too."""
    rows = labelled(labels, "toxic", folds, held_out)
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = first_by_hash(rows.where("y = 1"), max_rows).unionByName(first_by_hash(rows.where("y = 0"), max_rows))
    sample = texts_of(docs, chosen).where(F.char_length("text") <= max_chars).select("doc_id", "text", "y").orderBy("doc_id", F.xxhash64("text"), "y").limit(4 * max_rows).toPandas().sort_values(["doc_id", "text"], kind="stable")
    odds = max(totals.get(1, 0), 0.5) / max(totals.get(0, 0), 0.5)
    return train(sample["text"].tolist(), sample["y"].to_numpy(), odds)


def score_texts(docs: DataFrame, model, *, folds: int, held_out: int) -> DataFrame:
    """`doc_id, held_out, score, predicted` of each row, by `model.score`, which travels as a broadcast variable."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["doc_id", "held_out"]].assign(score=shared.value.score(frame["text"].tolist()))

    read = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "text")
    return read.mapInPandas(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_out: int = 0, max_rows: int = 3000) -> DataFrame:
    """`doc_id, held_out, score, predicted` of each row of `docs`; labels come from the other folds only.

    Null and empty texts have no words and get the score of an empty bag. Without labels of both classes all rows get
    the share of label 1 as their score. A null id is in no held-out fold. Repeated rows give repeated results, an empty
    table none; no column but id and text is read.
    """
    model = fit_toxicity(docs, labels, folds=folds, held_out=held_out, max_rows=max_rows)
    return score_texts(docs, model, folds=folds, held_out=held_out)
