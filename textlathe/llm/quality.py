"""Quality classifier by positive-unlabelled learning: trusted positives, unlabelled web text and an estimated class prior.

A linear model over numbers on the make of a text and over hashed character n-grams minimises the non-negative unbiased
risk. The prior is estimated from the same two samples: no label 0 is ever looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import first_by_hash, fold, labelled, texts_of
from .subwords import BUCKETS, bag, mean_weights
from .toxicity import score_texts, sigmoid

#: Classes of characters: letters are told by case, the rest by code.
KINDS = ("upper", "lower", "digit", "space", "line", "stop", "pipe", "other")
STOPS = ".,;:?'\"()-"


def kinds_of(text: str) -> np.ndarray:
    """How many characters of a text are of each of KINDS."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.bincount(codes[codes < 128], minlength=128)
    upper, lower, digit = low[65:91].sum(), low[97:123].sum(), low[48:58].sum()
    line, space = low[10], low[9] + low[11:14].sum() + low[32]
    stop, pipe = sum(low[ord(c)] for c in STOPS), low[ord("|")]
    high = codes[codes >= 128]
    capital = int(((high >= 0xC0) & (high <= 0xDE) & (high != 0xD7)).sum())
    letters = int((high >= 0xC0).sum()) - capital
    other = len(codes) - (upper + lower + digit + line + space + stop + pipe + capital + letters)
    return np.array([upper + capital, lower + letters, digit, space, line, stop, pipe, other], float)


def features(text: str | None) -> np.ndarray:
    """Numbers on the make of a whole text: shares of kinds of characters, of repeated words, pairs and lines, of words
    of one character, and lengths. The last is 1 for a text without words, and all others are 0 then."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return np.concatenate((np.zeros(len(KINDS) + 11), [1.0]))
    kinds = kinds_of(text)
    counts = Counter(words)
    most = max(counts.values())
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    plain = sum(c for w, c in counts.items() if w.rstrip(STOPS).isalpha())
    one = sum(c for w, c in counts.items() if len(w) == 1)
    per_word = len(text) / n
    rest = [
        np.log1p(n) / 10, 1 / (1 + n), min(per_word, 40) / 10, len(counts) / n * np.sqrt(1 + n / 200) / 2, most / n,
        pairs / max(1, n - 1), len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))) / 5, plain / n, one / n,
        kinds[0] / max(1.0, kinds[0] + kinds[1]),
    ]
    return np.concatenate((kinds / len(text), rest, [0.0]))


def expand(x: np.ndarray) -> np.ndarray:
    """The features with their products, so that a linear model can bend."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate((x, x[:, i] * x[:, j]), axis=1)


#: Buckets of n-grams are folded to so many columns; in units of the spread of each, they weigh this much beside the rest.
COLUMNS, GRAM_SCALE = 512, 0.1


def gram_rows(texts: list[str], at_once: int = 128) -> np.ndarray:
    """The mean share of each column of n-grams in the words of each text; of few texts at once, as their n-grams take
    many times the memory of the result."""
    out = np.zeros((len(texts), COLUMNS), np.float32)
    for start in range(0, len(texts), at_once):
        row, col, value = bag(texts[start : start + at_once])
        n = min(at_once, len(texts) - start)
        out[start : start + n] = np.bincount(row.astype(np.int64) * COLUMNS + col % COLUMNS, weights=value, minlength=n * COLUMNS).reshape(n, COLUMNS)
    return out


@dataclass
class QualityModel:
    """`weights` of the expanded features, after `mean` and `spread`; `gram_weights` of each bucket of n-grams."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    gram_weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return sigmoid(self.logit(texts))

    def logit(self, texts: list[str | None]) -> np.ndarray:
        made = ((expand(np.stack([features(t) for t in texts])) - self.mean) / self.spread).clip(-8, 8) @ self.weights
        return made + mean_weights(texts, self.gram_weights, len(texts)) + self.bias


def constant(prior: float) -> QualityModel:
    width = expand(np.stack([features("")])).shape[1]
    share = min(max(prior, 1e-3), 1 - 1e-3)
    return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))


def risk(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the unbiased risk with the logistic loss, and the gradient of each: `prior * R_p(+)`, and
    `R_u(-) - prior * R_p(-)`, where R_p and R_u are means of losses over positives and unlabelled texts."""
    zp, zu = xp @ w, xu @ w
    up = prior * np.logaddexp(0, -zp).mean()
    down = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    pull = -prior * xp.T @ sigmoid(-zp) / len(zp)
    push = xu.T @ sigmoid(zu) / len(zu) - prior * xp.T @ sigmoid(zp) / len(zp)
    return up, down, pull, push


def minimised(p: np.ndarray, u: np.ndarray, prior: float | None, *, steps: int, batch: int, rate: float, decay: float, seed: int) -> np.ndarray:
    """Weights that minimise `up + max(0, down)` by Adam. Where `down` falls below zero, which only memorised texts can
    cause, the step goes the other way for that part. Without a prior, positives are told from unlabelled texts."""
    rng = np.random.default_rng(seed)
    w, first, second = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    for step in range(steps):
        xp, xu = (x[rng.integers(0, len(x), min(batch, len(x)))] for x in (p, u))
        now = w.astype(p.dtype)
        if prior is None:
            grad = -xp.T @ sigmoid(-xp @ now) / len(xp) + xu.T @ sigmoid(xu @ now) / len(xu)
        else:
            _, down, pull, push = risk(now, xp, xu, prior)
            grad = pull + push if down >= 0 else -push
        grad = grad + decay * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= rate * (1 - step / steps) * first / (1 - 0.9 ** (step + 1)) / (np.sqrt(second / (1 - 0.999 ** (step + 1))) + 1e-8)
    return w


def mixture_share(p: np.ndarray, u: np.ndarray, doubt: float = 0.1) -> float:
    """Which share of the scores `u` comes from what the scores `p` come from.

    Above any level, the share of `u` is at least that share times the share of `p`; the ratio is closest where only
    positives are. The level with the least upper bound of the ratio, by the deviation of both shares with confidence
    1 - `doubt`, gives the estimate.
    """
    levels = np.unique(p)
    of_p = 1 - np.searchsorted(np.sort(p), levels) / len(p)
    of_u = 1 - np.searchsorted(np.sort(u), levels) / len(u)
    wide = sum(np.sqrt(np.log(4 / doubt) / (2 * n)) for n in (len(p), len(u)))
    best = int(np.argmin((of_u + wide) / of_p))
    return float(min(1.0, of_u[best] / of_p[best]))


def train(positive: list[str], unlabelled: list[str], prior: float | None = None, *, steps: int = 400, batch: int = 1000, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> QualityModel:
    """A model from both samples; the prior is estimated if none is given: a first model tells positives from unlabelled
    texts on two of three texts of each, and the scores of the others tell the share of positives."""
    if not positive or not unlabelled or (prior is not None and prior >= 1):
        return constant(0.5 if prior is None else prior)
    made_p, made_u = (expand(np.stack([features(t) for t in texts])) for texts in (positive, unlabelled))
    mean, spread = made_u.mean(axis=0), made_u.std(axis=0) + 1e-6
    gram_p, gram_u = gram_rows(positive), gram_rows(unlabelled)
    middle, wide = gram_u.mean(axis=0), gram_u.std(axis=0) + 1e-6
    p, u = (np.column_stack([((m - mean) / spread).clip(-8, 8), (g - middle) / wide * GRAM_SCALE, np.ones(len(m))]).astype(np.float32) for m, g in ((made_p, gram_p), (made_u, gram_u)))
    how = {"steps": steps, "batch": batch, "rate": rate, "decay": decay, "seed": seed}
    if prior is None:
        told = minimised(p[np.arange(len(p)) % 3 > 0], u[np.arange(len(u)) % 3 > 0], None, **how) if min(len(p), len(u)) > 2 else np.zeros(p.shape[1])
        prior = min(max(mixture_share(p[::3] @ told, u[::3] @ told), 1e-3), 1 - 1e-3)
    w = minimised(p, u, prior, **how)
    grams = w[made_p.shape[1] : -1] / wide * GRAM_SCALE
    return QualityModel(mean, spread, w[: made_p.shape[1]], np.tile(grams, BUCKETS // COLUMNS).astype(np.float32), float(w[-1] - middle @ grams))


def fit_quality(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1, max_positive: int = 3000, max_unlabelled: int = 6000, max_chars: int = 100_000) -> QualityModel:
    """A model from at most `max_positive` texts labelled 1 and `max_unlabelled` texts of any kind, whose labels are not
    looked at; none is in the held-out fold. Of labels only the ones are read. Texts of more than `max_chars` characters
    are scored like all others, but not learnt from, so that the sample is bounded in bytes too."""
    trusted = first_by_hash(labelled(labels, "quality", folds, held_out).where("y = 1"), max_positive).select("doc_id", F.lit(1).alias("y"))
    open_ids = docs.where(F.coalesce(fold(F.col("doc_id"), folds) != held_out, F.lit(True))).select("doc_id")
    web = first_by_hash(open_ids, max_unlabelled, seed=29).distinct().select("doc_id", F.lit(0).alias("y"))
    sample = texts_of(docs, trusted.unionByName(web)).where(F.char_length("text") <= max_chars)
    sample = sample.select("doc_id", "text", "y").limit(2 * (max_positive + max_unlabelled)).toPandas().sort_values(["y", "doc_id", "text"], kind="stable")
    return train(sample.loc[sample["y"] == 1, "text"].tolist(), sample.loc[sample["y"] == 0, "text"].tolist())


def quality(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1, max_positive: int = 3000, max_unlabelled: int = 6000) -> DataFrame:
    """`doc_id, held_out, score, predicted` of each row of `docs`; labels come from the other folds only.

    Null and empty texts are scored by a feature of their own. Without a label 1 all rows get 0.5. A null id is in no
    held-out fold. Repeated rows give repeated results, an empty table none; no column but id and text is read.
    """
    model = fit_quality(docs, labels, folds=folds, held_out=held_out, max_positive=max_positive, max_unlabelled=max_unlabelled)
    return score_texts(docs, model, folds=folds, held_out=held_out)


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of `docs`, all columns, whose texts score 0.5 or more. Rows are judged one by one: null and empty texts by
    a feature of their own, rows without an id and repeated rows like any other; without a label 1 all stay. An empty
    table gives none."""
    model = fit_quality(docs, labels, **params)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array(shared.value.score(texts) >= 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
