"""Language identification by a convolutional network over bytes: filters of several widths, the greatest response of each
in a window, and a softmax. Trained in numpy on windows of labelled texts; a text is read whole, window by window."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import fold

#: Bytes of a window, widths of the filters, filters of each width, and numbers that stand for a byte.
WINDOW, WIDTHS, FILTERS, DIM = 128, (2, 3, 4, 5), 12, 8
REACH = max(WIDTHS)
PLACES = WINDOW - REACH + 1
#: Windows that go through the network at once.
BLOCK = 128
#: Other ASCII than letters is a space: digits, marks and markup say little about a language.
LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
UNKNOWN = "und"


def text_bytes(text: str) -> bytes:
    """The text in lower case as UTF-8, runs of other ASCII than letters as one space, with spaces around."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS).split()) + b" " * REACH


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, and the number of the text of each. Windows overlap by the greatest width less one, so
    that each run of bytes of a filter's width lies in one; the last window of a text is filled with spaces."""
    counts = np.array([max(1, -(-(len(t) - REACH + 1) // PLACES)) for t in texts], np.int64)
    sizes = counts * PLACES + REACH - 1
    joined = np.frombuffer(b"".join(t.ljust(n) for t, n in zip(texts, sizes.tolist())), np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))[owner] + (np.arange(len(owner)) - np.concatenate(([0], np.cumsum(counts)[:-1]))[owner]) * PLACES
    return np.lib.stride_tricks.sliding_window_view(joined, WINDOW)[first], owner


def filter_mask() -> np.ndarray:
    """Which weights a filter has: one of width w reads the first w of REACH bytes."""
    widths = np.repeat(WIDTHS, FILTERS)
    return (np.arange(REACH)[:, None, None] < widths).repeat(DIM, axis=1).reshape(REACH * DIM, len(widths)).astype(np.float32)


@dataclass
class LanguageModel:
    """`vectors` of the bytes, `filters` and their `offsets`, `softmax` and `bias` over the languages."""

    names: list[str]
    vectors: np.ndarray
    filters: np.ndarray
    offsets: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    def unfolded(self, windows: np.ndarray) -> np.ndarray:
        """Of each window and place in it, the vectors of the bytes that a filter reads there, side by side."""
        v = self.vectors[windows]
        at = np.lib.stride_tricks.as_strided(v, (len(windows), PLACES, REACH * DIM), (v.strides[0], v.strides[1], v.itemsize))
        return np.ascontiguousarray(at)

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.unfolded(windows)
        return x, (x.reshape(-1, x.shape[2]) @ self.filters).reshape(len(windows), PLACES, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(windows), len(self.names)), np.float32)
        for at in range(0, len(windows), BLOCK):
            best = self.responses(windows[at : at + BLOCK])[1].max(axis=1)
            out[at : at + BLOCK] = softmax(np.maximum(best + self.offsets, 0) @ self.softmax + self.bias)
        return out

    def predict(self, texts: list[str], group: int = 1 << 20) -> tuple[list[str], np.ndarray]:
        """Of each text, the language with the greatest mean probability over its windows, each by its letters, and that
        mean. Windows of some `group` bytes of texts are made at once."""
        total = np.zeros((len(texts), len(self.names)))
        held: list[bytes] = []
        size = first = 0
        for i, text in enumerate(texts):
            held.append(text_bytes(text))
            size += len(held[-1])
            if size >= group or i == len(texts) - 1:
                windows, owner = cut_windows(held)
                weight = (windows != 0x20).sum(axis=1)
                for at in range(0, len(windows), 64 * BLOCK):
                    part = slice(at, at + 64 * BLOCK)
                    p = self.probabilities(windows[part]) * weight[part, None]
                    for k in range(p.shape[1]):
                        total[first : i + 1, k] += np.bincount(owner[part], weights=p[:, k], minlength=len(held))
                held, size, first = [], 0, i + 1
        share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-30)
        best = share.argmax(axis=1)
        return [self.names[k] for k in best], share[np.arange(len(texts)), best].clip(0, 1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(model: LanguageModel, windows: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean cross-entropy of some windows, and its gradients by vectors, filters, offsets, softmax and bias. Only the
    place with the greatest response of each filter has a share in them."""
    m, f = len(windows), model.filters.shape[1]
    x, r = model.responses(windows)
    place = r.argmax(axis=1)
    best = np.take_along_axis(r, place[:, None, :], axis=1)[:, 0] + model.offsets
    active = np.maximum(best, 0)
    p = softmax(active @ model.softmax + model.bias)
    loss = float(-np.log(p[np.arange(m), y] + 1e-12).mean())
    error = p.copy()
    error[np.arange(m), y] -= 1
    error /= m
    back = (error @ model.softmax.T) * (best > 0)
    read = x[np.arange(m)[:, None], place]  # what each filter read at its best place
    to_filters = np.einsum("mf,mfk->kf", back, read) * mask
    to_bytes = (back[:, :, None] * model.filters.T[None]).reshape(m * f * REACH, DIM)
    codes = windows[np.arange(m)[:, None, None], place[:, :, None] + np.arange(REACH)].ravel()
    to_vectors = np.column_stack([np.bincount(codes, weights=to_bytes[:, k], minlength=256) for k in range(DIM)]).astype(np.float32)
    return loss, [to_vectors, to_filters, back.sum(axis=0), active.T @ error, error.sum(axis=0)]


def train(windows: np.ndarray, y: np.ndarray, names: list[str], *, steps: int = 700, batch: int = 192, rate: float = 0.008, decay: float = 1e-4, seed: int = 0) -> LanguageModel:
    """Fits vectors, filters and softmax together by Adam; batches have all languages about equally often."""
    rng = np.random.default_rng(seed)
    mask = filter_mask()
    normal = lambda size, spread: rng.normal(0, spread, size).astype(np.float32)
    model = LanguageModel(names, normal((256, DIM), 0.5), normal(mask.shape, 0.25) * mask, np.zeros(mask.shape[1], np.float32), normal((mask.shape[1], len(names)), 0.1), np.zeros(len(names), np.float32))
    if len(names) < 2:
        return model
    weights = (1 / np.bincount(y, minlength=len(names)))[y]
    weights /= weights.sum()
    parts = [model.vectors, model.filters, model.offsets, model.softmax, model.bias]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in parts]
    order = rng.choice(len(y), steps * batch, p=weights)
    for step in range(steps):
        ids = order[step * batch : (step + 1) * batch]
        _, grads = gradients(model, windows[ids], y[ids], mask)
        now = rate * (1 - step / steps)
        for w, g, (a, b) in zip(parts, grads, moments):
            g = g + decay * w
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (now * (a / (1 - 0.9 ** (step + 1))) / (np.sqrt(b / (1 - 0.99 ** (step + 1))) + 1e-8)).astype(np.float32)
    return model


def has_letter(text):
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit_languages(docs: DataFrame, *, folds: int = 4, held_out: int = 2, max_texts: int = 1000, max_languages: int = 200, per_text: int = 8) -> LanguageModel | None:
    """A network from windows of texts outside the held-out fold; None if no text has a language.

    The sample is bounded: of each of the `max_languages` most frequent languages about `max_texts` texts, chosen by a
    hash of id and text against a level that follows from how many texts the language has, and of each text `per_text`
    windows at random places of the whole of it. Only these windows leave the tasks, at most twice `max_texts` texts a
    language of them.
    """
    open_rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), folds) != held_out) & has_letter(F.col("text")))
    counts = {r["lang"]: r["n"] for r in open_rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not counts:
        return None
    names = sorted(counts)
    draw = F.pmod(F.xxhash64(F.lit(31), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    level = F.create_map(*[F.lit(v) for lang in names for v in (lang, min(1.0, max_texts / counts[lang]))])
    chosen = open_rows.where(F.col("lang").isin(names)).withColumn("draw", draw).where(F.col("draw") < F.element_at(level, F.col("lang")))
    room = F.greatest(F.lit(1), F.char_length("text") - WINDOW + 1)
    pieces = F.transform(F.sequence(F.lit(1), F.lit(per_text)), lambda i: F.substr(F.col("text"), (F.pmod(F.xxhash64("doc_id", i), room) + 1).cast("int"), F.lit(WINDOW)))
    rows = chosen.select("draw", "doc_id", "lang", F.array_distinct(pieces).alias("pieces")).orderBy("draw", "doc_id", "pieces").limit(2 * max_texts * len(names)).collect()
    found = [(text_bytes(piece), names.index(r["lang"])) for r in rows for piece in r["pieces"]]
    found = [(data, k) for data, k in found if data.strip()] or [(b" ", 0)]
    windows, owner = cut_windows([data for data, _ in found])
    firsts = np.searchsorted(owner, np.arange(len(found)))
    return train(windows[firsts], np.array([k for _, k in found]), names)


def languages(docs: DataFrame, *, folds: int = 4, held_out: int = 2, max_texts: int = 1000) -> DataFrame:
    """`doc_id, held_out, lang_pred, score` of each row of `docs`, from all windows of its whole text.

    A null text, and one without any letter, gives `und` with score 0; so do all texts where no text has a language to
    learn from. Letters of scripts that were not learnt get a learnt language, as the network sees bytes alone. A null id
    is in no held-out fold, and nothing is learnt from its row. Repeated rows give repeated results, an empty table none;
    no column but id, text and lang is read, and lang is read in the rows that are learnt from only.
    """
    model = fit_languages(docs, folds=folds, held_out=held_out, max_texts=max_texts)
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out")
    if model is None:
        return docs.select("doc_id", held, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            told = [i for i, t in enumerate(texts) if t is not None]
            best, share = shared.value.predict([texts[i] for i in told])
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for i, name, score in zip(told, best, share):
                names[i], scores[i] = name, score
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return docs.select("doc_id", held, F.when(has_letter(F.col("text")), F.col("text")).alias("text")).mapInArrow(run, schema)
