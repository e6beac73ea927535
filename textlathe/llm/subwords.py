"""Character n-grams of words, hashed to buckets; all in numpy, over many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SIZES = (3, 4, 5)
BUCKETS = 1 << 18
#: Characters that end a word like white space does.
STOPS = ".,;:?()[]{}\"*#%&|… "
CHUNK = 1 << 19


def boundary(codes: np.ndarray) -> np.ndarray:
    """Where a character separates words."""
    ends = codes <= 32
    for stop in STOPS:
        ends |= codes == ord(stop)
    return ends


def texts_in_chunks(texts: Iterable[str | None]) -> Iterator[tuple[str, list[int], list[int]]]:
    """The texts in lower case, joined to chunks of some CHUNK characters: the chunk, the number of the text of each
    part of it, and where each part starts. Long texts go on in the next chunk after a space where they have one."""
    parts: list[str] = []
    owner: list[int] = []
    starts: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        at = 0
        while at < len(text) or at == 0:
            cut = at + CHUNK
            if cut < len(text):
                space = text.rfind(" ", at + 1, cut)
                cut = space + 1 if space > 0 else cut
            part = text[at:cut]
            owner.append(i)
            starts.append(held)
            parts += [part, "\n"]
            held += len(part) + 1
            at = cut
            if held >= CHUNK:
                yield "".join(parts), owner, starts
                parts, owner, starts, held = [], [], [], 0
            if not text:
                break
    if parts:
        yield "".join(parts), owner, starts


def grams(chunk: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all n-grams of all words of a chunk: the bucket and the place of the word's first character; then the place of
    each word's first character and how many n-grams it has. The bounds of a word count as characters of its n-grams."""
    codes = np.frombuffer(("\n" + chunk).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = boundary(codes)
    inner = ~ends
    starts = np.flatnonzero(inner[1:] & ends[:-1]) + 1
    word = np.cumsum(inner & np.concatenate(([True], ends[:-1]))) - 1  # of each character in a word
    mixed = np.where(ends, np.uint64(1), codes.astype(np.uint64) + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    found, owner = [], []
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        ok = inner[1 : 1 + m].copy()
        for j in range(2, n - 1):
            ok &= inner[j : j + m]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ mixed[at + j]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        found.append((h % np.uint64(BUCKETS)).astype(np.int64))
        owner.append(word[at + 1])
    buckets, owners = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, owner))
    return buckets, owners, starts - 1, np.bincount(owners, minlength=len(starts))


def bag(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as sparse rows `row, bucket, value`: the mean over a text's words of the mean over a word's n-grams."""
    rows, cols, values, words = [], [], [], np.zeros(0)
    for chunk, owner, starts in texts_in_chunks(texts):
        buckets, owners, first, per_word = grams(chunk)
        text_of_word = np.asarray(owner)[np.searchsorted(starts, first, "right") - 1]
        words = np.concatenate((words, np.zeros(max(0, owner[-1] + 1 - len(words)))))
        words += np.bincount(text_of_word[per_word > 0], minlength=len(words))
        key, inverse = np.unique(text_of_word[owners] * BUCKETS + buckets, return_inverse=True)
        rows.append((key // BUCKETS).astype(np.int32))
        cols.append((key % BUCKETS).astype(np.int32))
        values.append(np.bincount(inverse, weights=1.0 / per_word[owners], minlength=len(key)).astype(np.float32))
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    row, col, value = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
    return row, col, value / words.astype(np.float32)[row]


def mean_weights(texts: Iterable[str | None], weights: np.ndarray, n: int) -> np.ndarray:
    """Of each of `n` texts, the mean over its words of the mean weight of a word's n-grams; 0 without words."""
    total, words = np.zeros(n), np.zeros(n)
    for chunk, owner, starts in texts_in_chunks(texts):
        buckets, owners, first, per_word = grams(chunk)
        has = per_word > 0
        per = np.bincount(owners, weights=weights[buckets], minlength=len(first))[has] / per_word[has]
        text_of_word = np.asarray(owner, np.int64)[np.searchsorted(starts, first, "right") - 1][has]
        total += np.bincount(text_of_word, weights=per, minlength=n)
        words += np.bincount(text_of_word, minlength=n)
    return np.divide(total, words, out=np.zeros(n), where=words > 0)
