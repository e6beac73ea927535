"""Substring dedup: removal of word spans that occur before, in a reference or in the corpus itself.

Both forms stream words past suffix automata and cut what the matching statistics show. `remove_known` broadcasts the
automata of a bounded reference to all tasks. In `remove_repeats` the reference is the corpus, so neither a broadcast nor
a pass over all documents for each shard would be bounded. There, every window of words chooses one of its 10-grams (the
least by hash; equal windows choose equal ones), 10-grams chosen only once are left out with their windows, and the
passages around each of the others are dealt to shards by that 10-gram. A shard holds an automaton of the passages that
share a 10-gram; each passage is streamed past it in the order of the corpus, then added. So every passage meets just the
shard that can hold its windows, words are compared as words, and nothing is lost.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, written

GRAM = 10
#: A task works on blocks of about so many characters of text.
BLOCK_CHARS = 6_000_000
#: A bucket or shard has about so many bytes of text.
PART_BYTES = 32_000_000
#: One in so many documents is looked at for 10-grams that very many windows choose, this often at least.
SAMPLE, LEAST_SHARED = 32, 256
NULL_ID = -(1 << 63)
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE_FACTOR, WORD_FACTOR = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
WHITE = re.compile(rb"[\x20\x09-\x0D]+")


class SuffixAutomaton:
    """The suffix automaton of sequences of words; words that no sequence has are unknown to it."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        """Adds one sequence; matches do not run from one sequence into the next."""
        last = 0
        for word in words:
            if word in self.next[last]:
                q = self.next[last][word]
                last = q if self.length[q] == self.length[last] + 1 else self.cloned(last, word, q)
                continue
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self.cloned(p, word, q)
            last = new

    def cloned(self, p: int, word: bytes, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def matches(self, words: list[bytes]) -> Iterator[int]:
        """The matching statistics: at each word, how many words up to it occur as such in a sequence."""
        state, n = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if word in self.next[state]:
                state, n = self.next[state][word], n + 1
            else:
                state, n = 0, 0
            yield n


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def remove_known(docs: DataFrame, reference: DataFrame, *, text_col: str = "text", size: int = 20, shard_words: int = 500_000, max_shards: int = 8) -> DataFrame:
    """`docs` with two more columns: `kept` (the words outside all spans of at least `size` words that occur in a text of
    `reference`, joined by spaces) and `n_removed`.

    The reference is cut into shards of about `shard_words` words, each an automaton and a broadcast variable of its own;
    it must fit in `max_shards` of them, else ValueError. Null texts have no words; repeated rows are kept as such.
    """
    spark = docs.sparkSession
    total = reference.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    if total > 8 * shard_words * max_shards:
        raise ValueError(f"the reference has {total} bytes: too large to be broadcast; use remove_repeats on both together")
    shards, filled = [], shard_words
    for row in reference.select(text_col).toLocalIterator():
        if filled >= shard_words:
            shards.append(SuffixAutomaton())
            filled = 0
        words = words_of(row[0])
        shards[-1].add(words)
        filled += len(words)
    shared = [spark.sparkContext.broadcast(shard) for shard in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text in batch.column(text_col).to_pylist():
                words = words_of(text)
                cover = np.zeros(len(words) + 1, np.int64)
                for shard in shared:
                    for end, n in enumerate(shard.value.matches(words)):
                        if n >= size:
                            cover[end + 1 - n] += 1
                            cover[end + 1] -= 1
                keep = np.cumsum(cover)[:-1] == 0
                kept.append(b" ".join(w for w, k in zip(words, keep) if k).decode("utf-8", "surrogatepass"))
                removed.append(int((~keep).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.string()), pa.array(removed, pa.int64())], names=[*batch.schema.names, "kept", "n_removed"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("kept", T.StringType()), T.StructField("n_removed", T.LongType())]))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


class Block:
    """Some documents, or pieces of them, as one array of word hashes and one of bytes with single spaces. `bases`: the
    number of the first word of each piece in its document."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray, bases: np.ndarray, texts: list[bytes]):
        self.keys, self.prints, self.bases = keys, prints, bases
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        inner = ~SPACE[data]
        edges = np.flatnonzero(np.diff(inner, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(starts, bounds)  # of each document, its first word
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        # a word's hash: its bytes as the digits of a number, times a power that depends on their place in the word
        longest = int((ends - starts).max()) if len(starts) else 0
        powers = np.concatenate(([U(1)], np.cumprod(np.full(max(longest, 1), BYTE_FACTOR))))
        place = self.places(data, starts)
        digits = powers[np.minimum(place, longest, out=place)]  # in place: the largest arrays of a task
        del place
        digits *= data + np.uint16(1)
        digits *= inner
        self.words = mixed(np.add.reduceat(digits, starts) + (ends - starts).astype(U)) if len(starts) else np.zeros(0, U)
        del digits
        kept = inner.copy()
        kept[ends] = True  # the first white space after each word; a text always has one after its last
        self.text = np.where(inner, data, np.uint8(32))[kept].tobytes()
        self.at_byte = np.concatenate(([0], np.cumsum(ends - starts + 1)))

    @staticmethod
    def places(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        kind = np.int32 if len(data) < 1 << 31 else np.int64
        at = np.zeros(len(data), kind)
        if len(starts):
            at[starts[0] :] = np.arange(len(data) - starts[0], dtype=kind)
            at[starts[0] :] -= np.repeat((starts - starts[0]).astype(kind), np.diff(np.concatenate((starts, [len(data)]))))
        return at

    def start(self, at: np.ndarray) -> np.ndarray:
        """Of words by number, the number within their document."""
        return at - self.first[self.doc[at]] + self.bases[self.doc[at]]

    def windows(self, size: int) -> np.ndarray:
        """The first words of all windows of `size` words of one document."""
        n = max(0, len(self.words) - size + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[len(self.words) - n :])

    def chosen(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows, the place of the least 10-gram of each (of equal ones the first), and the hashes of all 10-grams."""
        at = self.windows(size)
        grams = mixed(rolled(self.words, GRAM, WORD_FACTOR))
        if not len(at):
            return at, at, grams
        least, place = grams, np.arange(len(grams))

        def narrowed(by: int) -> tuple[np.ndarray, np.ndarray]:
            """The lesser of each value and the one `by` places on, the first of equal ones, with its place."""
            n = len(least) - by
            later = least[by:] < least[:n]
            return np.where(later, least[by:], least[:n]), np.where(later, place[by:], place[:n])

        span, width = size - GRAM + 1, 1
        while 2 * width <= span:
            least, place = narrowed(width)
            width *= 2
        if width < span:
            least, place = narrowed(span - width)
        return at, place[at], grams

    def passage(self, first: int, n: int) -> bytes:
        """`n` words from one on, with single spaces."""
        return self.text[self.at_byte[first] : self.at_byte[first + n] - 1]


def rolled(words: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """Of each run of n words, sum of word[i] * factor**(n - 1 - i)."""
    if len(words) < n:
        return np.zeros(0, U)
    done, width, out, power = None, 1, words, factor  # power: factor ** width
    need, total_width = n, 0
    while need:
        if need & 1:
            if done is None:
                done, total_width = out, width
            else:
                m = len(words) - total_width - width + 1
                done = out[:m] * step(factor, total_width) + done[width : width + m]
                total_width += width
        need >>= 1
        if need:
            m = len(words) - 2 * width + 1
            out = out[:m] * power + out[width : width + m]
            width *= 2
            power = step(factor, width)
    return done


def step(factor: np.uint64, n: int) -> np.uint64:
    return U(pow(int(factor), n, 1 << 64))


def pieces(data: bytes, overlap: int) -> Iterator[tuple[int, bytes]]:
    """A text in pieces of about BLOCK_CHARS bytes that share `overlap` words with the one before, and the number of the
    first word of each: every window of `overlap` + 1 words lies in just one."""
    base = start = 0
    stop = BLOCK_CHARS
    while len(data) - start > BLOCK_CHARS and (gap := WHITE.search(data, stop)):
        piece = data[start : gap.start()]
        n = len(piece.split())
        stop = gap.end() + BLOCK_CHARS
        if n <= overlap:  # few and very long words: the piece goes on
            continue
        yield base, piece
        base, start = base + n - overlap, gap.start()
        for _ in range(overlap):  # back over white space and a word
            while SPACE[data[start - 1]]:
                start -= 1
            while not SPACE[data[start - 1]]:
                start -= 1
    yield base, data[start:]


def blocks(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[Block, list[np.ndarray]]]:
    """Blocks of documents in the order of their keys and prints, and the marked places of each document (`marks`, if
    given). Rows of one key and print are one document; a block has it once. Long texts are blocks of pieces."""
    held: list[tuple[int, int, int, bytes, np.ndarray | None]] = []
    seen: set[tuple[int, int]] = set()
    size = 0

    def ended() -> tuple[Block, list[np.ndarray]]:
        order = sorted(range(len(held)), key=lambda i: held[i][:3])
        rows = [held[i] for i in order]
        return Block(*(np.array([r[c] for r in rows], np.int64) for c in range(3)), [r[3] for r in rows]), [r[4] for r in rows]

    for batch in batches:
        given = batch.column("marks") if "marks" in batch.schema.names else None
        for i, (key, given_print, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("print").to_pylist(), batch.column("text").to_pylist())):
            if (key, given_print) in seen:
                continue
            data = (text or "").encode("utf-8", "surrogatepass")
            marks = given[i].values.to_numpy() if given is not None else None
            for base, piece in pieces(data, overlap):
                if size and size + len(piece) > BLOCK_CHARS:
                    yield ended()
                    held, size = [], 0
                    seen.clear()
                held.append((key, given_print, base, piece, marks))
                size += len(piece)
            seen.add((key, given_print))
    if held:
        yield ended()


#: What meets: `part` says where; the arrays travel as bytes. `words` has a passage a line.
ARRAYS = ["hashes", "keys", "prints", "places", "known_keys", "known_prints", "known_places", "many", "words"]
MET = "part int, " + ", ".join(f"{n} binary" for n in ARRAYS)
#: What is found at places of documents, packed by the documents' buckets: at most one row for each part and bucket.
FOUND = "bucket int, keys binary, prints binary, places binary"
#: A run of windows as one number: its first word times this, and how many windows it has.
RUN = 1 << 12


def packed(part: int, **columns: np.ndarray | bytes) -> dict:
    return {"part": part} | {k: v if isinstance(v, bytes) else v.tobytes() for k, v in columns.items()}


def sent(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r["part"] for r in rows], pa.int32()), *[pa.array([r.get(n, b"") for r in rows], pa.binary()) for n in ARRAYS]], names=["part", *ARRAYS])


def spread(parts: int, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of the hashes of each part."""
    part = (of >> U(32)) % U(parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            yield p, order[cuts[p] : cuts[p + 1]]


def bucket_of(key, print_, parts: int):
    """The bucket of a document, the same for columns and for arrays."""
    if isinstance(key, Column):
        return F.pmod(key.bitwiseXOR(F.shiftright(key, 7)).bitwiseXOR(F.shiftright(key, 19)).bitwiseXOR(print_), F.lit(parts)).cast("int")
    return ((key ^ (key >> 7) ^ (key >> 19) ^ print_) % parts).astype(np.int64)


def sizes_of(docs: DataFrame) -> tuple[int, list[tuple[int, int, int, int]]]:
    """The bytes of all texts; and `key, print, rows, bytes` of documents whose rows have over BLOCK_CHARS bytes
    together."""
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(64))
    each = docs.groupBy("key", "print").agg(F.count("*").alias("n"), size.alias("size"))
    large = F.collect_list(F.when((F.col("n") > 1) & (F.col("size") > BLOCK_CHARS), F.struct("key", "print", "n", "size")))
    row = each.agg(F.sum("size").alias("total"), large.alias("large")).first()
    return row["total"] or 0, [tuple(r) for r in row["large"]]


def numbered(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs, in the order of the pairs."""
    order = np.lexsort((prints, keys))
    k, p = keys[order], prints[order]
    out = np.zeros(len(keys), np.int64)
    out[order[1:]] = np.cumsum((k[1:] != k[:-1]) | (p[1:] != p[:-1]))
    return out


def by_bucket(keys: np.ndarray, prints: np.ndarray, places: np.ndarray, parts: int, large: list[tuple[int, int, int]]) -> pa.Table:
    bucket = bucket_of(keys, prints, parts)
    if large:  # the places in these go to each bucket that has rows of them
        deal = {(k, p): n for k, p, n in large}
        at = np.flatnonzero(np.isin(prints, np.array([p for _, p, _ in large], np.int64)))
        times = np.ones(len(keys), np.int64)
        times[at] = [deal.get(pair, 1) for pair in zip(keys[at].tolist(), prints[at].tolist())]
        again = np.repeat(np.arange(len(keys)), times)
        nth = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
        keys, prints, places, bucket = keys[again], prints[again], places[again], (bucket[again] + nth) % parts
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)) if len(keys) else np.zeros(0, np.int64)
    rows = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(keys)])]
    return pa.table([pa.array([int(bucket[i[0]]) for i in rows], pa.int32()), *[pa.array([of[i].tobytes() for i in rows], pa.binary()) for of in (keys, prints, places)]], names=["bucket", "keys", "prints", "places"])


def by_key(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The keys, each once and in order, and the places of each."""
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    cuts = np.append(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), len(keys)) if len(keys) else np.zeros(1, np.int64)
    return keys[cuts[:-1]], pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(places, pa.int64()))


def with_marks(docs: pa.Table, found: pa.Table, text_at: int) -> pa.Table:
    """`key, print, text, marks, doc` of the rows of a bucket; the marks of a document with none are null."""
    doc, found_keys = docs.column("doc").combine_chunks(), column(found, "keys", np.int64)
    pairs = numbered(np.concatenate((found_keys, docs.column("key").to_numpy())), np.concatenate((column(found, "prints", np.int64), docs.column("print").to_numpy())))
    known, lists = by_key(pairs[: len(found_keys)], column(found, "places", np.int64))
    keys = pairs[len(found_keys) :]
    at = np.searchsorted(known, keys)
    hit = at < len(known)
    hit[hit] = known[at[hit]] == keys[hit]
    return pa.table([docs.column("key"), docs.column("print"), pc.struct_field(doc, text_at), lists.take(pa.array(at, mask=~hit)), doc], names=["key", "print", "text", "marks", "doc"])


def column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def shared_grams(docs: DataFrame, size: int, share: float) -> np.ndarray:
    """10-grams that more than `share` of the windows' choices fall on, told from one in SAMPLE documents: what they have
    in common says only how their windows are dealt, not what is found. At most 1 / `share` come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in blocks(batches, size - 1):
            _, place, grams = block.chosen(size)
            values, counts = np.unique(grams[np.unique(place)], return_counts=True)
            many = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(np.append(values[many], U(0)).view(np.int64)), pa.array(np.append(counts[many], 0)), pa.array(np.append(np.zeros(many.sum(), np.int64), counts.sum()))], names=["gram", "n", "total"])

    sample = docs.where(F.pmod(F.xxhash64("key", "print"), F.lit(SAMPLE)) == 0)
    summed = sample.mapInArrow(run, "gram long, n long, total long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    summed = written(summed, "repeats-sample")
    total = summed.agg(F.sum("total")).first()[0] or 0
    hot = summed.where(F.col("n") > max(LEAST_SHARED, total * share))
    return np.sort(np.array([r["gram"] for r in hot.select("gram").collect()], np.int64).view(U))


def send_grams(size: int, parts: int) -> Callable:
    """Of each block, the chosen 10-grams: those met twice in the block are known to be repeated, of each of the others
    the place is sent along; a 10-gram travels once from a block, however often it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in blocks(batches, size - 1):
            _, place, grams = block.chosen(size)
            place = np.unique(place)
            hashes = grams[place]
            values, at, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            twice = counts[inverse] > 1
            rows = []
            for p, i in spread(parts, values):
                once = place[at[i][counts[i] == 1]]
                rows.append(packed(p, hashes=values[i][counts[i] == 1], keys=block.keys[block.doc[once]], prints=block.prints[block.doc[once]], places=block.start(once), many=values[i][counts[i] > 1]))
            known = place[twice]
            rows += known_rows(parts, block.keys[block.doc[known]], block.prints[block.doc[known]], block.start(known))
            if rows:
                yield sent(rows)

    return run


def known_rows(parts: int, keys: np.ndarray, prints: np.ndarray, places: np.ndarray) -> list[dict]:
    return [packed(p, known_keys=keys[i], known_prints=prints[i], known_places=places[i]) for p, i in spread(parts, mixed((keys ^ prints).view(U)))]


def known_columns(table: pa.Table) -> list[np.ndarray]:
    return [column(table, name, np.int64) for name in ("known_keys", "known_prints", "known_places")]


def meet_grams(table: pa.Table, parts: int, large: list[tuple[int, int, int]]) -> pa.Table:
    """Which places have a 10-gram that was chosen more than once."""
    hashes, many = column(table, "hashes", U), column(table, "many", U)
    values, counts = np.unique(np.concatenate((hashes, many, many)), return_counts=True)
    again = counts[np.searchsorted(values, hashes)] > 1 if len(hashes) else np.zeros(0, bool)
    met = [column(table, name, np.int64)[again] for name in ("keys", "prints", "places")]
    return by_bucket(*map(np.concatenate, zip(met, known_columns(table))), parts, large)


def send_passages(size: int, parts: int, text_at: int, shared: np.ndarray) -> Callable:
    """Of each block, the passages around marked 10-grams: the words of all windows that chose one. The first of equal
    ones travels, the others are known to be repeats. Where `shared` says that very many windows chose a 10-gram, they
    are passages of their own, dealt by all their words."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        out = [sent([])]
        marked_docs = with_marks(docs, found, text_at).drop_columns("doc")
        for block, marks in blocks(marked_docs.filter(pc.is_valid(marked_docs.column("marks"))).to_batches(), size - 1):
            at, place, grams = block.chosen(size)
            marked = np.zeros(len(block.words) + 1, bool)
            for i, places in enumerate(marks):
                here = places - block.bases[i]
                marked[block.first[i] + here[(here >= 0) & (here < block.first[i + 1] - block.first[i])]] = True
            chosen = marked[place]
            at, place = at[chosen], place[chosen]
            if not len(at):
                continue
            alone = np.isin(grams[place], shared)
            heads = np.flatnonzero(alone | np.concatenate(([True], (place[1:] != place[:-1]) | alone[:-1])))
            counts = np.diff(np.append(heads, len(at)))
            first, gram = at[heads], grams[place[heads]]
            gram = np.where(alone[heads], mixed(rolled(block.words, size, WORD_FACTOR))[first], gram)
            texts = [block.passage(a, n + size - 1) for a, n in zip(first.tolist(), counts.tolist())]
            known_texts: set[bytes] = set()
            known = np.array([t in known_texts or known_texts.add(t) is not None for t in texts], bool)
            keys, prints, places = block.keys[block.doc[first]], block.prints[block.doc[first]], block.start(first) * RUN + counts
            fresh = np.flatnonzero(~known)
            rows = [packed(p, hashes=gram[i], keys=keys[i], prints=prints[i], places=places[i], words=b"\n".join([texts[j] for j in i.tolist()])) for p, at_ in spread(parts, gram[fresh]) for i in [fresh[at_]]]
            out.append(sent(rows + known_rows(parts, keys[known], prints[known], places[known])))
        return pa.Table.from_batches(out)

    return run


def meet_passages(table: pa.Table, size: int, parts: int, large: list[tuple[int, int, int]]) -> pa.Table:
    """Which windows are repeats. Passages that share a 10-gram are streamed past the automaton of those before them, in
    the order of key, print and place: a window is a repeat where the matching statistic reaches its size."""
    hashes, keys, prints, places = column(table, "hashes", U), *(column(table, name, np.int64) for name in ("keys", "prints", "places"))
    texts = [t for lines in table.column("words").to_pylist() if lines for t in lines.split(b"\n")]
    order = np.lexsort((places, prints, keys, hashes))
    # rows of one document can lie in several buckets, which send the same passages
    same = [np.diff(of[order].view(np.int64), prepend=~of[order][:1].view(np.int64)) == 0 for of in (hashes, keys, prints, places)]
    order = order[~np.logical_and.reduce(same)]
    heads = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))) if len(order) else order
    ends = np.append(heads[1:], len(order))
    several = ends - heads > 1
    again, runs = [], []
    for a, b in zip(heads[several].tolist(), ends[several].tolist()):
        automaton, seen = SuffixAutomaton(), set()
        for i in order[a:b].tolist():
            place, n = divmod(int(places[i]), RUN)
            if texts[i] in seen:
                again.append(i)
                runs.append(place * RUN + n)
                continue
            words = texts[i].split(b" ")
            if seen:
                begun = -1
                for end, length in enumerate(automaton.matches(words)):
                    if length >= size and begun < 0:
                        begun = end + 1 - size
                    elif length < size and begun >= 0:
                        again.append(i)
                        runs.append((place + begun) * RUN + end + 1 - size - begun)
                        begun = -1
                if begun >= 0:
                    again.append(i)
                    runs.append((place + begun) * RUN + n - begun)
            seen.add(texts[i])
            automaton.add(words)
    at = np.array(again, np.int64)
    met = [keys[at], prints[at], np.array(runs, np.int64)]
    return by_bucket(*map(np.concatenate, zip(met, known_columns(table))), parts, large)


def kept_words(text: str | None, runs: np.ndarray | None, size: int) -> tuple[int, int, str]:
    """How many words a text has, how many of them lie in windows of some runs, and the others. Long texts are cut piece
    by piece."""
    data = (text or "").encode("utf-8", "surrogatepass")
    starts, stops = (np.zeros(0, np.int64),) * 2 if runs is None else (np.sort(runs // RUN), np.sort(runs // RUN + runs % RUN + size - 1))
    total, out, n_kept = 0, [], 0
    for base, piece in pieces(data, 0):
        words = piece.split()
        if len(starts):
            at = np.arange(base, base + len(words))
            keep = np.searchsorted(starts, at, "right") == np.searchsorted(stops, at, "right")  # as many runs begun as ended
            words = [w for w, k in zip(words, keep.tolist()) if k]
            total += len(at)
        else:
            total += len(words)
        n_kept += len(words)
        if words:
            out.append(b" ".join(words))
    return total, total - n_kept, b" ".join(out).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 20) -> DataFrame:
    """`docs` (all columns, in a struct `doc`) with `n_words`, `n_removed` and `kept`: the words outside all windows of
    `size` words whose sequence also starts earlier (in a smaller id, for one id in a text of smaller hash, or at an
    earlier place of the same text), joined by spaces. Windows are judged on the texts as given.

    Ids must be integers; a null id comes before all others. Null and empty texts, and those of fewer than `size` words,
    lose nothing. A document is known by its id and the hash of its text: rows that share an id, or have none, are
    documents of their own unless their texts are equal too; those are one document, and none of them repeats another.
    Texts of any length are read in pieces. A passage travels at most once from each block of documents, so what a third
    of all documents share does not gather in one task; nor do rows of one document, which are dealt over buckets by
    their size. There are as many buckets and shards as the bytes of the texts ask for. An empty table gives no rows.
    """
    spark = docs.sparkSession
    key, text_at = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"), docs.columns.index(text_col)
    print_ = F.xxhash64(F.col(text_col)).alias("print")
    plain = docs.select(key, print_, F.col(text_col).alias("text"))
    total, repeated = sizes_of(plain)
    parts = max(shuffle_partitions(spark), total // PART_BYTES) | 1
    large = [(k, p, min(parts, n, -(-size_ // BLOCK_CHARS))) for k, p, n, size_ in repeated]
    shared = shared_grams(plain, size, 1 / min(100_000, max(4096, 4 * parts)))
    # texts go to their buckets once; both rounds read that exchange
    texts = docs.select(key, print_, F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    bucket = bucket_of(F.col("key"), F.col("print"), parts)
    if large:
        texts = texts.join(F.broadcast(spark.createDataFrame(large, "key long, print long, deal int")), ["key", "print"], "left")
        bucket = F.pmod(bucket + F.coalesce(F.monotonically_increasing_id() % F.col("deal"), F.lit(0)), F.lit(parts)).cast("int")
    texts = texts.select(bucket.alias("bucket"), "key", "print", "doc")
    grams = plain.mapInArrow(send_grams(size, parts), MET)
    marks = grams.groupBy("part").applyInArrow(lambda table: meet_grams(table, parts, large), FOUND)
    met = texts.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(send_passages(size, parts, text_at, shared), MET)
    spans = met.groupBy("part").applyInArrow(lambda table: meet_passages(table, size, parts, large), FOUND)
    schema = T.StructType([T.StructField("doc", texts.schema["doc"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def cut(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = with_marks(rows, found, text_at)
        done = [kept_words(text.as_py(), runs.values.to_numpy() if runs.is_valid else None, size) for text, runs in zip(rows.column("text"), rows.column("marks"))]
        return pa.table([rows.column("doc"), *[pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]], names=["doc", "n_words", "n_removed", "kept"])

    return texts.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(cut, schema)


def repeat_digests(docs: DataFrame, **params) -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256` of each row."""
    done = remove_repeats(docs.select("doc_id", "text"), **params)
    return done.select("doc.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
