"""Token counts: Arrow batches are encoded in groups of about equal bytes and only lengths come back.

Texts are split at safe boundaries, and of the words between them each different one is encoded once per group.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A byte-level BPE never joins what stands before a single space between two visible characters with what follows.
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
#: All places where a text may be cut. The pattern that such a tokenizer splits by takes runs of letters and of numbers
#: whole, with a space before them at most, and looks ahead only within white space. So one piece ends, and the other
#: begins by itself, also after a letter or number that something else but white space follows, and after a single line
#: end or tab between visible characters.
CUTS = regex.compile(r"(?<=\S) (?=\S)|(?<=\S[\n\t])(?=\S)|(?<=\p{L})(?=[\p{P}\p{S}\p{N}])|(?<=\p{N})(?=[\p{P}\p{S}\p{L}])")

Counter = Callable[[list[str]], list[int]]


def pieces(text: str, size: int, whole: tuple[str, ...] = ()) -> Iterator[str]:
    """The text in pieces of about `size` characters, cut only where the tokens on both sides stay as they are, and not
    within one of the strings `whole`; a stretch without such a place stays in one piece."""
    start = 0
    while len(text) - start > size:
        at = next((m.start() for m in CUTS.finditer(text, start + size) if not any(0 <= text.find(w, max(0, m.start() - len(w) + 1), m.start() + len(w) - 1) < m.start() for w in whole)), None)
        if at is None:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def utf8_length(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


class WordCounts:
    """Token counts of words that follow a safe boundary, so with a space before them; forgets all when they get many."""

    def __init__(self, counter: Counter, most_chars: int = 1 << 23):
        self.counter, self.most_chars, self.known, self.chars = counter, most_chars, {}, 0

    def count(self, texts: list[str]) -> list[int]:
        """The numbers of tokens of some texts, which may begin with a space."""
        split = [BOUNDARY.split(text) for text in texts]
        new = list({word for words in split for word in words[1:]}.difference(self.known))
        for word, n in zip(new, self.counter([f" {word}" for word in new]) if new else (), strict=True):
            self.known[word] = n
        heads = self.counter([words[0] for words in split])
        out = [head + sum(map(self.known.__getitem__, words[1:])) for head, words in zip(heads, split, strict=True)]
        self.chars += sum(map(len, new))
        if self.chars > self.most_chars:
            self.known, self.chars = {}, 0
        return out


def load_counter(path: str) -> tuple[Counter, bool, tuple[str, ...]]:
    """A function from texts to token counts, whether texts may be cut at CUTS, and the strings that must stay whole.

    `.json`: tokenizers, with special strings in a text taken as the library does by default; `.model`: sentencepiece.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], False, ()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    byte_level = type(model.pre_tokenizer).__name__ == "ByteLevel" and not model.pre_tokenizer.add_prefix_space and model.normalizer is None
    added = model.get_added_tokens_decoder().values()
    plain = not any(t.lstrip or t.rstrip or t.single_word or " " in t.content for t in added)
    return lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)], byte_level and plain, tuple(t.content for t in added)


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, batch_bytes: int = 1 << 20, piece_chars: int = 1 << 15) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` of each row.

    A null text counts as empty: 0 bytes, 0 tokens. Long texts are cut where tokens end, encoded piece by piece in batches
    of about `batch_bytes` bytes, and summed, so that a text needs the memory of one batch; only an unbroken run of
    letters, of signs or of white space is longer than a piece, and texts of a tokenizer that is no byte-level BPE stay
    whole. Repeated rows give repeated results, an empty table none; other columns are not read.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, may_cut, whole = load_counter(tokenizer)
        count = WordCounts(counter).count if may_cut else counter
        for batch in batches:
            counts, owner, group, held = [0] * batch.num_rows, [], [], 0
            for row, text in enumerate(batch.column(1).to_pylist()):
                for piece in (pieces(text, piece_chars, whole) if may_cut else [text]) if text else ():
                    owner.append(row)
                    group.append(piece)
                    held += utf8_length(piece)
                    if held >= batch_bytes:
                        for at, n in zip(owner, count(group), strict=True):
                            counts[at] += n
                        owner, group, held = [], [], 0
            for at, n in zip(owner, count(group) if group else [], strict=True):
                counts[at] += n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return read.mapInArrow(encode, schema).withColumn("over_limit", F.col("n_tokens") > limit)
