"""Fill-in-the-middle: texts cut into prefix, middle and suffix at random units, and put together in another order.

The cutting is bit-parallel. A text's bytes become the bits of one big integer, the first byte its highest bit: a byte
table tells which bytes are of the unit's class, shifts and boolean operations leave one bit where each unit begins, the
number of set bits is the number of units, and the place of the k-th one is found by halving the integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the output form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Of each byte, `1` if it begins a code point: all but those from 0x80 to 0xBF do.
LEADS = bytes(ord("0") if 0x80 <= b <= 0xBF else ord("1") for b in range(256))
#: Of each byte, `1` if it belongs to a word: all but space and 0x09 to 0x0D do.
SOLID = bytes(ord("0") if b == 0x20 or 0x09 <= b <= 0x0D else ord("1") for b in range(256))


def class_mask(data: bytes, table: bytes) -> int:
    """The bytes as bits, by a table of `0` and `1`. Reading a number of base 2 takes time in proportion to its length."""
    return int(data.translate(table), 2) if data else 0


def code_point_starts(data: bytes) -> int:
    return class_mask(data, LEADS)


def word_starts(data: bytes) -> int:
    """Bytes of words whose byte before (one bit higher) is of none."""
    solid = class_mask(data, SOLID)
    return solid & ~(solid >> 1)


UNITS: dict[str, Callable[[bytes], int]] = {"code points": code_point_starts, "words": word_starts}


def place_of(mask: int, size: int, rank: int) -> int:
    """The place, from the highest of `size` bits, of the set bit with `rank` set bits before it; `size` if there are no
    more. The half that holds it is halved again, so that all steps together look at twice the bits."""
    if rank >= mask.bit_count():
        return size
    at = 0
    while size > 1:
        low = size >> 1
        high = mask >> low
        before = high.bit_count()
        if rank < before:
            mask, size = high, size - low
        else:
            mask, rank, at, size = mask & ((1 << low) - 1), rank - before, at + size - low, low
    return at


def draws(doc_id: object, seed: int = 1) -> list[int]:
    """Four numbers below 2**32 that depend on the id alone; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def cut_text(data: bytes, doc_id: object, unit: str = "code points", seed: int = 1) -> tuple[int, str, int | None, int | None, bytes]:
    """The number of units, the form, the units of prefix and middle (null if plain), and the output."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    starts = UNITS[unit](data)
    n = starts.bit_count()
    if not data or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, data
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (place_of(starts, len(data), k) for k in (first, second))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", first, second - first, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", first, second - first, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "code points", seed: int = 1) -> DataFrame:
    """`doc_id, n, form, prefix_chars, middle_chars, output` of each row, from its whole text: one map, no shuffle.

    `unit` is what is counted and never cut: code points, or words (runs of other characters than space and U+0009 to
    U+000D; what stands before the first word then belongs to the prefix). `seed` stands before the id in what is hashed.
    A null text counts as empty, and an empty one is plain; so are texts that hold one of the three marks. Long texts are
    cut in time in proportion to their length. A null id counts as an empty one; repeated rows give repeated results, an
    empty table none; no column but id and text is read.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [cut_text(data or b"", i, unit, seed) for i, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())]
            columns = [pa.array(values, kind) for values, kind in zip(zip(*made) if made else [[]] * len(types), types)]
            columns[-1] = pa.array([m[-1] for m in made], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of some form was made of, by native functions: the marks of a transformed output part it
    into three, as the text holds none."""
    parts = lambda marks: F.split(F.substring(output, 4, 2**31 - 1), marks)
    psm, spm = parts("<S>|<M>"), parts("<P>|<M>")
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def infill_digests(docs: DataFrame, **params) -> DataFrame:
    """The rows of `fill_in_middle` with the SHA-256 of the output, and of the text rebuilt from output and form, in place
    of the output."""
    made = fill_in_middle(docs, **params)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
