"""Scalar text functions as native columns; Unicode classes throughout, as the corpus is Vietnamese."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .markup import visible_text

# Headings that begin an attached document, and notices that are no content.
PART_HEADINGS = (r"QUY\s*ĐỊNH\s*:", r"QUY\s*CHẾ\s*:", r"NỘI\s*QUY\s*:", r"ĐIỀU\s*LỆ\s*:", r"QUY\s*TRÌNH\s*:")
NOTICES = ("xem file đính kèm", "có file đính kèm", "có văn bản đính kèm", "văn bản đính kèm", "văn bản mật")
NOTICE_MAX_CHARS = 40
GAP = " [...] "
#: Of how many values results are given back at once by functions in Python.
SLICE = 256


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def present(pieces: Column) -> Column:
    """An array of texts, stripped, without empty ones."""
    return F.filter(F.transform(pieces, strip), lambda x: x != "")


def clean_noise(c: Column, line_ends: bool = True) -> Column:
    """Leaders become a gap mark, runs of blanks one space, blank lines one; null becomes empty.

    `line_ends` (the second version) also turns CRLF and CR into LF.
    """
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\.{4,}|_{4,}", GAP)
    if line_ends:
        c = F.regexp_replace(c, r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\n[ \t]*\n+", "\n\n"))


def is_notice(c: Column, empty: bool = True) -> Column:
    """Whether a text is only a notice such as 'see the attached file'; `empty` is the answer for an empty text."""
    flat = F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))
    alternatives = "|".join(n.replace(" ", r"\s+") for n in NOTICES)
    matched = (F.length(flat) <= NOTICE_MAX_CHARS) & ~flat.rlike(r"\d") & flat.rlike(rf"(?iu)^\(?\s*(?:{alternatives})\s*\)?$")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(empty)).otherwise(matched)


def article_number(c: Column, version: int = 2) -> Column:
    """The number of the article that a text begins with, else null."""
    start = r"(?iuU)^\s*" if version == 2 else r"(?U)^"
    return F.nullif(F.regexp_extract(c, start + r"Điều\s+(\d+[a-zA-Z]?)\b", 1), F.lit(""))


def parse_articles(c: Column) -> Column:
    """A comma-separated list as an array, trimmed, without empty entries; null gives an empty array."""
    return F.coalesce(present(F.split(c, ",")), F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")).cast("long")


def issue_date(c: Column) -> Column:
    """A day-first date; null for what is none."""
    return F.try_to_timestamp(c, F.lit("d/M/yyyy")).cast("date")


def normalize_id(c: Column, kind: str) -> Column:
    """An id as text: integral floating numbers without a fraction, strings stripped and otherwise unchanged."""
    if kind in ("double", "float"):
        return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return strip(c.cast("string"))


@cache
def bases() -> tuple[str, str]:
    """The characters whose compatibility decomposition is one ASCII letter or digit with marks, and that character."""
    pairs = []
    for code in range(0x80, 0x20000):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            pairs.append((chr(code), plain))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


@cache
def several() -> dict[str, str]:
    """The characters whose compatibility decomposition has ASCII letters or digits among several characters, and that
    with `_` for each other character."""
    out = {}
    for code in range(0x80, 0x20000):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(plain) > 1 and any(x.isascii() and x.isalnum() for x in plain):
            out[chr(code)] = "".join(x if x.isascii() and x.isalnum() else "_" for x in plain)
    return out


def ascii_base(c: Column, map_d: bool = False) -> Column:
    """Letters and digits without their marks, compatibility forms as plain ones, those of several characters too (with `_`
    for what is no letter or digit); `đ` stays as it is unless `map_d`. Texts without characters that decompose to several
    are not taken apart."""
    marked, plain = bases()
    if map_d:
        marked, plain = marked + "đĐ", plain + "dD"
    pairs = F.str_to_map(F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in several().items())), F.lit("\u0001"), F.lit("\u0002"))
    letters = F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), lambda x: F.coalesce(F.try_element_at(pairs, x), x))
    whole = F.when(F.translate(c, "".join(several()), "") != c, F.array_join(letters, "")).otherwise(c)
    return F.regexp_replace(F.translate(whole, marked, plain), r"\p{M}+", "")


def rel_type(c: Column, map_d: bool = False) -> Column:
    """A relationship label as an identifier: letters and digits in upper case, joined by `_`; empty ones become
    RELATED_TO, and those that begin with a digit get the prefix `R_`."""
    joined = F.regexp_replace(ascii_base(F.coalesce(c, F.lit("")), map_d), r"[^a-zA-Z0-9]+", "_")
    name = F.upper(F.regexp_replace(joined, r"^_+|_+$", ""))
    return F.when(name == "", F.lit("RELATED_TO")).when(name.rlike(r"^\d"), F.concat(F.lit("R_"), name)).otherwise(name)


def by_slices(batches: Iterator[pd.Series], f: Callable) -> Iterator[pd.Series]:
    """`f` of each value, given back some hundred values at a time: a batch of Spark has thousands of rows, and what is made
    of them need not be held beside them."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.iloc[at : at + SLICE].map(f)


def html_to_text(c: Column, separator: str = " ", open_references: bool = True) -> Column:
    """Visible text nodes, decoded and stripped, joined by `separator`; pages are parsed in Arrow batches. References
    without their semicolon are decoded if `open_references`."""

    @F.pandas_udf(T.StringType())
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return by_slices(batches, lambda page: visible_text(page, separator, open_references))

    return parsed(c)


def preview(c: Column, size: int = 1000) -> Column:
    """The first `size` characters of a text."""
    return F.substring(c, 1, size)


def part_pieces(c: Column) -> Column:
    """The main document and its attached documents, each from its heading on."""
    return present(F.split(c, "(?U)(?=" + "|".join(PART_HEADINGS) + ")"))


def article_pieces(c: Column, version: int = 2) -> Column:
    """Pieces that begin with an article: at line starts (2), or wherever a number and a mark follow the word (1)."""
    at = r"(?iuU)(?=(?:^|\n)\s*Điều\s+\d+)" if version == 2 else r"(?U)(?=Điều\s+\d+[a-zA-Z]?(?!\.\d)\s*[:.])"
    return present(F.split(c, at))


def clause_pieces(c: Column) -> Column:
    return present(F.split(c, r"(?U)(?=\n\s*(?:\d+[.)]|[a-zA-ZđĐ][.)])\s)"))


def paragraph_pieces(c: Column) -> Column:
    return present(F.split(c, r"(?U)\n\s*\n+"))


def tokens(c: Column) -> Column:
    """Search terms: runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
