"""Fill-in-the-middle: against SQL, against slices of strings, and as an exact round trip."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from textlathe.llm import infill as I
from textlathe.llm.queries import ORACLES, QUERIES

from tests.compare import both, connect


def plainly_cut(text: str, doc_id: object) -> tuple:
    """By slices of the string."""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_same_rows_as_sql(spark, sf_dir):
    ours, theirs = both(QUERIES["op11_infill"](spark, sf_dir), connect(sf_dir), ORACLES["op11_infill"])
    assert ours == theirs


def test_ranks_by_halving():
    rng = random.Random(1)
    for size in [0, 1, 2, 3, 7, 8, 64, 65, 1000]:
        for density in (0.0, 0.1, 0.9, 1.0):
            bits = [rng.random() < density for _ in range(size)]
            mask = int("".join("01"[b] for b in bits) or "0", 2)
            places = [i for i, b in enumerate(bits) if b]
            assert [I.place_of(mask, size, k) for k in range(len(places) + 2)] == [*places, size, size]


def test_texts_of_all_alphabets():
    rng = random.Random(2)
    for i in range(3000):
        text = "".join(rng.choice("aé漢😀 \n<PSM>\x80߿ࠀ\U0010ffff") for _ in range(rng.randrange(40)))
        n, form, prefix, middle, output = I.cut_text(text.encode(), i)
        assert (n, form, prefix, middle, output.decode()) == plainly_cut(text, i)


def test_units_of_words():
    text = "\t one  tẅo\nthree 漢 "
    words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    for i in range(200):
        n, form, prefix, middle, output = I.cut_text(text.encode(), i, "words")
        assert n == len(words)
        if form == "psm":
            starts = [*(m.start() for m in words), len(text)]
            a, b = starts[prefix], starts[prefix + middle]
            assert output.decode() == f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_odd_rows(spark, odd):
    extra = spark.createDataFrame([(20, "<P", None, None, 1, None, 1), (21, "a <M> b", None, None, 1, None, 1), (22, ">" * 9 + "<" * 9, None, None, 1, None, 1)], odd.schema)
    rows = odd.unionByName(extra)
    texts = sorted(((r["doc_id"], r["text"] or "") for r in rows.collect()), key=repr)
    made = I.fill_in_middle(rows)
    whole = made.withColumn("restored", I.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r["doc_id"], r["restored"]) for r in whole), key=repr) == texts
    assert sorted((tuple(r)[:6] for r in made.collect()), key=repr) == sorted(((i, *plainly_cut(t, i)) for i, t in texts), key=repr)
    assert {r["form"] for r in whole if r["doc_id"] in (1, 2, 21)} == {"plain"}
    assert I.infill_digests(rows.limit(0)).count() == 0


@pytest.mark.parametrize("unit", list(I.UNITS))
def test_long_texts_take_time_in_proportion(unit):
    def took(size: int) -> float:
        data, best = ("wörd " * (size // 6)).encode(), []
        for _ in range(3):
            start = time.perf_counter()
            I.cut_text(data, 7, unit)
            best.append(time.perf_counter() - start)
        return min(best)

    assert took(8_000_000) < 20 * took(1_000_000) + 0.05
