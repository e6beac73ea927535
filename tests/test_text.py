"""Labels against the decomposition of the Unicode tables."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F

from textlathe.functions.text import rel_type, several


def plainly(label: str) -> str:
    flat = "".join(x for x in unicodedata.normalize("NFKD", label) if not unicodedata.combining(x))
    name = re.sub("[^a-zA-Z0-9]+", "_", flat).strip("_").upper()
    return "RELATED_TO" if not name else f"R_{name}" if name[0].isdigit() else name


def test_labels_of_all_decompositions(spark):
    chars = [c for c in map(chr, range(0x20, 0x20000)) if unicodedata.decomposition(c) and not 0xD800 <= ord(c) < 0xE000]
    labels = [f"x {''.join(chars[i : i + 5])} y" for i in range(0, len(chars), 5)] + ["½ cup", "ﬁnal", "№5", "⑩", "đ", "sửa đổi bởi", "", "…", "Ǆ-b", "㎏"]
    rows = spark.createDataFrame([(x,) for x in labels], "label string").repartition(4)
    wrong = [(r["label"], r["name"]) for r in rows.select("label", rel_type(F.col("label")).alias("name")).collect() if r["name"] != plainly(r["label"])]
    assert not wrong and len(several()) > 100


def test_results_of_a_large_batch_are_given_back_in_slices():
    import pandas as pd

    from textlathe.functions.text import SLICE, by_slices

    got = list(by_slices(iter([pd.Series(range(1000)), pd.Series([], dtype=object), pd.Series([7])]), str))
    assert max(map(len, got)) <= SLICE and [x for part in got for x in part] == [*map(str, range(1000)), "7"]
