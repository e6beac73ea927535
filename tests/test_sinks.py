from __future__ import annotations

import glob
import html
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from textlathe.functions import text as X
from textlathe.sources.tables import drop_scratch, read_csv, scratch_path, write_checked, write_csv, write_parquet


def test_csv_has_a_mark_and_comes_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'một, "hai"\nba'), (2, None)], "id long, name string")
    write_csv(rows, f"{tmp_path}/out")
    parts = [open(p, "rb").read() for p in glob.glob(f"{tmp_path}/out/part-*")]
    assert all(p.startswith(b"\xef\xbb\xbfid,name") for p in parts if p)
    assert sorted(read_csv(spark, f"{tmp_path}/out", rows.schema).collect()) == sorted(rows.collect(), key=lambda r: r["id"])


@pytest.mark.parametrize(("label", "name"), [("5-LOW", "R_5_LOW"), ("***", "RELATED_TO"), ("được hướng dẫn", "UOC_HUONG_DAN"), (None, "RELATED_TO"), ("Ñandú Çà Ü", "NANDU_CA_U"), ("ＡＢ１", "AB1"), ("ß", "RELATED_TO")])
def test_rel_type(spark, label, name):
    assert spark.createDataFrame([(label,)], "x string").select(X.rel_type(F.col("x"))).first()[0] == name


NOTICES = {"( Xem  file đính kèm )": True, "Có văn bản đính kèm": True, "VĂN BẢN MẬT": True, "văn bản mật 2": False, "Xem file đính kèm ở trang cuối của văn bản này": False, "": True, "Điều 1. Phạm vi": False, "văn bản đính kèm": True}
NUMBERS = {"Điều 12a. Phạm vi": ("12a", "12a"), " điều 12a. x": ("12a", None), "Điều 12ạ": (None, None), "ĐIỀU 7: x": ("7", None), "Theo Điều 3": (None, None), "": (None, None)}


def test_notices_and_numbers(spark):
    one = spark.createDataFrame([(t,) for t in NOTICES], "x string").select("x", X.is_notice(F.col("x")))
    assert dict(map(tuple, one.collect())) == NOTICES
    two = spark.createDataFrame([(t,) for t in NUMBERS], "x string").select("x", X.article_number(F.col("x")), X.article_number(F.col("x"), 1))
    assert {r[0]: (r[1], r[2]) for r in two.collect()} == NUMBERS


def test_articles_v1(spark):
    rows = [(1, "Theo Điều 3. Điều 4: x"), (2, "Điều 3.4 abc"), (3, "Điều 1. a\nĐiều 2a : b"), (4, ""), (5, "điều 1. a")]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "id int, x string").select("id", X.article_pieces(F.col("x"), 1)).collect()}
    assert got == {1: ["Theo", "Điều 3.", "Điều 4: x"], 2: ["Điều 3.4 abc"], 3: ["Điều 1. a", "Điều 2a : b"], 4: [], 5: ["điều 1. a"]}


def test_all_character_references_are_decoded(spark):
    """Against the standard library's own table, by name and by number, with and without the closing mark."""
    texts = ["caf&eacute; &#8211; a &hellip;", "&NotEqualTilde; &fjlig; &#x1F600;", "&amp;lt; &ampx &copy 2024", "&nosuch; & &#; &#1; &#0;", "a&nbsp;b", "none"]
    rows = spark.createDataFrame([(t, f"<p>{t}</p><b> x</b><script>&lt;</script>") for t in texts], "t string, h string")
    got = {r["t"]: r["x"] for r in rows.select("t", X.html_to_text(F.col("h")).alias("x")).collect()}
    assert got == {t: " ".join(p for p in (html.unescape(t).strip(), "x") if p) for t in texts}
    assert spark.createDataFrame([(None,)], "h string").select(X.html_to_text(F.col("h"))).first()[0] is None


def test_scratch_tables_can_be_dropped(spark):
    path = scratch_path(spark, "gone")
    write_parquet(spark.range(3), path)
    assert drop_scratch(spark) >= 1 and not glob.glob(path)


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(session, "x")


def test_checks_of_a_write(spark):
    """Rows that break rules are kept apart, numbers come from the write, and what is written is computed once."""
    ran = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def size(text):
        ran.add(1)
        return len(text) if text is not None else None

    rows = spark.createDataFrame([(1, "ab"), (2, "abcdef"), (None, "a"), (3, None), (None, None)], "id long, text string").repartition(3)
    rules = {"short": F.col("size") <= 3, "id": F.col("id").isNotNull()}
    good, apart, seen = write_checked(rows.withColumn("size", size("text")), scratch_path(spark, "checked"), rules, {"most": F.max("size"), "chars": F.sum("size")})
    assert ran.value == 5 and seen == {"n_rows": 5, "most": 6, "chars": 9, "n_short": 3, "n_id": 2}
    assert [tuple(r) for r in good.collect()] == [(1, "ab", 2)]
    assert sorted(((r["id"], r["broken"]) for r in apart.collect()), key=repr) == sorted([(2, ["short"]), (None, ["id"]), (3, ["short"]), (None, ["short", "id"])], key=repr)
    none, gone, seen = write_checked(rows.limit(0), scratch_path(spark, "checked"), {"id": F.col("id").isNotNull()}, {"n": F.count("id")})
    assert none.count() == gone.count() == 0 and seen["n_rows"] == 0
