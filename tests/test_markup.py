"""Text of pages: literal cases that follow from the parser's rules, and time in proportion to the page."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from textlathe.functions.markup import visible_text
from textlathe.functions.text import html_to_text

CASES = [
    ('<a title="a > b">x</a>', "x"),
    ("a < b and c > d", "a < b and c > d"),
    ("<p>1 <2 & 3>2</p>", "1 <2 & 3>2"),
    ("<p> a <b> b </b>\n c</p>", "a b c"),
    ("<p>a&nbsp;</p><p>&nbsp;</p><p>b &amp;lt; &#233;&#xe9; &copy</p>", "a b &lt; éé ©"),
    ("<!doctype html><!-- no --><p>a<!-- <b>no</b> -->b</p><?pi no?>", "a b"),
    ("<p>a</p><!-- open", "a <!-- open"),
    ("<p>a</p><!-- open <b>b</b>", "a <!-- open <b>b"),
    ("<script>if (a < b) '<p>no</p>'</script><style>p > a {}</style>x", "x"),
    ("<SCRIPT>no</SCRIPT >y<script src=a />z", "y z"),
    ("<template><p>no</p></template><div><template>no</div>yes", "yes"),
    ("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>字", "漢 字"),
    ("<![CDATA[a < b]]> c <![if IE]>d<![endif]>", "a < b c d"),
    ("a<br>b<br/>c<img alt='no'>d", "a b c d"),
    ("<a href='x>y</a> z", "<a href='x>y z"),
    ("x<a href=y", "x<a href=y"),
    ("no markup  at all ", "no markup  at all"),
    ("", ""),
    (None, None),
    ("<title>t</title><textarea>u <b>v</b></textarea>", "t u v"),
    ("&amp;lt;p&amp;gt;", "&lt;p&gt;"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_cases(page, text):
    assert visible_text(page) == text


def test_column(spark):
    rows = spark.createDataFrame([(i, page) for i, (page, _) in enumerate(CASES)], "id int, page string").repartition(3)
    found = {r["id"]: r["text"] for r in rows.select("id", html_to_text(F.col("page")).alias("text")).collect()}
    assert found == {i: text for i, (_, text) in enumerate(CASES)}
    assert rows.where("id = 3").select(html_to_text(F.col("page"), "|")).first()[0] == "a|b|c"


@pytest.mark.parametrize(("page", "text"), [
    ("<title>a&amp;&amp</title>", "a&&amp"), ("<p>&copy &copy; &#233 &#233; &#xe9; &notit; &no;</p>", "&copy © &#233 é é &notit; &no;"),
    ("<p>\ue000&amp &</p>", "\ue000&amp &"), ("<![CDATA[a &amp; &b]]><p title='&amp'>&lt</p>&gt", "a &amp; &b &lt &gt"), ("&amp", "&amp"), (None, None),
])
def test_references_without_their_semicolon_can_stay(page, text):
    assert visible_text(page, open_references=False) == text


def test_pages_that_end_a_title_in_an_open_reference_agree_with_sql(spark, tmp_path):
    import duckdb

    from textlathe import plans

    spark.createDataFrame([(1, "u", "<title>a&amp;&amp</title><p>b &lt; c"), (2, "u", "<p>d &copy; &copy</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = plans.QUERIES["html_to_text"](spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["text"]) for r in got) == sorted(con.execute(plans.ORACLES["html_to_text"]).fetchall())


@pytest.mark.parametrize("piece", ["<a ", "<a href='", "<!--", "<!-- x> ", '<a x=">" ', "<![CDATA[", "<![CDATA[ x> ", "</", "</a ", "<", "&#", "&", "<?", "<!x", "<script>", "<p", "<b>x", "<a title=\"o>'"])
def test_pages_of_unfinished_markup_take_time_in_proportion(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    visible_text(page)
    visible_text(page + ">")
    assert time.perf_counter() - start < 8
