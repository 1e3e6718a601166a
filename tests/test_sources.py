from quarry.sources.html import html_text
from quarry.sources.pages import page_groups, page_range, pages_each


def _pages(spark, n, doc=1):
    return spark.createDataFrame([(doc, i, f"p{i};") for i in range(1, n + 1)],
                                 "doc long, page_no long, text string")


def test_page_groups_1_100_101(spark):
    for n, expect in [(1, 1), (100, 1), (101, 2)]:
        g = page_groups(_pages(spark, n), pages_per_entry=100).orderBy("entry_no").collect()
        assert len(g) == expect
        assert g[0]["text"].startswith("p1;") and g[0]["first_page"] == 1
    g = page_groups(_pages(spark, 101), pages_per_entry=100).orderBy("entry_no").collect()
    assert g[1]["text"] == "p101;" and g[0]["text"].endswith("p100;")


def test_missing_page_skipped(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "c")],
                               "doc long, page_no long, text string")
    assert page_groups(df, pages_per_entry=10).first()["text"] == "ac"
    assert [r["text"] for r in pages_each(df).orderBy("entry_no").collect()] == ["a", "c"]


def test_page_range_clamps_and_flips(spark):
    p = _pages(spark, 5)
    assert page_range(p, 2, 4).first()["text"] == "p2;p3;p4;"
    assert page_range(p, 0, 2).first()["text"] == "p1;p2;"          # below 1
    assert page_range(p, 4, 99).first()["text"] == "p4;p5;"         # above the last page
    assert page_range(p, 4, 2).first()["text"] == "p2;p3;p4;"       # reversed: true flip
    assert page_range(p, 9, 7).first()["text"] == "p5;"             # both beyond the end


def test_html_nested_and_cut_off(spark):
    pages = spark.createDataFrame([
        (1, "<html><body><header><div><h1 class='t'>Big <i>Title</i></h1></div></header>"
            "<p>One &amp; two<br><p>Three &quot;q&quot;<script>var s='</p>';</script>"
            "<!-- <p>hidden</p> --><footer>&copy; x</footer></body></html>"),
        (2, "<p>cut off inside a paragraph"),
    ], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html_text(pages).collect()}
    assert got[1] == 'Big Title One & two Three "q"'
    assert got[2] == "cut off inside a paragraph"
