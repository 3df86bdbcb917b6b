"""Site templates: parsing, counting under different titles, and both ways of deleting."""

import html
import re

from pyspark.sql import functions as F

from proseforge.llm import templates
from proseforge.llm.queries import op5_site_templates


def test_blocks_of_an_article():
    page = (
        "<!DOCTYPE html><title>T &amp; x</title><script>var a='</p><p>no';</script><style>p{}</style><nav><a>menu</a></nav><div class='ad'>buy</div>"
        "<article><header>by me</header><h1>Head &lt;1&gt;</h1><p>one <b>two\n\n three<p>four&nbsp;five<br>six</p>"
        "<!-- <p>hidden</p> --><ul><li>a<li>b</ul><form>q</form><p>a < b > c</p><div id=comments><p>nice</p></div><pre>x  y</pre></article><footer>f</footer>"
    )
    assert templates.main_text(page).split("\n") == ["Head <1>", "one two three", "four five six", "a", "b", "a < b > c", "x y"]


def test_pages_without_an_article_or_with_broken_marks():
    assert templates.main_text("just text") == "just text"
    assert templates.main_text("<div>a<div>b</div>c") == "a\nb\nc"
    assert templates.main_text("<p>a</b></i><p>b") == "a\nb"
    assert templates.main_text('<p title="x>y">a</p><p title="open>b') == "a\nb"
    assert templates.main_text("<script>never closed <p>x") == ""
    assert templates.main_text("<p>&#0;&#x110000;&bogus; &eacute;</p>") == "��&bogus; é"
    assert templates.main_text(None) == "" and templates.main_text("") == "" and templates.main_text("<>< p>") == "<>< p>"
    assert templates.main_text("<p>" * 50_000 + "deep " + "<div>" * 50_000) == "deep"


def test_classes_of_wrappers_delete_no_article():
    assert templates.main_text('<div class="content-sidebar-wrap"><main><p>a</p></main></div>') == "a"
    assert templates.main_text('<div class="layout has-sidebar"><article><p>a</p><div class="search social"><p>b</p></div></article></div>') == "a\nb"
    assert templates.main_text('<main><div id="replies"><article><p>a</p></article><p>reply</p></div></main>') == "a"
    assert templates.main_text('<div class="notice"><p>a</p></div><div role="search"><p>b</p></div>') == "a\nb"
    # Tags that hold no text keep their mark.
    assert templates.main_text('<aside><article><p>a</p></article></aside><article><p>b</p></article>') == "b"


def test_marked_elements_go_where_they_recur(spark):
    page = "<title>t{0}</title><div class='has-sidebar'><article><p>Story {0}</p><div class=social>Tell all</div><div class=notice>Only {0}</div></article></div>"
    df = spark.createDataFrame([(i, "http://e.org/", page.format(i)) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in templates.extract(df).collect()} == {f"Story {i}\nOnly {i}" for i in range(30)}


def site(spark, more=()):
    pages = [(i, f"http://a.org/{i}", f"<title>t{i}</title><body><div><p>Our site sells all</p><ul><li>x</li></ul></div><p>Story number {i} here</p><p>The end</p></body>") for i in range(40)]
    # Copies of one page, with an address each, are one title.
    pages += [(100 + i, f"http://a.org/copy{i}", "<title>same</title><p>Copied words stand</p>") for i in range(60)]
    pages += [(200, "http://b.org/", "<title>b</title><p>Our site sells all</p>"), *more]
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def test_recurring_elements_go_and_copies_stay(spark, monkeypatch):
    df = site(spark)
    by_broadcast = {r.page_id: r.text for r in templates.extract(df).collect()}
    assert by_broadcast[3] == "Story number 3 here" and by_broadcast[130] == "Copied words stand" and by_broadcast[200] == "Our site sells all"
    monkeypatch.setattr(templates, "BROADCAST_ELEMENTS", 0)
    assert {r.page_id: r.text for r in templates.extract(df).collect()} == by_broadcast


def test_within_an_article_only_boxes_go(spark):
    page = "<title>t{0}</title><article><p>Licensed to all</p><div>Tell your friends</div><p>Story {0}</p></article>"
    df = spark.createDataFrame([(i, "http://c.org/", page.format(i)) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in templates.extract(df).collect()} == {f"Licensed to all\nStory {i}" for i in range(30)}


def test_edges(spark):
    df = site(spark, [(300, None, None), (301, None, ""), (302, "no address", "<p>x</p>"), (302, "no address", "<p>x</p>"), (None, "http://d", "<p>" + "long " * 100_000)])
    df = df.withColumns({"text": F.lit(1), "page": F.lit("p"), "key": F.lit("k"), "a.b": F.lit(2)})
    out = templates.extract(df)
    assert out.columns == ["page_id", "url", "html", "page", "key", "a.b", "text"]
    got = [(r.page_id, r.text) for r in out.collect()]
    assert len(got) == df.count()
    assert [t for p, t in got if p in (300, 301)] == ["", ""] and [t for p, t in got if p == 302] == ["x", "x"]
    assert [len(t) for p, t in got if p is None] == [499_999]
    assert templates.extract(df.limit(0)).count() == 0


def test_query_against_the_article_as_marked(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = op5_site_templates(spark, folder).collect()
    assert {r.page_id for r in got} == pages.keys()
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
