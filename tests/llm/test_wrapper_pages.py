"""Articles on pages with compound class names, deep nesting, copies and hosts without articles."""

import json

import pytest
from gridledger.llm import wrappers
from pyspark.sql import functions as F

KEPT = [("<body class='single has-sidebar'><article><p>Text</p></article></body>", "Text"), ("<div class='content with-sidebar'><p>Text</p></div>", "Text"), ("<div class='post ad-free'><p>Text</p></div>", "Text"),
        ("<html class='js cookies'><article><p>Text</p></article></html>", "Text"), ("<article class='post comments-open'><p>Text</p></article>", "Text"),
        ("<article><section id='related-work'><p>One</p></section><div id='social-effects'><p>two</p></div></article>", "One two"),
        ("<article><p>Text</p><div class='related'>no</div><div class='site-footer'>no</div><div class='cookie-banner'>no</div><div id='sidebarLeft'>no</div><ul class='share-links'><li>no</li></ul></article>", "Text")]


@pytest.mark.parametrize("page, text", KEPT)
def test_class_tokens_are_read_whole(page, text):
    blocks = list(wrappers.segments(page))
    keep = wrappers.article_paths(wrappers.Wrapper.of(blocks))
    assert " ".join(t for p, t, *_ in blocks if "\n".join(p) in keep) == text


def test_deep_pages_and_copies(spark):
    deep = "<div>" * 5000 + "".join(f"<p>para {i}</p>" for i in range(40)) + "</div>" * 5000
    intro = "<article><div>Intro words here</div><p>{}</p></article>"
    rows = [(1, "http://deep.example/a", deep), (2, "http://deep.example/b", deep.replace("para", "line")), (3, "http://once.example/", intro.format("long text of this page")),
            (4, "http://twice.example/", intro.format("long text of this page")), (4, "http://twice.example/", intro.format("long text of this page")), (5, "http://two.example/1", intro.format("one text that is long enough")), (6, "http://two.example/2", intro.format("another text that is long"))]
    got = wrappers.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    text = {r.page_id: r.text for r in got}
    assert text[1] == " ".join(f"para {i}" for i in range(40)) and text[2] == " ".join(f"line {i}" for i in range(40))
    assert text[3] == text[4] == "Intro words here long text of this page"
    assert text[5] == "one text that is long enough"  # on two pages that differ, a constant text outside paragraphs is a notice


def test_packing_and_aligning_keep_the_expression():
    pages = ["<div><p>a</p><p>b</p><ul><li>x</li><li>y</li></ul></div>", "<div><h1>t</h1><p>c</p></div><div><p>d</p></div>", "<main><p>e</p></main>"]
    one = None
    for page in pages:
        own = wrappers.Wrapper.of(list(wrappers.segments(page)))
        again = wrappers.Wrapper.unpack(json.loads(json.dumps(own.pack())))
        assert again.expression() == own.expression()
        one = again if one is None else one.align(own)
    assert wrappers.Wrapper.unpack(one.pack()).expression() == one.expression()
    assert one.pages == 3 and "h1" in one.expression()


def test_hosts_without_articles(spark):
    page = "<div class='top-nav'><a href=/>Home</a> <a href=/x>More pages</a></div><div id=c><p>{0} story of some length</p><p>and {0} more of it, told at length here</p></div><div class='site-footer'>Copyright</div>"
    rows = [(i, f"http://plain.example/{i}", page.format(f"tale{i}")) for i in range(12)]
    got = wrappers.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").select("text", F.col("n_chars") > 0).collect()
    assert [r.text for r in got] == [f"tale{i} story of some length and tale{i} more of it, told at length here" for i in range(12)]
