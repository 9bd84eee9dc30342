import html
import random
import re

import pytest
from pyspark.sql import functions as F

from claimlake.llm import html_text as H
from claimlake.llm.queries import op11_html_text


@pytest.fixture(scope="module")
def tree(spark):
    return H.trained_tree(spark)


HEAD = "<!DOCTYPE html><html><head><title>A title</title><style>p{x:y}</style><script>var a = '<p>no</p>';</script></head>"
#: Pages of other makes than those in the tables, with their main text.
HELD_OUT = [
    (
        HEAD + '<body class="has-sidebar"><header class="site-header"><a href="/">Site name</a><nav><a href=/a>One</a> <a href=/b>Two</a></nav></header>'
        '<div class="cookie-notice"><p>We use cookies on this site, and by going on reading you say that this is fine with you.</p><button>Accept</button></div>'
        '<main><h1>Rivers &amp; lakes</h1><p>The first paragraph, with a <a href="/x">link</a> in it, is about rivers.</p><p>Short.</p>'
        '<div class="ad-slot ad"><p>Buy two of these and get a third one for free today only</p></div><p>Another one&nbsp;follows<br>here.</p></main>'
        '<aside><h3>Related</h3><p>A long teaser about quite another matter that has nothing to do with rivers.</p></aside>'
        '<section id="comments"><h2>2 comments</h2><article class="comment"><p>I do not agree with what was said about lakes, they are fine.</p></article></section>'
        "<footer><p>Copyright by somebody, all rights are kept, and so on and so on.</p></footer></body></html>",
        "Rivers & lakes The first paragraph, with a link in it, is about rivers. Short. Another one follows here.",
    ),
    (
        HEAD + '<body><div id="top-menu" class="menu"><ul><li><a href="/">Home</a><li><a href="/n">News</a></ul></div>'
        '<div class="post-wrap"><div class="entry content"><h2>On bread</h2><p>Bread is made of flour, water and <i>time</i>.<p>Salt <b>too</b>'
        '<ul><li>flour<li>water</ul></div></div><form action="/s"><label>Search</label><input name=q><p>Type some words here to search all of this site.</p></form>'
        '<div class="social share"><a href="#">Share this</a></div>',
        "On bread Bread is made of flour, water and time. Salt too flour water",
    ),
    (
        HEAD + "<body><table><tr><td><a href=/1>Start</a></td><td><a href=/2>Archive</a></td><td><a href=/3>Contact us</a></td></tr></table>"
        "<p>" + "This page has no telling names at all, only words in a row. " * 4 + "</p><p>" + "A second paragraph of the same kind goes on here for a while. " * 3 + "</p>"
        "<p><a href=/4>Next page</a></p><p><a href=/5>Previous page</a></p>",
        ("This page has no telling names at all, only words in a row. " * 4 + "A second paragraph of the same kind goes on here for a while. " * 3).strip(),
    ),
    (
        "<body><article><header><h1>Title of the text</h1></header><p>Words 1 &lt; 2 and 3&#62;2, caf&eacute;.</p><!-- <p>hidden</p> --><figure><img src=x><figcaption>A picture</figcaption></figure>"
        '<div class="newsletter"><p>Sign up for the letter that we send each week to all our readers.</p></div><p hidden>not seen</p><noscript>Please switch scripts on</noscript></article>',
        "Title of the text Words 1 < 2 and 3>2, café. A picture",
    ),
    ('<div role="navigation">A long row of words in the navigation</div><div role="main">Yes</div><div role="contentinfo">No, this is the end of it</div>', "Yes"),
]


@pytest.mark.parametrize("page,want", HELD_OUT)
def test_other_pages(tree, page, want):
    assert H.page_text(tree, page) == want


def test_tree_follows_the_names_where_there_are_some(tree):
    """Whatever the words and links: the best named place of a page is its text, and nothing named otherwise is."""
    r = random.Random(3)
    for _ in range(3000):
        places = [r.choice([-2, -2, -1, 0, 1, 2, 3]) for _ in range(r.randint(1, 9))]
        blocks = [(p, w := r.choice([1, 2, 5, 9, 30, 200]), r.choice([0, 0, w // 3, w])) for p in places]
        best = max(places)
        got = [H.label_of(tree, x) for x in H.numbers_of(blocks)]
        if best >= 1:
            assert got == [p == best for p in places], blocks
        else:
            assert not any(g for g, p in zip(got, places) if p < 0)


def test_tree_fits_its_table_and_pages_left_out_of_it(spark, tree):
    rows = lambda pages: [(x, b[3]) for page in pages for x, b in zip(H.numbers_of([b[:3] for b in page]), page)]
    right = lambda t, pages: sum(H.label_of(t, x) == bool(y) for x, y in rows(pages)) / len(rows(pages))
    assert right(tree, H.LABELLED) > 0.97
    parts = [(H.trained_tree(spark, [p for i, p in enumerate(H.LABELLED) if i % 4 != k]), H.LABELLED[k::4]) for k in range(4)]
    assert sum(right(t, pages) * len(rows(pages)) for t, pages in parts) / len(rows(H.LABELLED)) > 0.85


def article_of(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inner))).split())


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op11_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r["url"], r["text"]) == (pages[r["page_id"]]["url"], article_of(pages[r["page_id"]]["html"]))
        assert r["n_chars"] == len(r["text"])


def test_awkward_pages(spark):
    long = "<article>" + "<p>some words &amp; more</p>" * 60_000
    pages = [
        (1, "u", None), (2, None, ""), (3, "u", "   "), (4, "u", "plain text without any markup, of more than a few words, so it is text"), (None, "u", "<article>x"), (5, "u", long), (5, "u", long),
        (6, "u", "<article>a <b>b<p>c</article"), (7, "u", "<article>1 < 2 <3</article>"), (8, "u", "<article>x<!-- never ends <p>y"), (9, "u", "<article>x<a href=\"never ends>y</a>"),
        (10, "u", "<article>x</article><script>let a"), (11, "u", "<![CDATA[x]]><article>y<?php z ?></article>"), (12, "u", "<" * 20_000 + "<div>" * 20_000 + "</span>" * 20_000),
        (13, "u", "<article>a b&#0;&#xD800;&bogus; c</article>"), (14, "u", '<a href="' * 20_000), (15, "u", "<article><p>one</p></p></div></article>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({n: F.lit("own") for n in ("text", "n_chars", "words", "place", "features")})
    got = {}
    for r in H.main_text(df.repartition(3)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    words = "some words & more"
    assert got.pop(13) == [" ".join(html.unescape("a b&#0;&#xD800;&bogus; c").split())]
    assert got == {
        1: [""], 2: [""], 3: [""], 4: [pages[3][2]], None: ["x"], 5: [" ".join([words] * 60_000)] * 2, 6: ["a b c"], 7: ["1 < 2 <3"], 8: ["x"], 9: ["x"], 10: ["x"], 11: ["y"],
        12: got[12], 14: [""], 15: ["one"],
    }
    assert H.main_text(df.limit(0)).collect() == []
