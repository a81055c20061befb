import html
import re
import time

import pytest

from tenetlog.llm import html_text

TREE = html_text.grow(*html_text.labelled_table())


def text(page):
    return html_text.main_text(page, TREE)


def test_tree_fits_its_table():
    x, y = html_text.labelled_table()
    assert (html_text.judged(TREE, x) == y).mean() > 0.98


@pytest.mark.parametrize("page, want", [
    ("<article><h1>T</h1><p>a b<p>c</article>", "T\na b\nc"),
    ("plain &lt;x&gt; a&nbsp;b &#233;&amp;amp;", "plain <x> a b é&amp;"),
    ("<p>one<p>two <b>bold <i>x</b> y</p></span></div>", "one\ntwo bold x y"),
    ("<main><p>Hello <a href=x>w</a><br>next\n\tline</p><script>if(a<b)'</p>'</script><!-- <p>c --><style>p</style><p>End", "Hello w next line\nEnd"),
    ("<article><p>x</p><div class='advert-box'><p>Buy</p></div><form><p>Mail</p></form><ul><li>one<li>two</ul></article>"
     "<section class=user-comments><article>c c c c c</article></section>", "x\none\ntwo"),
    ("<header><p>Site</p></header><nav>menu</nav><article><header><h1>T</h1></header>b</article><aside>s</aside>"
     "<div id=cookieNotice>we use</div><footer>f</footer><p>after", "T\nb"),
    ("<div role=navigation>nav words</div><div role='main'>content > 3 < 4</div>", "content > 3 < 4"),
    ("<body class='has-sidebar'><div class=main><p>A paragraph of eight words is here for you.</p></div><div class=widget>x</div>",
     "A paragraph of eight words is here for you."),
    ("<article><p>unterminated <b", "unterminated"), ("<article>a<style>x", "a"), ("", ""), (None, ""), (" \n ", ""), ("<p></p>", ""),
])
def test_pages(page, want):
    assert text(page) == want


def test_given_pages_equal_a_plain_reading(spark, sf):
    """The given pages hold one article of headings and paragraphs; a reading by pattern gives the same text."""
    pages = spark.read.parquet(f"{sf}/../sf0.01/pages.parquet")
    found = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in re.split(r"</?(?:p|h1)>", inside))
        want = "\n".join(line for line in lines if line)
        assert (found[r.page_id].text, found[r.page_id].n_chars, found[r.page_id].url) == (want, len(want), r.url)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", "<p>a b</p>", "x"), (1, "u", "<p>a b</p>", "x"), (None, None, None, None), (2, "u", "", "x"), (3, None, "<p>" + "w " * 300_000, "x")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    found = html_text.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in found.collect()) == [(0, 0), (1, 3), (1, 3), (2, 0), (3, 599_999)]
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 50_000, "<p><b>" * 50_000, "<table><td>" * 20_000 + "<p><b>" * 20_000, "<a " * 50_000, "<!--" * 50_000,
                                  "<i>" * 50_000 + "<div>t</div>" * 20_000, "<div>" + "<i>" * 50_000 + "<hr>t" * 20_000, "<" * 100_000])
def test_time_grows_with_the_page_only(page):
    start = time.perf_counter()
    text(page)
    assert time.perf_counter() - start < 20
