import html
import re

import pytest

from profilark.functions.cluster import table
from profilark.llm import htmltext
from profilark.llm.queries import queries


def test_query_equals_the_articles(spark, small):
    """On these pages the article element is the truth, cut by another route."""
    want = {}
    for p in table(spark, small, "pages").collect():
        cut = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", p.html, re.S)[1])
        cut = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in cut]
        want[p.page_id, p.url] = "\n\n".join(b for b in cut if b)
    got = {(r.page_id, r.url): r.text for r in queries()["op5_html_extraction"](spark, small).collect()}
    assert got == want


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<article><p>One &amp; two&nbsp; three<br>four <b>b</b>old</p><p>x", "One & two three four bold\n\nx"),
        ("<body class='has-sidebar'><article><p>a < b and 3 > 2</p><!-- <p>no</p> --><script>'<p>no</p>'</script><style>p{}</style></article>", "a < b and 3 > 2"),
        ('<nav><a href="/x">Menu</a></nav><div class="content"><p>A real sentence of the text stands here, quite long.</p></div><div id="cookieNotice"><p>We use cookies to improve this site for you.</p></div>', "A real sentence of the text stands here, quite long."),
        ('<article><p title="a > b">kept</p><form><p>Name please</p><input></form><aside>Side</aside></article><footer>&copy; me</footer>', "kept"),
        ('<header><h1>Site</h1></header><main><h1>Title</h1><ul><li>one<li>two</ul><section class="comments"><article class="comment"><p>First!</p></article></section></main>', "Title\n\none\n\ntwo"),
        ("<article>open <p>never closed <div class='ad'>buy</div> tail</article><p>out", "open\n\nnever closed\n\ntail"),
        ("<article><p>x</p></nav></div><p>y</p><p hidden>z</p><p style='display: none'>z</p></article", "x\n\ny"),
        ("<article><p>caf&eacute; &#8212; &#x1F600; &unknown; &ampx</p></article>", "café — 😀 &unknown; &x"),
    ],
)
def test_pages(page, want):
    assert htmltext.main_text(page) == want


def test_tree_fits_its_table_and_long_pages_are_whole(spark):
    x, y = htmltext.labelled_rows()
    assert ((htmltext.default_tree().predict(x) >= 0.5) == y).all()
    body = "".join(f"<p>Paragraph number {k} of a very long page.</p>" for k in range(40_000))
    rows = [(1, "u", f"<article>{body}</article>", 1), (1, "u", None, 2), (None, None, "<p>A short page with one paragraph</p>", 3), (2, "v", "<" * 100_000, 4), (3, "v", "<p " + "a='" * 50_000, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, main int")
    got = [(r.page_id, r.url, len(r.main)) for r in htmltext.extract(df.drop("main"), "page_id", "url").collect()]
    long = len("\n\n".join(f"Paragraph number {k} of a very long page." for k in range(40_000)))
    assert sorted(got, key=repr)[:2] == [(1, "u", 0), (1, "u", long)] and len(got) == 5
    assert htmltext.extract(df.drop("main").limit(0), "page_id").count() == 0
