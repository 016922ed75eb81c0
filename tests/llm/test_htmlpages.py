import pytest

from profilark.llm import htmltext
from profilark.llm.htmlpages import HELD_OUT

LONG = " ".join(f"word{k}" for k in range(60))


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><head><title>t</title><meta charset='utf-8'><h1>Title</h1><p>{LONG}</p>", f"Title\n\n{LONG}"),
        (f"<head><link rel='x'>\n<body><main><p>{LONG}</p></main>", LONG),
        (f"<head><title>t</title>Text at once<p>{LONG}</p>", f"Text at once\n\n{LONG}"),
        (f"<main><h1>Drug</h1><section id='side-effects'><h2>Side effects</h2><p>{LONG}</p></section></main><footer>f</footer>", f"Drug\n\nSide effects\n\n{LONG}"),
        (f"<article><h1>T</h1><div class='legal advice'><p>{LONG}</p></div></article>", f"T\n\n{LONG}"),
        (f"<article><p>{LONG} <span class='notice'>inside</span> end</p></article>", f"{LONG} inside end"),
        (f"<article><p>{LONG} <span hidden>gone</span> end</p></article>", f"{LONG} end"),
        (f"<nav class='legal'><ul><li><a href='x'>Imprint</a></ul></nav><article><p>{LONG}</p></article>", LONG),
    ],
)
def test_probed_pages(page, want):
    assert htmltext.main_text(page) == want


def test_blocks_of_pages_that_the_tree_has_not_seen():
    x, y = htmltext.labelled_rows(HELD_OUT)
    keep = htmltext.default_tree().predict(x) >= 0.5
    assert len(y) > 70 and (keep == (y == 1)).mean() >= 0.95


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", "m", "dot")], "page_id long, url string, html string, main string, `a.b` string")
    got = htmltext.extract(df, "page_id", "main", "`a.b`")
    assert got.columns == ["page_id", "main_", "a.b", "main", "n_blocks", "n_kept"]
    assert tuple(got.first()) == (1, "m", "dot", LONG, 1, 1)
