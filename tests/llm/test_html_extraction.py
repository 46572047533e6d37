import re
import time
from html import unescape

import pytest

from skysonde.llm.html_extraction import extracted, main_text

PROSE = "The river rose in the night, slowly at first, and by morning the lower fields, the road and the mill were under water."


def test_pages_of_the_tables_equal_a_plain_cut(spark):
    """Brute force for the one layout these pages have: blocks between the tags of the only article."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extracted(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for row in rows:
        article = re.search(r"<article>(.*)</article>", row.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        text = "\n\n".join(b for b in blocks if b)
        assert (got[row.page_id].text, got[row.page_id].n_chars, got[row.page_id].url) == (text, len(text), row.url)


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("<nav><a href=x>Home</a></nav>", ""),
        ("just words", "just words"),
        ("<p>one<p>two <b>b</b>old<br>line", "one\n\ntwo bold line"),
        ("a &lt;b&gt; &amp;amp; &eacute;&nbsp;&#8212; &copy 1 &unknown;", "a <b> &amp; é — © 1 &unknown;"),
        ("1 < 2 <p title='>'>q</p><!-- <p>no</p> --><!--><p>yes</p>", "1 < 2\n\nq\n\nyes"),
        ("<p>x</p><script>var a = '<p>no</p>'</script><style>p{}</style><p>y</p><script>if (a", "x\n\ny"),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", "a\n\nb\n\nc\n\nd"),
        ("<ul><li>one<li>two <ul><li>three</ul></ul>", "one\n\ntwo\n\nthree"),
        ("<p>seen <span class='ad'>buy <span>now</span></span>again", "seen again"),
        ("<p>a <i>b</p><p>c</i> d", "a b\n\nc d"),
        ("<p hidden>no<p style='display: none'>no<p aria-hidden=true>no<p>yes", "yes"),
    ],
)
def test_small_pages(html, text):
    assert main_text(html) == text


FRAME = """<body class="has-sidebar">
<header><h1>The Daily Site</h1><form><input name=q></form></header><ul class="main-menu"><li><a href=1>One</a></ul>
<div id="cookieNotice">We use cookies, and you agree, of course, to all of them, always.</div>
<div class="wrap">{article}<div class="sidebar"><p>{prose}</p></div></div>
<section id="comments"><h3>Comments</h3><article class="comment"><p>{prose} {prose} {prose}</p></article></section>
<div class="adBox"><p>Buy this, now, today, here, at once, for less.</p></div>
<ul><li><a href=2>Two</a><li><a href=3>Three</a><li><a href=4>Four</a></ul>
<footer><p>Copyright, all rights, reserved, for ever.</p></footer>"""


@pytest.mark.parametrize(
    "article",
    [
        "<article><header><h1>Title</h1><p>By A. Writer</p></header><p>{prose}</p><p>Short.</p><aside>{prose}</aside><blockquote><p>{prose}</p></blockquote></article>",
        "<main><h1>Title</h1><p>{prose}</p><p>Short.</p><form><p>{prose}</p></form><p>{prose}</p></main>",
        "<div class=post><h1>Title</h1><p>{prose}</p><p>Short.</p><div class='share-buttons'>Share, like, tell</div><p>{prose}</p></div>",
        "<div><h1>Title</h1><div class=text><p>{prose}</p><p>Short.</p><p>{prose}</p></div></div>",
        "<div id=story><h1>Title</h1><div>{prose}</div><div>Short.</div><div>{prose}</div></div>",
        "<div><h1>Title</h1><section><p>{prose}</p><p>Short.</p></section><p>{prose}</p></div>",
    ],
)
def test_the_article_is_found_in_a_page_full_of_other_things(article):
    html = FRAME.format(article=article.format(prose=PROSE), prose=PROSE)
    assert main_text(html) == f"Title\n\n{PROSE}\n\nShort.\n\n{PROSE}"


def test_sections_of_one_article_stay_together():
    parts = "".join(f"<div class=part><h2>Part {i}</h2><p>{PROSE * (1 + 4 * (i == 1))}</p></div>" for i in range(4))
    text = main_text(f"<body><div class=menu>menu</div><div>{parts}</div><footer>end</footer>")
    assert [f"Part {i}" in text for i in range(4)] == [True] * 4 and "menu" not in text and "end" not in text


def test_a_form_or_a_named_frame_around_the_page_is_not_left_out():
    assert main_text(f"<form id=aspnet><div><p>{PROSE}</p></div><div class=footer>f</div></form>") == PROSE
    assert main_text(f"<div class='menu-open'><article><p>{PROSE}</p></article></div>") == PROSE


@pytest.mark.parametrize(
    "html",
    [
        "<" * 300_000, "<a b='" * 100_000, "<!--" * 100_000, "<div>" * 50_000 + "x", "<script>" * 50_000,
        "<b>" * 50_000 + "</i>" * 50_000, "<li><ul>" + "<div>" * 30_000 + "<li>x</li>" * 30_000, "&amp;, " * 300_000,
    ],
)
def test_broken_and_long_pages_take_linear_time(html):
    begun = time.monotonic()
    main_text(html)
    assert time.monotonic() - begun < 10


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(1, "u", "<p>a", "t", 9), (1, "u", "<p>a", "t", 9), (2, None, None, None, None), (None, "u", "", "t", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extracted(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0), (None, "u", "", 0)], key=str
    )
    assert extracted(pages.limit(0)).collect() == []
