from __future__ import annotations

import html
import re

import pytest

from colloquy.llm.main_text import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>Head</title><style>p{}</style></head><body class="no-sidebar">
<header>Site</header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>
<div id="cookie-notice">We use cookies here, which is a long sentence that says very little to anyone.</div>
%s
<aside>Side matter that is long enough to be taken for text by a careless reader of pages.</aside>
<form><label>Name</label><input><button>Send it</button></form>
<section id="comments"><p>Great article, I loved to read every single word of it, thank you so much.</p></section>
<footer>&copy; 2024</footer></body></html>"""
BODY = (
    "<h1>Title</h1><p>A paragraph that is <b>long</b>er &amp; goes on and on, past the threshold of a surge.</p><p>Short."
    "<div class='advert'>Buy now, this is the offer of the year, do not miss it for anything.</div><p>1 &lt; 2 but 3\n > 2,"
    "<br>more &#233; text here to make the block a long one again.<p>End."
)
TEXT = "Title A paragraph that is longer & goes on and on, past the threshold of a surge. Short. 1 < 2 but 3 > 2, more é text here to make the block a long one again. End."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class='content'>%s</div>"])
def test_furniture_goes(wrap):
    assert main_text(PAGE % (wrap % BODY)) == TEXT


def test_short_article_cut_off_and_unmarked():
    assert main_text("<nav>Menu</nav><article><h1>Tiny</h1></article><footer>Foot") == "Tiny"
    assert main_text(PAGE[: PAGE.index("%s")] + "<article>" + BODY + "</article><footer>x</footer><p clas") == TEXT
    assert main_text("Just <i>words</i>, a &lt; b") == "Just words, a < b"
    assert main_text("<script>if (a < b) { x('</p>') }") == ""
    assert main_text("a < b and c > d <3") == "a < b and c > d <3"


LONG = "A paragraph of the body that is long enough to make the sum of its window surge."


def test_text_outside_and_in_several_articles():
    teasers = "<article><p>Teaser one</p></article><article><p>Teaser two</p></article>"
    assert main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div><nav>Menu</nav><hr><hr>{teasers}") == f"{LONG} {LONG} Teaser one Teaser two"
    assert main_text(f"<p>{LONG}</p><article><h1>Head</h1><p>{LONG}</p></article><p>{LONG}</p>") == f"{LONG} Head {LONG} {LONG}"
    several = f"<article><p>{LONG}</p></article><nav>a</nav><nav>b</nav><article><p>Short one.</p></article><nav>c</nav><article><a href='/x'>{LONG}</a></article>"
    assert main_text(several) == f"{LONG} Short one."


def test_short_blocks_in_wrappers():
    blocks = [("h1", "Head"), ("p", "By Ann"), ("p", "12 May"), ("li", "One"), ("p", LONG), ("h2", "Part"), ("p", "Short."), ("li", "Two"), ("p", LONG), ("p", "End.")]
    text = " ".join(x for _, x in blocks)
    wrapped = "".join(f"<div><div><{t}>{x}</{t}></div></div>" for t, x in blocks)
    assert main_text(f"<body><nav>Menu</nav>{wrapped}<footer>Foot</footer>") == text
    assert main_text("<br><br><br><br>".join(x for _, x in blocks)) == text
    menus = "<div><a href='/a'>Menu</a></div>" * 3
    assert main_text(f"<div>Logo</div>{menus}{wrapped}{menus}<div>Foot</div>") == text


def test_rows(spark):
    rows = [(1, "u", PAGE % f"<article>{BODY}</article>", "t"), (2, None, None, "t"), (3, "u", "", None), (None, "u", "<p>x", "t")]
    rows += [rows[0], (5, "u", "<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>", "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract(frame).collect()
    texts = sorted((str(x.page_id), x.text) for x in found)
    assert texts[:5] == [("1", TEXT), ("1", TEXT), ("2", ""), ("3", ""), ("5", " ".join(["word & word"] * 50_000))]
    assert all(x.n_chars == len(x.text) for x in found)
    assert extract(frame.limit(0)).count() == 0


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    markup = {x.page_id: x.html for x in pages.collect()}
    for x in extract(pages).collect():
        article = re.search("<article>(.*?)</article>", markup[x.page_id], re.S)[1]
        assert x.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split())
