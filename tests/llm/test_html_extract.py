import re
import time
from html import unescape

import pytest

from attesta.llm import html_extract as H

LONG = "The river runs along the old wall of the town and it turns to the west where the mills of the valley stand in a row by the bridge."


def test_article_page():
    page = f"""<html><head><title>x</title><script>var a = "</p><article>";</script></head><body class="no-sidebar">
    <header><a href="/">Home</a><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
    <div class="cookie-notice">We use cookies and it is for you to accept all of them in the end of the day, or not, as you like it.</div>
    <article><h1>Mills &amp; water</h1><div class="ad">{LONG}</div><p><b>{LONG}<br><p>Short.</p>
    <p>a&nbsp;b\n  c &lt;tag&gt; &#8211; &eacute;</p><ul><li>one</li><li>two <a href="#">link</a></li></ul>
    <form><input><p>Send it to us</p></form><section id="comments"><p>{LONG}</p></section></article>
    <aside><p>{LONG}</p></aside><footer>&copy; all of it</footer></body></html>"""
    assert H.main_text(page).split("\n\n") == ["Mills & water", LONG, "Short.", "a b c <tag> – é", "one", "two link"]


def test_page_without_containers():
    """Only the block rules decide: long texts are good, links bad, short ones follow their neighbours."""
    links = "".join(f'<p><a href="/{i}">Some link text {i}</a></p>' for i in range(4))
    page = f"<body>{links}<h2>Heading</h2><p>{LONG}</p><p>Between.</p><p>{LONG} More.</p>{links}<p>Terms</p></body>"
    assert H.main_text(page).split("\n\n") == ["Heading", LONG, "Between.", LONG + " More."]


def test_unusual_article_text_is_kept():
    words = " | ".join(["qwx#", "zzk%", "vvp$"] * 20)
    page = f"<main><p>{words}</p><p>x</p></main><div>aside</div>"
    assert H.main_text(page) == f"{words}\n\nx"
    assert H.main_text("<article><p>x<div>y</div><br><br>z w<br>v</article>") == "x\n\ny\n\nz w v"


def test_broken_markup():
    for page in ("<", "<a", "<!-- open", "<p class='x", "</p></div>", "<script>never closed", "a < b & c &#xD800; &bogus;", "<p>" * 3000):
        assert isinstance(H.main_text(page), str)
    assert H.main_text("<article>1 < 2 &amp; 3") == "1 < 2 & 3"


def test_table(spark):
    page = f"<article><p>{LONG}</p></article>"
    rows = [(1, "u", page, 9), (1, "u", page, 9), (None, None, None, 9), (2, "v", "", 9), (3, "w", "<article>" + f"<p>{LONG}</p>" * 20000, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    found = sorted((str(r["page_id"]), r["url"], r["n_chars"]) for r in H.extract_pages(pages).collect())
    assert found == sorted([("1", "u", len(LONG))] * 2 + [("None", None, 0), ("2", "v", 0), ("3", "w", (len(LONG) + 2) * 20000 - 2)], key=lambda r: r[0])
    assert H.extract_pages(pages.limit(0)).collect() == []


def test_given_pages_against_plain_cut(spark):
    """Pages of the given tables hold one article: cutting it out by hand gives the same text."""

    def cut(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [re.sub(r"<br>|</?b>", lambda m: " " if "br" in m[0] else "", p) for p in re.split(r"</?(?:p|h1)>", inner)]
        return "\n\n".join(t for t in (" ".join(unescape(p).split()) for p in parts) if t)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r["page_id"]: cut(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in H.extract_pages(pages).collect()} == want


POLISH = "Rzeka płynie wzdłuż starego muru miasta i skręca na zachód, gdzie przy moście stoją w rzędzie młyny całej doliny, a dalej zaczyna się gęsty las."


def test_headline_and_lead_around_the_article():
    page = f"<body><p>{LONG} Outside.</p><main><h1>Mills</h1><p>{LONG} Lead.</p><article><p>{LONG}</p></article></main></body>"
    assert H.main_text(page).split("\n\n") == ["Mills", LONG + " Lead.", LONG]


def test_weak_names_inside_of_an_article():
    inner = f'<div class="entry-header"><h1>Mills</h1></div><p class="alert-level">{LONG}</p><div class="side-by-side"><p>{LONG} Two.</p></div>'
    furniture = f'<div class="alert"><p>{LONG}</p></div><div class="share-box"><p>{LONG}</p></div>'
    assert H.main_text(f"<article>{inner}{furniture}</article>").split("\n\n") == ["Mills", LONG, LONG + " Two."]
    assert H.main_text(f'<div class="page-header"><p>{LONG}</p></div><article><p>{LONG} Two.</p></article>') == LONG + " Two."


def test_bare_pages_without_known_stop_words():
    links = "".join(f'<p><a href="/{i}">Some link text {i}</a></p>' for i in range(4))
    assert H.main_text(f"<body>{links}<p>{POLISH}</p><p>Krótko.</p><p>{POLISH}</p>{links}</body>").split("\n\n") == [POLISH, "Krótko.", POLISH]
    assert H.main_text(f"<body>{links}<p>Raz.</p><p>Dwa.</p></body>").split("\n\n") == ["Raz.", "Dwa."]
    assert H.main_text(f"<body>{links}</body>") == ""


@pytest.mark.parametrize(
    "markup",
    ["<b>" * 60000 + "</i>" * 60000, '<a "' * 200000, '<a ">"' * 120000, "<b>" * 60000 + "<tr></tr>" * 60000, "<a href='" * 90000,
     "<script>" + "</script" * 100000, "<!-" * 200000, "<p>" + "<i>" * 100000 + "<p>x" * 100000, "<!--" * 150000, "<td>" * 150000],
)
def test_unclosed_markup_takes_linear_time(markup):
    def seconds(page):
        begin = time.process_time()
        H.main_text(page)
        return time.process_time() - begin

    assert seconds(markup) < 5


def test_unclosed_comments():
    assert H.main_text(f"<article><p>{LONG}<!-- x <p>y</p>") == LONG
    assert H.main_text(f"<article><p>{LONG}</p><!-- x") == LONG
    assert H.main_text(f"<article><p>{LONG}</p>1 < 2 <a 3") == f"{LONG}\n\n1 < 2 <a 3"


def test_page_ids_that_are_no_numbers(spark):
    pages = spark.createDataFrame([("a-1", "u", f"<article><p>{LONG}</p></article>")], "page_id string, url string, html string")
    assert [tuple(r) for r in H.extract_pages(pages).collect()] == [("a-1", "u", LONG, len(LONG))]
