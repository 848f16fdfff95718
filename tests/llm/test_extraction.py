"""Minimum cuts against all labellings, blocks of awkward mark-up, and extraction against pages of known content."""

import itertools
import random

import pytest

from parlance.llm import extraction
from parlance.llm.blocks import decoded, read
from parlance.llm.mincut import labelled, source_side


def energy(gain, edges, label):
    return sum(g for g, x in zip(gain, label) if x) - sum(w for a, b, w in edges if label[a] != label[b])


def test_cuts_equal_brute_force():
    r = random.Random(4)
    for _ in range(400):
        n = r.randint(1, 9)
        gain = [r.randint(-6, 6) for _ in range(n)]
        edges = [(r.randrange(n), r.randrange(n), r.randint(0, 5)) for _ in range(r.randint(0, 14))]
        best = max(energy(gain, edges, x) for x in itertools.product((False, True), repeat=n))
        assert energy(gain, edges, labelled(gain, edges)) == best == energy(gain, edges, source_side(gain, [e for e in edges if e[0] != e[1]]))


def test_cut_of_a_long_page():
    r = random.Random(1)
    n = 20_000
    gain, edges = [r.randint(-900, 900) for _ in range(n)], [(i, i + 1, 800) for i in range(n - 1)]
    ahead = [(0, gain[0])]  # best value so far by label of the last node
    for g in gain[1:]:
        off, on = ahead[-1]
        ahead.append((max(off, on - 800), g + max(on, off - 800)))
    assert energy(gain, edges, labelled(gain, edges)) == max(ahead[-1])


def texts(html):
    return read(html, extraction.stands_alone).text


def test_blocks_of_awkward_markup():
    assert texts("") == [] and texts("no mark-up") == ["no mark-up"] and texts("a < b &lt; c<3") == ["a < b < c<3"]
    assert texts("<p>one<p>two<b>th</b>ree<br>four <!-- <p>x --> five") == ["one", "twothree four five"]
    assert texts('<p title="a > b">x</p><p title=\'c\' hidden>y') == ["x", "y"]
    assert texts("<script>if (a</p>b) '<p>'</script>x<style>p{}</style><title>t</title>") == ["x"]
    assert texts("<script>never ends <p>x") == [] and texts("x<!-- never ends <p>y") == ["x"] and texts("x<p") == ["x"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table>") == list("abcdef")
    assert texts("</p></div>x</span><unknown>y</unknown>z") == ["x", "y", "z"]
    assert texts("a&nbsp;&amp;amp; b\n\t c&#x41;&#65&bogus;") == ["a &amp; b cAA&bogus;"]
    assert decoded("&#" + "1" * 5000 + ";") == "�" and decoded("&#" + "0" * 5000 + "65;") == "A"
    assert texts("<P>é\x00<INPUT value='x'>ü</P><?php x ?><![CDATA[y]]>z") == ["é\x00ü", "z"]
    page = read("<p><a href=x>link</a> text <a>more</p>plain", extraction.stands_alone)
    assert page.text == ["link text more", "plain"] and page.linked == [8, 0]
    assert len(read("<div>" * 50_000 + "x" + "</b></i>" * 50_000, extraction.stands_alone).text) == 1
    assert texts('<a x="' * 30_000) == [] and len(texts("<p>x" * 50_000)) == 50_000


LONG = "This is a sentence of the article which goes on for a good while, as the sentences of articles do."
ARTICLE = f"<h1>The title</h1><p>{LONG}</p><p>Short.</p><ul><li>A point</li><li>Another point</li></ul><blockquote>{LONG}</blockquote>"
WANTED = f"The title\n{LONG}\nShort.\nA point\nAnother point\n{LONG}"
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul>'
PIECES = {
    "nav": f"<nav>{MENU}</nav>", "header": "<header><div>Site name</div><h1>The daily site</h1></header>", "footer": "<footer><p>&copy; 2020 A site. All rights reserved.</p></footer>",
    "aside": f"<aside><h2>More</h2><p>{LONG}</p></aside>", "sidebar": f'<div class="sidebar"><p>{LONG}</p><p>{LONG}</p></div>', "ad": '<div class="ad">Buy this now, it is very cheap.</div>',
    "notice": f'<div id="cookieNotice"><p>We use cookies. {LONG}</p><button>Accept</button></div>', "form": f'<form><label>Your mail</label><input><p>{LONG}</p></form>',
    "comments": f'<section class="comments"><h2>Comments</h2><article class="comment"><p>{LONG}</p></article><article class="comment"><p>I agree. {LONG}</p></article></section>',
    "menu": f'<div class="main-menu">{MENU}</div>', "hidden": f'<div style="display: none"><p>{LONG}</p></div>', "share": '<div class="social-share"><a>Share</a> <a>Tweet</a></div>',
    "role": f'<div role="navigation">{MENU}</div>', "script": "<script>document.write('<p>x</p>')</script><style>p{margin:0}</style><noscript><p>Turn it on</p></noscript>",
}
FRAMES = {
    "article": f"<article>{ARTICLE}</article>", "main": f"<main><article>{ARTICLE}</article></main>", "named": f'<div id="content"><div class="post-body">{ARTICLE}</div></div>',
    "wrapped": f'<div class="page has-sidebar comments-open"><article class="post">{ARTICLE}</article></div>', "bare": f"<div>{ARTICLE}</div>",
}


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("piece", PIECES)
def test_pages_of_known_content(frame, piece):
    html = f"<html><head><title>T</title></head><body>{PIECES[piece]}{FRAMES[frame]}{PIECES[piece]}</body></html>"
    assert extraction.main_text(html)[0] == WANTED


@pytest.mark.parametrize("piece", [p for p in PIECES if p != "header"])
def test_pieces_within_an_article(piece):
    html = f"<body>{PIECES['header']}<article><h1>The title</h1><p>{LONG}</p>{PIECES[piece]}<p>Short.</p><p>{LONG}</p></article>{PIECES['footer']}</body>"
    assert extraction.main_text(html)[0] == f"The title\n{LONG}\nShort.\n{LONG}"


def test_all_pieces_at_once():
    before = "".join(PIECES[p] for p in ("header", "nav", "ad", "notice", "script"))
    after = "".join(PIECES[p] for p in ("share", "sidebar", "comments", "form", "footer"))
    for frame in FRAMES.values():
        assert extraction.main_text(f"<body>{before}{frame}{after}</body>")[0] == WANTED


def test_query_on_awkward_rows(spark):
    html = f"<nav>{MENU}</nav><article><p>é &amp; ü</p><p>{LONG}</p></article>"
    rows = [(1, "u", None), (2, None, ""), (None, "v", html), (3, "w", html), (3, "w", html), (4, "x", "<p>" + "word " * 200_000), (5, "y", "<" * 1000)]
    pages = spark.createDataFrame([(*r, "t", 3, "x") for r in rows], "page_id long, url string, html string, text string, n_chars int, at string")
    got = {(r["page_id"], r["url"]): r for r in extraction.extract(pages).collect()}
    assert len(got) == 6 and extraction.extract(pages).count() == 7
    assert got[1, "u"]["text"] == got[2, None]["text"] == "" and got[2, None]["n_chars"] == 0
    assert got[None, "v"]["text"] == got[3, "w"]["text"] == f"é & ü\n{LONG}" and got[3, "w"]["n_chars"] == len(f"é & ü\n{LONG}")
    assert got[4, "x"]["text"] == ("word " * 200_000).strip()
    assert extraction.extract(pages.limit(0)).collect() == []


def test_weights_are_learned(spark):
    menus = "".join(f"<nav><p>{LONG} {i}</p></nav><article><p>Brief.</p></article>" for i in range(300))
    pages = spark.createDataFrame([(i, "u", menus) for i in range(12)], "page_id long, url string, html string").repartition(3)
    weights = dict(zip(extraction.WORDS, extraction.learned(pages)))
    assert weights[2] > 0.5 > extraction.WORDS[2] and weights[50] < 0 < extraction.WORDS[50]
    assert extraction.learned(pages.limit(0)) == pytest.approx(extraction.PRIOR)
    assert extraction.learned(pages.selectExpr("page_id", "url", "'<article><p>x' as html")) == pytest.approx(extraction.PRIOR)


def test_given_pages(spark):
    """The generator's own pages: the blocks of the article element, read by a plain splitter."""
    import html as entities
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extraction.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
        assert got[r["page_id"]] == "\n".join(t for t in (" ".join(entities.unescape(p).split()) for p in parts) if t)
