"""HTML extraction: exact marginals, pages written by hand, broken pages, linear time."""

import itertools
import random
import time

import numpy as np
import pytest

from glyphflow.llm import html_text

#: Pages in the manner of blogs, news sites, manuals and forums; none comes from the generator that trains the model.
BY_HAND = {
    "blog": (
        """<!doctype html><html><head><title>A day out - My Blog</title><link rel=stylesheet href=x.css></head><body class="home">
<header class="site-header"><a href="/">My Blog</a><p>Notes on walking</p></header>
<nav class="main-navigation"><ul><li><a href="/">Home</a><li><a href="/about">About</a></ul></nav>
<main><article class="post hentry"><h1 class="entry-title">A day out</h1>
<div class="entry-content"><p>We left early in the morning, before the shops opened, and took the bus to the lake.</p>
<p>The path follows the shore for three miles &mdash; bring&nbsp;water.</p>
<ul><li>Boots that keep the rain out</li><li>A map of the area</li></ul>
<p>By noon we were back at the old mill.</p></div></article>
<section id="comments"><h3>2 comments</h3><ol class="comment-list"><li class="comment"><p>Lovely pictures, thank you for sharing them!</p></li></ol></section></main>
<aside class="widget-area"><h2>Recent posts</h2><ul><li><a href="/1">Older post</a></li></ul></aside>
<footer class="site-footer"><p>&copy; 2021 My Blog. All rights reserved.</p></footer></body></html>""",
        ["A day out", "We left early in the morning, before the shops opened, and took the bus to the lake.", "The path follows the shore for three miles — bring water.",
         "Boots that keep the rain out", "A map of the area", "By noon we were back at the old mill."],
    ),
    "news": (
        """<html><body><div id="cookie-banner" class="cookie-consent"><p>We use cookies to improve your experience on this site.</p><button>Accept</button></div>
<div class="topbar"><a href="/l">Log in</a> | <a href="/s">Subscribe</a></div>
<div class="navbar"><ul><li><a href="/w">World</a></li><li><a href="/b">Business</a></li></ul></div>
<div class="container"><div class="story-body"><h1>Council votes to keep the bridge</h1>
<div class="advert">Cheap flights to the coast from ten pounds.</div>
<p>The council voted on Tuesday to keep the bridge open to walkers.</p><p>Work on the eastern pier will begin in spring, officials said.</p>
<blockquote>"It is a good day for the town," the mayor said.</blockquote></div>
<div class="related"><h3>More stories</h3><ul><li><a href="/x">Storm closes the ferry</a></li></ul></div></div>
<div class="footer"><ul><li><a href="/p">Privacy</a></li></ul><p>Copyright Town News</p></div></body></html>""",
        ["Council votes to keep the bridge", "The council voted on Tuesday to keep the bridge open to walkers.", "Work on the eastern pier will begin in spring, officials said.",
         '"It is a good day for the town," the mayor said.'],
    ),
    "manual": (
        """<html><body><nav role="navigation"><ul><li><a href="#1">Install</a><li><a href="#2">Use</a></ul></nav>
<main id="main"><section><h1>Installing the tool</h1><p>Download the archive and unpack it into a folder of your choice.</p><pre>tar xf tool.tar
cd tool</pre><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-q</td><td>be quiet</td></tr></table></section></main>
<footer>Built with care</footer></body></html>""",
        ["Installing the tool", "Download the archive and unpack it into a folder of your choice.", "tar xf tool.tar cd tool", "Option", "Meaning", "-q", "be quiet"],
    ),
    "plain": ("<h1>Minutes</h1><p>Nobody came to the meeting, so it was put off until next week.</p>", ["Minutes", "Nobody came to the meeting, so it was put off until next week."]),
}


@pytest.mark.parametrize("name", BY_HAND)
def test_pages_by_hand(name):
    page, want = BY_HAND[name]
    assert html_text.extract(html_text.trained(), [html_text.parse(page)])[0].split("\n") == want


def test_marginals_against_enumeration():
    """Sum-product against the sum over all labellings of small trees."""
    draw = np.random.default_rng(1)
    for seed in range(6):
        n = 9
        page = html_text.Page(parent=[-1, *(int(draw.integers(0, k)) for k in range(1, n))], tags=["div"] * n, marks=[set()] * n, labels=[0] * n)
        weights, pair = draw.standard_normal(len(html_text.FEATURES)) * 2, draw.standard_normal((2, 2)) * 2
        forest = html_text.Forest([page, page])
        x = draw.standard_normal((n, len(html_text.FEATURES)))
        forest.x = np.concatenate([x, x])
        p, pairs = forest.beliefs(weights, pair)
        total, ones, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(x[k] @ weights for k in range(n) if y[k]) + sum(pair[y[page.parent[k]], y[k]] for k in range(1, n)))
            total += w
            ones += w * np.array(y)
            for k in range(1, n):
                both[k, y[page.parent[k]], y[k]] += w
        assert np.allclose(p, np.tile(ones / total, 2)) and np.allclose(pairs[1:n], (both / total)[1:])


def test_held_out_layouts():
    pages = html_text.labelled_pages(60, seed=77)
    right = [(p[node] >= 0.5) == (page.labels[node] == 1) for page, p in zip(pages, html_text.trained().marginals(pages), strict=True) for node, _, _ in page.blocks]
    assert np.mean(right) > 0.95


BODY = "<p>Article body goes on here for a while, with quite a few words in it.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<button>Go{BODY}", f"<select>{BODY}", f"<noscript>{BODY}", f"<svg>{BODY}", f"<svg><svg></svg>x</svg>{BODY}", f"<title>t{BODY}", f"<textarea>{BODY}", f"<head><title>t</title></head>{BODY}<head>{BODY}",
        f'<div data-y="12.5">{BODY}', f'<div data-y="">{BODY}', f'<div data-id="nav" data-class="footer">{BODY}', f'<script>document.write("<a href=\'x")</script>{BODY}', f'<p title="1 > 0">{BODY}', f"<a href='x>{BODY}",
        f"<!-- a -- b -->{BODY}", f"<!-->{BODY}", f"<!doctype html>{BODY}", f"</div></p></li>{BODY}", f"< p {BODY}", f"{BODY}<", f"{BODY}<a hre", f"<?php x ?>{BODY}", f"{BODY}<!-- never closed", f"{BODY}<script>var x =",
    ],
)
def test_broken_pages_keep_their_text(page):
    assert "Article body goes on here for a while, with quite a few words in it." in [t for _, t, _ in html_text.parse(page).blocks]


def test_text_is_decoded_and_joined():
    blocks = [t for _, t, _ in html_text.parse("<p>a&amp;b &lt;c&gt;\n\t d&#233;<br>e<b>f</b> g</p><p></p><td>1<td>2").blocks]
    assert blocks == ["a&b <c> dé ef g", "1", "2"]


def test_fuzz():
    draw = random.Random(8)
    parts = ["<", ">", "</", "/>", '"', "'", "=", " ", "\n", "<p", "<div class=", "<li>", "</ul>", "<!--", "-->", "<script", "</script>", "<svg>", "</svg>", "&amp;", "&#x;", "text", "<td>", "</table>", "<a href=", "<h1>", "\x00", "é", "<button>", "<head>", "<body>"]
    pages = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 80))) for _ in range(1500)]
    texts = html_text.extract(html_text.trained(), [html_text.parse(p) for p in pages])
    assert len(texts) == 1500 and html_text.parse(None).blocks == [] and html_text.parse("").blocks == []


@pytest.mark.parametrize("piece", ['<b "', '<b x="', "<button>", "<svg>", "<div>", "</p>", "<!--", "<script>", "< ", "<li>", "<title>", "&amp", '<p class="'])
def test_time_is_linear(piece):
    def took(n):
        began = time.process_time()
        html_text.extract(html_text.trained(), [html_text.parse("<div>" * 500 + piece * n)])
        return time.process_time() - began

    html_text.trained()
    assert took(16_000) < 1 + 12 * took(4_000)


def test_rows_nulls_and_names(spark):
    long = "<article>" + BODY * 5_000 + "</article>"
    rows = [(0, "u", BY_HAND["blog"][0], 1), (1, None, None, 1), (2, "v", "", 1), (3, "w", "no tags at all", 1), (4, "x", long, 1), (4, "x", long, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.main_text(df).collect()]
    assert sorted(got, key=str) == sorted([(0, "u", t := "\n".join(BY_HAND["blog"][1]), len(t)), (1, None, "", 0), (2, "v", "", 0), (3, "w", "no tags at all", 14)] + [(4, "x", t := "\n".join([BODY[3:-4]] * 5_000), len(t))] * 2, key=str)
    assert html_text.main_text(df.limit(0)).count() == 0
