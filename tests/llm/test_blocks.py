"""Pages whose blocks the cut decides, the query against an independent reader, all labellings of small pages."""

from __future__ import annotations

import itertools
import time
from html.parser import HTMLParser

import numpy as np
import pytest

import __spark_entry__ as entry
from toolweave.llm import common, htmltext

LONG = "This paragraph tells a part of the story in a good many words so that its length alone speaks for it being content of the page and not of its frame, whatever the elements are that its author has put around it."
LINES = [LONG, "A short one.", LONG + " Again.", "Ends here."]


def signs(page, weights=htmltext.START_WEIGHTS):
    blocks, elements = htmltext.read_blocks(page)
    odds, _ = htmltext.cut_costs(blocks, elements, weights)
    return "\n".join(b.text for b, z in zip(blocks, odds, strict=True) if z > 0)


DIVIDED = [
    "<div>" + "".join(f"<div>{t}</div>" for t in LINES) + "</div>",
    "<table><tr><td>" + "</td></tr><tr><td>".join(LINES) + "</td></tr></table>",
    "<div><ul>" + "".join(f"<li>{t}</li>" for t in LINES) + "</ul></div><div><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul></div>",
]


@pytest.mark.parametrize("page", DIVIDED)
def test_cut_keeps_short_blocks_of_the_story(page):
    """Short blocks have negative odds of their own; the blocks around them decide."""
    assert htmltext.main_text(page) == "\n".join(LINES) != signs(page)


def test_cut_drops_a_long_block_among_links():
    """A block of some words between links: its own odds are positive, its neighbours' are not."""
    links = "".join(f"<li><a href='/{i}'>Some words of a link {i}</a></li>" for i in range(12))
    blurb = "We gather what others write about gardens, tools, soil and seeds, once a day in the evening hours, sent to you by post."
    page = f"<div><ul>{links}<li>{blurb}</li>{links}</ul></div><section><p>{LONG}</p><p>{LONG}</p></section>"
    assert blurb in signs(page) and htmltext.main_text(page) == f"{LONG}\n{LONG}"


FRAMES = {
    "blog": "<header><h1>The site</h1><nav><a href=/>Home</a></nav></header><main><article><h1>Title</h1>{}<footer>By A. on Monday</footer></article><section id='comments'><p>" + LONG + "</p></section></main><aside><p>" + LONG + "</p></aside><footer>About us</footer>",
    "plain": "<div id='top'><a href=/>Home</a> <a href=/b>Blog</a></div><div id='content'><h1>Title</h1>{}</div><div class='sidebar'><h3>More</h3><p>" + LONG + "</p></div><div id='footer'>All rights reserved</div>",
    "notice": "<div class='cookie-notice'><p>" + LONG + "</p><button>OK</button></div><article><h1>Title</h1>{}<div class='ad-slot'>Buy now!</div><form><p>Write to us</p><input></form></article>",
}


@pytest.mark.parametrize("name", FRAMES)
def test_frames(name):
    page = "<!doctype html><html><head><title>T</title><style>p{}</style></head><body>" + FRAMES[name].format("".join(f"<p>{t}</p>" for t in LINES)) + "</body></html>"
    assert htmltext.main_text(page) == "\n".join(["Title", *LINES])


@pytest.mark.parametrize("page", [*DIVIDED, FRAMES["notice"].format(f"<p>{LONG}</p>"), "<p>a</p>" * 9, "<div>x</div><article><p>" + LONG + "</p>y</article>z"])
def test_labels_are_of_least_cost(page):
    blocks, elements = htmltext.read_blocks(page)
    odds, edges = htmltext.cut_costs(blocks, elements)

    def cost(side):
        own = sum(max(z, 0) * (not s) + max(-z, 0) * s for z, s in zip(odds, side, strict=True))
        return own + sum(w for i, j, w in edges if side[i] != side[j])

    best = min(itertools.product([False, True], repeat=len(blocks)), key=lambda s: (round(cost(s), 9), sum(s)))
    assert list(best) == htmltext.label_blocks(blocks, elements)


class Article(HTMLParser):
    """The text of a page's article by the library's parser: lines at block tags, white space as one blank."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.lines += [""] if tag in ("p", "h1", "article") else []
        self.lines[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.lines += [""] if tag in ("p", "h1", "article") else []

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data


def test_query_against_an_independent_reader(spark, small):
    want = {}
    for r in common.documents(spark, small, "pages").collect():
        reader = Article()
        reader.feed(r.html)
        reader.close()
        text = "\n".join(line for x in reader.lines if (line := " ".join(x.split())))
        want[r.page_id] = (r.url, text, len(text))
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in entry.queries()["op5_html_extraction"](spark, small).collect()}
    assert got == want


def test_weights_are_learned(spark, small):
    pages = common.documents(spark, small, "pages")
    learned = htmltext.train_weights(pages)
    assert learned != htmltext.START_WEIGHTS and learned.links < 0 < learned.length
    assert htmltext.train_weights(pages.filter("false")) == htmltext.START_WEIGHTS
    assert htmltext.train_weights(pages.selectExpr("page_id", "'<p>no article</p>' as html")) == htmltext.START_WEIGHTS


def test_weights_by_small_steps():
    """Newton's result against plain gradient ascent of the penalised likelihood."""
    rng = np.random.default_rng(2)
    shapes = np.stack([np.ones(40), rng.random(40), rng.random(40), rng.integers(0, 2, 40)], 1)
    content = (rng.random(40) < shapes[:, 1]).astype(float)
    w = np.array(htmltext.START_WEIGHTS)
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-shapes @ w))
        w = w + 0.01 * (shapes.T @ (content - p) - (w - np.array(htmltext.START_WEIGHTS)) / htmltext.WEIGHT_SPREAD**2)
    assert np.allclose(w, htmltext.fit_weights(shapes, content, np.ones(40)), atol=1e-4)


def test_markup_is_read_in_linear_time():
    began = time.perf_counter()
    for page in ("<center>" * 40_000 + "</div>" * 40_000, "<ul>" + "<center>" * 20_000 + "<li></li>" * 20_000, "<svg>" * 40_000 + "</math>" * 40_000, "<svg>" * 20_000 + "<math></math>" * 20_000, "<a '" * 40_000, "<!--" * 40_000):
        assert htmltext.main_text(page) == ""
    assert time.perf_counter() - began < 20
    assert htmltext.main_text(f"<article><p>{LONG}</p>" + f"<p>{LONG}</p>" * 20_000 + "</article>").count("\n") == 20_000
