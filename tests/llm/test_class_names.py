"""Class names that only mention boilerplate don't empty a page."""

from __future__ import annotations

import pytest

from toolweave.llm import htmltext

TEXT = ("word " * 60).strip()


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content has-sidebar'><article><p>{}</p></article></div>",
        "<article class='post has-comments category-social'><p>{}</p></article>",
        "<main class='page comments'><p>{}</p></main>",
        "<div id='sidebar-layout'><article><p>{}</p></article></div><div class='sidebar'><p>menu of the site</p></div>",
        "<div class='content-sidebar-wrap'><div><p>{}</p></div></div><div class='site-footer'><p>about us and more</p></div>",
    ],
)
def test_article_stays(page):
    assert htmltext.main_text(page.format(TEXT)) == TEXT


def test_boilerplate_still_goes():
    long = ("talk " * 300).strip()
    assert htmltext.main_text(f"<article><p>{TEXT}</p></article><div class='post-comments'><p>{long}</p></div>") == TEXT
    assert htmltext.main_text(f"<article><p>{TEXT}</p><div class='comments'><p>{long}</p></div></article>") == TEXT
    assert htmltext.main_text(f"<div><p>{TEXT}</p></div><div class='site-footer'><p>{TEXT}</p></div>") == TEXT
