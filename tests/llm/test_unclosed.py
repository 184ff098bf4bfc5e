"""Elements that hide their content and are never closed don't take the rest of the page with them."""

from __future__ import annotations

import time

import pytest

from toolweave.llm import htmltext

FIRST, SECOND = ("first " * 40).strip(), ("second " * 40).strip()


@pytest.mark.parametrize("start", ["<button>", "<svg>", "<object data='x'>", "<canvas>", "<audio controls>", "<video src='v'>", "<select><option>", "<math>"])
def test_text_after_stays(start):
    page = f"<body><article><p>{FIRST}</p>{start}<p>{SECOND}</p></article></body>"
    assert htmltext.main_text(page) == f"{FIRST}\n{SECOND}"


@pytest.mark.parametrize("tag", ["button", "svg", "object", "canvas"])
def test_end_of_what_is_around(tag):
    """The end of an element around an open one ends it, though another of its kind is closed later; one inside doesn't."""
    page = f"<body><article><div><p>{FIRST}</p><{tag}>x</div><p>{SECOND}</p></article><div class='footer'><{tag}>y</{tag}></div></body>"
    assert htmltext.main_text(page) == f"{FIRST}\n{SECOND}"
    page = f"<body><article><div><p>{FIRST}</p><{tag}><div>x</div>gone</{tag}></div><p>{SECOND}</p></article></body>"
    assert htmltext.main_text(page) == f"{FIRST}\n{SECOND}"


def test_many_unclosed_take_linear_time():
    began = time.perf_counter()
    htmltext.main_text("<article>" + "<svg><p>word</p>" * 20_000 + "</article>")
    assert time.perf_counter() - began < 20
