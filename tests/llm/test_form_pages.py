"""A form around the whole page is a wrapper; forms beside the text still go."""

from __future__ import annotations

from toolweave.llm import htmltext

ONE, TWO = ("one " * 60).strip() + ".", ("two " * 60).strip() + "."
SEARCH = "<form class='search'><label>Search this site</label><input name='q'><button>Go</button></form>"


def test_page_in_a_form():
    page = f"<body><form id='aspnetForm' method='post'><div class='content'><h1>Head line</h1><p>{ONE}</p><p>{TWO}</p></div><div class='footer'>all rights</div></form></body>"
    assert htmltext.main_text(page) == f"Head line\n{ONE}\n{TWO}"


def test_forms_beside_the_text_go():
    form = "<form action='/subscribe'><p>Your name and address please, we will write to you every week about all the news.</p><input></form>"
    assert htmltext.main_text(f"<body><article><p>{ONE}</p>{form}<p>{TWO}</p></article>{SEARCH}</body>") == f"{ONE}\n{TWO}"
    assert htmltext.main_text(f"<body><div><p>{ONE}</p><p>{TWO}</p></div>{SEARCH}{form}</body>") == f"{ONE}\n{TWO}"


def test_page_of_a_form_alone():
    """Labels and fields are no article."""
    assert htmltext.main_text(f"<body><h1>Find</h1>{SEARCH}</body>").split("\n")[-1] in ("", "Find")
