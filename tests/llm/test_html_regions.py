"""Readers' comments, adverts, titles beside the text, formulas and lists of references."""

import pytest

from loomspan.llm.html_text import main_text

TEXT = "<p>" + "This is running article text, quite long enough, with several words. " * 4 + "</p>"
REMARK = "<p>" + "I think this is a great reader remark about all of it. " * 9 + "</p>"


@pytest.mark.parametrize("name", ["comments", "user-comments", "reader-comments", "post-comments", "fb-comments", "article-comments", "commentList", "cookie-banner", "ad-slot", "google-ad"])
def test_never_the_article_whatever_their_share(name):
    for kind in ("id", "class"):
        inside = main_text(f'<body><article><h1>Title</h1>{TEXT}<div {kind}="{name}">{REMARK * 3}</div></article></body>')
        beside = main_text(f'<body><div class="story"><h1>Title</h1>{TEXT}</div><div {kind}="{name}">{REMARK * 3}</div></body>')
        assert "remark" not in inside + beside and "running article" in inside and "running article" in beside, (kind, name)


def test_states_of_a_page_are_no_regions():
    for wrap in ('<body class="comments-open">', '<body><div class="page has-comments">', '<body><div id="with-ads">'):
        assert "running article" in main_text(f"{wrap}<h1>Title</h1>{TEXT}{TEXT}")
    assert "running article" in main_text(f'<body><div class="ad-page"><article>{TEXT}</article></div></body>')


def test_titles_leads_and_further_sections():
    got = main_text(f'<body><div id="page"><div class="head"><h1>Title here</h1><p>Lead text.</p></div><div class="text">{TEXT * 3}</div></div></body>')
    assert got.startswith("Title here\n\nLead text.\n\nThis is")
    got = main_text(f'<body><div id="page"><div class="part"><h2>One</h2>{TEXT * 3}</div><div class="part"><h2>Two</h2><p>Short part.</p></div></div></body>')
    assert got.startswith("One\n\n") and got.endswith("Two\n\nShort part.")
    menu = '<div class="box"><h2>More</h2><a href="x">one</a> <a href="y">two</a></div>'
    assert "two" not in main_text(f'<body><div id="page"><div class="text">{TEXT * 3}</div>{menu}</div></body>')


def test_formulas_and_references():
    assert "so x=1 holds" in main_text(f"<body><article>{TEXT}<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p></article></body>")
    refs = "".join(f"<li><a href='r{k}'>Author {k}. A long title of a paper about many things, 200{k}</a></li>" for k in range(5))
    menu = "<ul><li><a href='x'>Home</a></li><li><a href='y'>News</a></li></ul>"
    # The text is in no element that stands out from the body.
    got = main_text(f"<body>{menu}<h1>Title</h1>{TEXT}<h2>References</h2><ul>{refs}</ul></body>")
    assert "Author 4" in got and "References" in got
