"""Elements that are left out do not take the rest of the page with them when their end tag is missing."""

import pytest

from kithwork.llm import html_text

BODY = "<article><h1>A title</h1><p>" + "First paragraph of the article, with some words. " * 4 + "</p><p>" + "Second paragraph, as long as the first one is. " * 4 + "</p></article>"


def pieces(source):
    return " ".join(t for _, t in html_text.Page(source).pieces)


@pytest.mark.parametrize("source", [
    "<html><head><title>T</title><meta charset=utf-8>" + BODY + "</html>",
    "<head><title>T</title><script>var a;</script><body>" + BODY,
    "<html><head><noscript><link rel=x><body>" + BODY,
    *(f"<body><div><{x}>left out</div>{BODY}</body>" for x in ("button", "select", "object", "svg", "noscript", "template", "video", "canvas")),
    "<body><svg><path d='M0'/>" + BODY,
    "<body><div><button>left out<button>left out</div>" + BODY,
    "<body><object><object>left out</object>left out</object>" + BODY,
])
def test_nothing_behind_is_lost(source):
    assert pieces(source) == pieces(BODY) != ""


def test_white_space_of_any_kind_becomes_one_space():
    page = "<body><article><h1>A&nbsp;&nbsp;title</h1><p>First\u2003words\u00a0\n\t of it, and more of them so that it is a paragraph.</p></article></body>"
    assert html_text.trained().texts([page]) == ["A title\nFirst words of it, and more of them so that it is a paragraph."]
